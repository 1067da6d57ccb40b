"""Plain versions that the operators are held against."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) >= k:
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def components(rows, k, percent):
    """id -> (set size, least id reachable), every pair compared that shares a shingle of its prefix."""
    sets = {}
    for i, text in rows:
        sets[i] = shingle_set(text, k)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def link(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    often = Counter(s for x in sets.values() for s in x)
    seen = defaultdict(list)
    for i, s in sorted(sets.items(), key=lambda x: len(x[1])):
        prefix = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]
        for j in {j for x in prefix for j in seen[x]}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                link(i, j)
        for x in prefix:
            seen[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}
