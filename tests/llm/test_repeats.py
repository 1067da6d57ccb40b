"""Repeated passages against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillgrid.llm import repeats

FIELDS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def plain(rows, length):
    raws = [(i, (t or "").encode()) for i, t in rows]
    often = Counter(b[p : p + length] for _, b in raws for p in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if often[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.pad(gone.astype(int), 1)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, length=200, group=repeats.GROUP, extra=()):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in extra:
        df = df.selectExpr("*", f"1 as {name}")
    return sorted((tuple(r) for r in repeats.remove_repeats(df, length, group).select("doc_id", *FIELDS).collect()), key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 8))) for _ in range(n))


def corpus(rng, n):
    shared = [words(rng, 60) for _ in range(4)] + [words(rng, 12)]
    rows = []
    for i in range(n):
        parts = [words(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 2)
            parts.insert(rng.randint(0, len(parts)), p[a : a + rng.randint(50, 400)])
        rows.append((i, " ".join(parts)))
    return rows + [(n, rows[0][1]), (n + 1, rows[1][1]), (n + 1, rows[1][1]), (n + 2, None), (n + 3, "")]


@pytest.mark.parametrize(("length", "group"), [(200, repeats.GROUP), (200, 2), (60, 3)])
def test_equals_a_table_of_all_windows(spark, length, group):
    rows = corpus(random.Random(length + group), 60)
    got = run(spark, rows, length, group)
    assert got == plain(rows, length)
    assert sum(r[2] > 0 for r in got) > 20


def test_runs_of_one_letter_periods_and_edges(spark):
    rng = random.Random(3)
    one = words(rng, 100)[:200].encode()[:200].decode("utf-8", "ignore")
    flat = "x" * 200
    rows = [(1, "a" * 700), (2, "ab" * 300), (3, "ab" * 110), (4, flat), (5, flat), (6, "y" * 199), (7, "y" * 199), (8, flat + "z"), (9, one), (10, "q" + words(rng, 30)), (None, "w" * 201)]
    assert run(spark, rows) == plain(rows, 200)


def test_hot_line_between_different_texts(spark):
    """One line everywhere, with its left or right neighbours shared by some: its group is cut to classes and single places."""
    rng = random.Random(5)
    line = words(rng, 30)[:150]
    sides = [words(rng, 20) for _ in range(6)]
    rows = [(i, rng.choice(sides)[rng.randrange(20) :] + line + (rng.choice(sides) if i % 3 else words(rng, 25))) for i in range(80)]
    want = plain(rows, 200)
    assert run(spark, rows, group=1) == run(spark, rows, group=10) == want


def test_long_text_is_cut_into_overlapping_chunks(spark):
    rng = random.Random(9)
    long_ = "".join(rng.choice("abcdefgh ") for _ in range(2 * repeats.CHUNK + 500))
    at = repeats.CHUNK - 150
    rows = [(1, long_), (2, "start " + long_[at : at + 400]), (3, long_[at + 50 : at + 249])]
    got = run(spark, rows)
    assert [r[1:4] for r in got] == [(len(long_), 400, 1), (406, 400, 1), (199, 0, 0)]
    assert got[0][4] == hashlib.sha256((long_[:at] + long_[at + 400 :]).encode()).hexdigest()


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    rows = corpus(random.Random(1), 10)
    assert run(spark, rows, extra=("k1", "n", "gram", "seat", "spans", "n_bytes")) == plain(rows, 200)


def test_whole_table_equals_a_table_of_all_windows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r[f] for f in ("doc_id", *FIELDS)) for r in repeats.op12_repeated_passages(spark, sf).collect()), key=str)
    assert got == plain(rows, 200)
