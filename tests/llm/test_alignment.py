"""Token alignment against a plain walk over whole texts."""

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest

from quillgrid.llm import alignment

FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
FILES = (P.path(alignment.A_FILE), P.path(alignment.B_FILE), P.PATTERN)


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        cut_a, cut_b = [ranks[i] for i in ids_a], [b_bytes(i) for i in ids_b]
        return (ids_a, cut_a, ids_b, cut_b) if b"".join(cut_a) == raw == b"".join(cut_b) else ([], [], [], [])

    def run(rows):
        docs = []
        for i, text in rows:
            ids_a, cut_a, ids_b, cut_b = tokens(text)
            x = y = at_a = at_b = 0
            links, groups, ga, gb = [], [], [], []
            while x < len(ids_a):
                links.append((ids_a[x], ids_b[y]))
                end_a, end_b = at_a + len(cut_a[x]), at_b + len(cut_b[y])
                if end_a <= end_b:
                    ga.append(str(ids_a[x]))
                    x, at_a = x + 1, end_a
                if end_b <= end_a:
                    gb.append(str(ids_b[y]))
                    y, at_b = y + 1, end_b
                if end_a == end_b:
                    groups.append(",".join(ga) + "|" + ",".join(gb))
                    ga, gb = [], []
            docs.append((i, len(ids_a), len(ids_b), groups, links))
        count = Counter(p for d in docs for p in d[4])
        top = {}
        for (_, to), n in count.items():
            top[to] = max(top.get(to, 0), n)
        out = []
        for i, n_a, n_b, groups, links in docs:
            said = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
            out.append((i, n_a, n_b, len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), said))
        return sorted(out, key=str), count

    return run


def run(spark, rows, most=alignment.PAIRS, extra=()):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in extra:
        df = df.selectExpr("*", f"1 as {name}")
    docs, pairs = alignment.align(df, *FILES, most)
    got = sorted((tuple(r) for r in docs.select("doc_id", *FIELDS).collect()), key=str)
    return got, {(r["a"], r["b"]): r["n"] for r in pairs.collect()}


ODD = [None, "", " ", "  ", "x ", " x", "a  b\n c", "\n\n  a\t\tb \r\n;\r\n", "<|endoftext|> <s> </s> <unk>", "snow ☃ 雪 𝒳", "a▁b", "say ▁ it", "it's we'll  I'm", "é́ 　   x  y", "\x00 nul", "123 4567.89 -- !!  ...", "ü" * 300, " " * 90 + "end", "word " * 50]


@pytest.mark.parametrize("most", [alignment.PAIRS, 40, 0])
def test_odd_and_random_texts(spark, plain, most):
    rng = random.Random(11)
    chars = "abcdeé ß雪\n\t ☃ '.,12  \r▁"
    rows = list(enumerate(ODD)) + [(100 + i, "".join(rng.choice(chars) for _ in range(rng.randint(1, 80)))) for i in range(60)]
    rows += [(5, "again and again"), (5, "again and again"), (None, "no id here")]
    want, count = plain(rows)
    got, pairs = run(spark, rows, most)
    assert got == want
    assert pairs == dict(count)


def test_forgotten_stretches_and_small_parts(spark, plain, monkeypatch):
    """Many distinct stretches: a worker forgets and aligns again, and counts are flushed in parts."""
    tokenizers = alignment.Tokenizers(open(FILES[0], encoding="utf-8").read(), open(FILES[1], "rb").read(), P.PATTERN)
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    store = alignment.Stretches(tokenizers)
    rng = random.Random(2)
    for _ in range(6):
        texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(9)) for _ in range(5)] + ["y" * 200 + " z", "a▁b c"]
        numbers, sizes = store.numbers(texts)
        want, _ = plain(list(enumerate(texts)))
        ends = sizes.cumsum()
        for (_, n_a, n_b, n_groups, n_links, *_, said), end, size in zip(want, ends, sizes, strict=True):
            mine = numbers[end - size : end]
            assert (store.sizes[mine].sum(axis=0).tolist() if size else [0, 0, 0]) == [n_a, n_b, n_groups]
            assert len(store.links_of(mine)[0]) == n_links
            assert (hashlib.sha256(";".join(store.said[s] for s in mine).encode()).hexdigest() if size else "") == said


def test_long_text_empty_table_and_clashing_columns(spark, plain):
    rng = random.Random(4)
    text = "".join(rng.choice("abc def\n") for _ in range(300_000))
    rows = [(1, text), (2, "q" * 20_000), (3, "short")]
    assert run(spark, rows, extra=("pair", "n", "row", "rare", "best"))[0] == plain(rows)[0]
    assert run(spark, []) == ([], {})


def test_whole_table(spark, plain):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in alignment.op11_token_alignment(spark, sf).select("doc_id", *FIELDS).collect()), key=str)
    assert got == plain(rows)[0]


def test_stretches_end_where_a_visible_character_is_followed_by_a_space():
    import random
    import re

    from quillgrid.llm import alignment

    rng = random.Random(5)
    cut = re.compile(r"(?<=\S)(?= )")
    for _ in range(20000):
        text = " " + "".join(rng.choice(["a", "bc", " ", "  ", "\n", "\t", "　", "é", "​", "\x1c", "\r\n"]) for _ in range(rng.randint(1, 9)))
        assert alignment.STRETCH.findall(text) == cut.split(text)
