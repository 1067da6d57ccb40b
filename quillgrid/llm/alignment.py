"""Alignment of two tokenizers: which tokens of one share bytes with which of the other, in each text and in the corpus.

A byte-level BPE (A) reads space + text, a sentencepiece BPE (B) reads the text and adds the space itself; both cut the same
bytes. Inside each Arrow batch DuckDB holds the tokens as interval tables: an ASOF join finds the token of B that holds the
first byte of each token of A, a range join the tokens of B that start inside one of A; together these are all overlaps.
Window sums over starts that both share number the groups. Counts of id pairs are partial sums of a task, merged in Spark.

Texts are cut where a visible character is followed by a space: no token of either reaches over such a place (A's pattern
and B's pieces have a space at their start only), so each distinct *stretch* of a batch is aligned once, remembered, and a
text's result is put together from its stretches. A text with a stretch that doesn't read back is aligned as a whole.

The second pass needs each pair's count. The ``PAIRS`` most frequent pairs are broadcast (a bound of 24 bytes each, whatever
the corpus); rarer ones, which can't be hot, are looked up by a join on the pair.

Defined cases: texts that are null, empty, or whose bytes by A or B differ from space + text have no tokens: zeros and ''; rows
with one doc_id are documents of their own; ties for a B id's highest count all are best; an empty table gives an empty result;
other columns are ignored. Very long texts are read whole; a stretch of more than ``LONG`` characters isn't remembered.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import Scratch, small_batches, table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
PAIRS = 1_000_000  # pairs that are broadcast
REMEMBERED = 300_000  # stretches that a worker remembers
LONG = 64
TOGETHER = 1000  # stretches that are read at once
PART_PAIRS = 1_000_000  # pairs whose partial counts a task holds
PART_CHARS = 4_000_000  # characters that are looked at together
ID = 1 << 20  # a pair is a * ID + b
STRETCH = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*\Z)?|\s+")  # up to where a visible character is followed by a space

#: n: the group's number, a window sum over the starts that both sides share; q: where the token of B starts.
FIRST = """
create or replace temp table x as
select g, s, e, a, b, q, cast(sum(case when s = q then 1 else 0 end) over (order by s rows unbounded preceding) as bigint) as n
from (select a.g, a.s, a.e, a.id as a, b.id as b, b.s as q from a asof join b on a.s >= b.s)"""
INSIDE = """
create or replace temp table y as
select x.g, x.a, b.id as b, b.s as q, x.n
from (select * from b anti join a on b.s = a.s) b join (select * from x where e - s > 1) x on b.s > x.s and b.s < x.e"""
LINKS = "select g, a * 1048576 + b as pair from x union all select g, a * 1048576 + b from y"
TOKENS = """
select g, n, side, id from (
  select g, n, 0 as side, s, a as id from x
  union all select g, n, 1, q, b from x where s = q
  union all select g, n, 1, q, b from y) order by n, side, s"""


class Tokenizers:
    """Ids and token lengths in bytes; the tokens' bytes are compared with the text's."""

    def __init__(self, a_json: str, b_model: bytes, pattern: str):
        import sentencepiece
        import tiktoken

        from quillgrid.llm.bpe import byte_characters

        model = json.loads(a_json)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        own = {x["content"] for x in model["added_tokens"]}
        vocab = {t: i for t, i in model["model"]["vocab"].items() if t not in own}
        merges = model["model"]["merges"]
        if any(vocab["".join(m.split(" ") if isinstance(m, str) else m)] != 256 + i for i, m in enumerate(merges)):
            raise ValueError("merges aren't in the order of ids")
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = {i: t for t, i in ranks.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b_bytes = {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
        self.space = self.b.piece_to_id("▁")

        self.sizes = [np.array([len(t.get(i, b"")) for i in range(max(t) + 1)]) for t in (self.a_bytes, self.b_bytes)]

    def __call__(self, stretches: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of A and B of texts that start with a space, end to end; how many each text has; which texts read back by both."""
        size = pc.binary_length(pa.array(stretches, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, count, good = [], [], np.ones(len(stretches), bool)
        for encode, token, length in ((self._a, self.a_bytes, self.sizes[0]), (self._b, self.b_bytes, self.sizes[1])):
            # no token reaches over the end of a stretch, so many are read at once and cut by their bytes
            some = [encode("".join(stretches[at : at + TOGETHER])) for at in range(0, len(stretches), TOGETHER)]
            ids = np.concatenate(some) if some else np.zeros(0, np.int64)
            at = np.searchsorted(np.cumsum(length[ids]), np.cumsum(size), "right")
            n = np.diff(at, prepend=0)
            if b"".join(map(token.__getitem__, ids.tolist())) != "".join(stretches).encode() or not np.array_equal(_sums(length[ids], n), size):
                each = list(map(encode, stretches))
                ids, n = np.concatenate(each), np.array(list(map(len, each)))
                good &= np.array([b"".join(map(token.__getitem__, x.tolist())) == s.encode() for x, s in zip(each, stretches, strict=True)])
            flat.append(ids)
            count.append(n)
        return flat, count, good

    def _a(self, text: str) -> np.ndarray:
        return self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def _b(self, text: str) -> np.ndarray:
        return np.array(self.b.encode(text[1:]) or [self.space], np.int64)


class Stretches:
    """Aligned stretches of one worker: sizes, said groups and pairs by number."""

    def __init__(self, tokenizers: Tokenizers, say: bool = True):
        """say: whether groups are written out."""
        import duckdb

        self.tokenizers, self.say = tokenizers, say
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.sizes = np.zeros((0, 3), np.int64)  # n_a, n_b, n_groups
        self.said: list[str] = []
        self.ends = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.bad: set[int] = set()

    def _add(self, new: list[str]) -> None:
        """Aligns texts that start with a space and numbers them on."""
        flat, count, good = self.tokenizers(new)
        first = len(self.said)
        self.bad |= set((first + np.flatnonzero(~good)).tolist())
        sizes, said, counts, pairs = np.zeros((len(new), 3), np.int64), [""] * len(new), np.zeros(len(new), np.int64), np.zeros(0, np.int64)
        if good.any():
            for name, ids, n, length in zip("ab", flat, count, self.tokenizers.sizes, strict=True):
                of = np.repeat(np.arange(len(new)), n)
                of, ids = of[good[of]], ids[good[of]]
                end = np.cumsum(length[ids])
                self.db.register("rows", pa.table({"g": of, "id": ids, "s": np.r_[0, end[:-1]], "e": end}))
                self.db.execute(f"create or replace temp table {name} as select * from rows")
            self.db.execute(FIRST)
            self.db.execute(INSIDE)
            links = self.db.sql(LINKS).to_arrow_table()
            of = np.array(links["g"])
            by = np.argsort(of, kind="stable")
            pairs, counts = np.array(links["pair"])[by], np.bincount(of, minlength=len(new))
            if self.say:
                said, sizes = _said(self.db.sql(TOKENS).to_arrow_table(), len(new))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.said += said
        self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(counts)]
        self.pairs = np.concatenate([self.pairs, pairs])

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all stretches in order, how many each text has); a text without tokens has none.

        Numbers hold until the next call.
        """
        if len(self.said) > REMEMBERED:
            self.clear()
        cut = [STRETCH.findall(" " + t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        every = list(chain.from_iterable(cut))
        new = [s for s in dict.fromkeys(every) if s not in self.number]
        first = len(self.said)
        self._add(new)
        here = dict(zip(new, range(first, first + len(new)), strict=True))
        kept = {s: i for s, i in here.items() if len(s) <= LONG}
        self.number |= kept
        look = self.number | here if len(kept) < len(here) else self.number
        numbers = np.fromiter(map(look.__getitem__, every), np.int64, len(every))
        if not self.bad:
            return numbers, sizes
        # read as wholes: only then do A's and B's bytes tell whether the text has tokens
        rows = [r.tolist() for r in np.split(numbers, np.cumsum(sizes)[:-1])]
        whole = [i for i, r in enumerate(rows) if not self.bad.isdisjoint(r)]
        first = len(self.said)
        self._add([" " + texts[i] for i in whole])
        for n, i in enumerate(whole):
            rows[i] = [] if first + n in self.bad else [first + n]
        return np.fromiter(chain.from_iterable(rows), np.int64), np.array([len(r) for r in rows], np.int64)

    def links_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, how many) of stretches, end to end."""
        low, high = self.ends[numbers], self.ends[numbers + 1]
        size = high - low
        at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
        return self.pairs[at], size


def _said(tokens: pa.Table, n: int) -> tuple[list[str], np.ndarray]:
    """The groups of each of n stretches as text, and its sizes; tokens: g, n, side, id in order."""
    of, group, side = (np.array(tokens[c]).astype(np.int64) for c in ("g", "n", "side"))
    new = np.r_[True, group[1:] != group[:-1]]
    start = np.r_[True, of[1:] != of[:-1]]
    mark = np.where(start, 0, np.where(new, 1, np.where(np.r_[False, side[1:] != side[:-1]], 2, 3)))
    marks = pa.DictionaryArray.from_arrays(pa.array(mark, pa.int8()), pa.array(["", ";", "|", ","])).cast(pa.string())
    each = pc.binary_join_element_wise(marks, pc.cast(tokens["id"].combine_chunks(), pa.string()), "")
    size = np.bincount(of, minlength=n)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), each), "")
    return whole.to_pylist(), np.column_stack([np.bincount(of[side == 0], minlength=n), np.bincount(of[side == 1], minlength=n), np.bincount(of[new], minlength=n)])


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of values; sizes: of the runs, zeros allowed."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)])
    end = np.cumsum(sizes)
    return total[end] - total[end - sizes]


_held: dict[str, Stretches] = {}


def _stretches(shared, say: bool) -> Stretches:
    """One for a worker process."""
    digest, *files = shared.value
    key = f"{digest} {say}"
    if key not in _held:
        _held.clear()
        _held[key] = Stretches(Tokenizers(*files), say)
    return _held[key]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Some rows (ids, texts) at a time."""
    for batch in batches:
        ids, texts, chars = [], [], 0
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids.append(i)
            texts.append(text.as_py())
            chars += len(texts[-1] or "")
            if chars > PART_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
        if ids:
            yield ids, texts


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    some, at = np.unique(np.concatenate(pairs), return_inverse=True)
    out = np.zeros(len(some), np.int64)
    np.add.at(out, at, np.concatenate(counts))
    return some, out


def _count(shared):
    """Partial counts of pairs: (pair, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _stretches(shared, False)
        pairs, counts, held = [], [], 0
        for _, texts in _parts(batches):
            numbers, _ = store.numbers(texts)
            some, often = np.unique(numbers, return_counts=True)
            found, size = store.links_of(some)
            pairs.append(found)
            counts.append(np.repeat(often, size))
            held += len(found)
            if held > PART_PAIRS:
                pairs, counts = ([x] for x in _merged(pairs, counts))
                held = len(pairs[0])
                if held > PART_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(counts[0])], ["pair", "n"])
                    pairs, counts, held = [], [], 0
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(pairs, counts)], ["pair", "n"])

    return run


DOC = {"doc_id": pa.int64(), "row": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "n_best": pa.int64(), "count_sum": pa.int64(), "groups_sha256": pa.string(), "rare": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}
DOC_DDL = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<bigint>, times array<bigint>"


def _align(shared, known):
    """A row for each text, with the links whose pairs aren't known here and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _stretches(shared, True)
        pair, n, best = (np.frombuffer(x, t) for x, t in zip(known.value, ("<i8", "<i8", "?"), strict=True))
        row = TaskContext.get().partitionId() << 40
        for ids, texts in _parts(batches):
            numbers, sizes = store.numbers(texts)
            some, at = np.unique(numbers, return_inverse=True)
            found, links = store.links_of(some)
            place = np.minimum(np.searchsorted(pair, found), max(0, len(pair) - 1))
            hit = pair[place] == found if len(pair) else np.zeros(len(found), bool)
            values = np.column_stack([np.where(hit, best[place], 0), np.where(hit, n[place], 0)]) if len(pair) else np.zeros((len(found), 2), np.int64)
            each = _sums(values.astype(np.int64), links)
            flat = np.column_stack([store.sizes[numbers], links[at], each[at]]).reshape(-1, 6)
            total = _sums(flat, sizes)
            end = np.cumsum(sizes)
            rare_of = _sums((~hit).astype(np.int64), links)
            rares, times, digests = [], [], []
            for y, size in zip(end.tolist(), sizes.tolist(), strict=True):
                mine = numbers[y - size : y].tolist()
                digests.append(hashlib.sha256(";".join([store.said[s] for s in mine]).encode()).hexdigest() if mine else "")
                own = at[y - size : y]
                own = own[rare_of[own] > 0]
                if len(own):
                    stretch, often = np.unique(own, return_counts=True)
                    p, size_of = store.links_of(some[stretch])
                    where = np.searchsorted(pair, p)
                    unknown = np.ones(len(p), bool) if not len(pair) else pair[np.minimum(where, len(pair) - 1)] != p
                    p, c = _merged([p[unknown]], [np.repeat(often, size_of)[unknown]])
                    rares.append(p.tolist())
                    times.append(c.tolist())
                else:
                    rares.append([])
                    times.append([])
            rows = np.arange(row, row + len(ids))
            row += len(ids)
            cols = [ids, rows, *(total[:, c] for c in range(6)), digests, rares, times]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, DOC.values(), strict=True)], list(DOC))

    return run


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, most: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """(a row for each of docs, the corpus' pairs a, b, n, best). most: how many pairs are broadcast; the result is the same."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    with open(a_path, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    digest = hashlib.sha256(a_json.encode() + b_model + pattern.encode()).hexdigest()
    shared = spark.sparkContext.broadcast((digest, a_json, b_model, pattern))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = docs.mapInArrow(_count(shared), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts.select("pair", "n", (F.col("pair") % ID).alias("b")))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    pairs = scratch.keep(counts.join(top, "b").select("pair", F.floor(F.col("pair") / ID).alias("a"), "b", "n", (F.col("n") == F.col("top")).alias("best")))
    known = pairs.orderBy(F.desc("n"), "pair").limit(most).select("pair", "n", "best").toArrow().sort_by("pair")
    rare = pairs.join(F.broadcast(spark.createDataFrame(pa.table({"pair": known["pair"]}))), "pair", "left_anti") if known.num_rows else pairs
    held = spark.sparkContext.broadcast(tuple(np.array(known[c]).astype(t).tobytes() for c, t in (("pair", "<i8"), ("n", "<i8"), ("best", "?"))))
    done = scratch.keep(docs.mapInArrow(_align(shared, held), DOC_DDL))
    asked = done.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    more = asked.join(rare.select("pair", "n", "best"), "pair").groupBy("row")
    more = more.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_more"), F.sum(F.col("times") * F.col("n")).alias("sum_more"))
    done = done.drop("rare", "times").join(more, "row", "left")
    zero = F.lit(0).cast("long")
    best, total = F.col("n_best") + F.coalesce("best_more", zero), F.col("count_sum") + F.coalesce("sum_more", zero)
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", best.alias("n_best"), total.alias("count_sum"), "groups_sha256"), pairs.drop("pair")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers over every whole text of ``documents``."""
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE), public_tokenizers.PATTERN)[0]


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLE_SQL: dict[str, str] = {}
