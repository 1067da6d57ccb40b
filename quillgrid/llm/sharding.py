"""K-d tree shards: recursive splits at distributed weighted medians.

Each level splits every node once more, along the metadata dimension that is widest in that node against the whole
table, at the median weighted by bytes, until there are as many leaves as shards (their target is total / shards bytes).
A median is found by histograms: Spark sums the bytes of each node's bins, the driver sees bins only (``BINS`` a node),
and the bin that holds the median is split again until it weighs next to nothing. Ties in the dimension are
ordered by the text's hash, then by id, then by row, so any hot value can be cut and sizes come out near equal. Strings
(source, language) count by the rank of their whole value among the table's distinct ones.

Copies of one text take the same metadata (the least of their group), so they lie together; only the group at a cut is
divided. Slots count up from 0 in each shard: ranks in small buckets of a shard plus the buckets' offsets.

Defined cases: a null text has no bytes and size 1, and crc32 0; null metadata is the empty string; a null id is ordered as
0; equal rows are ordered in any way, each with its own slot; a table with fewer rows than shards leaves shards empty; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.llm.common import Scratch, table

BINS = 1024
CLOSE = 2e-4  # a median's bin may weigh this share of its node
SLOT_ROWS = 20_000  # rows of a slot bucket, about


STRINGS = ["source", "lang"]
DIMENSIONS = ["size", *STRINGS]
KEYS = ["text_hash", "key_id", "row"]  # what orders a tie, in turn


def _ranks(scratch: Scratch, rows: DataFrame, name: str) -> DataFrame:
    """(name, d_name): the distinct values in order, counted from 0.

    Sorted by ranges; the driver sees one count a partition.
    """
    values = rows.select(name).distinct().repartitionByRange(name).sortWithinPartitions(name)
    values = scratch.keep(values.withColumn("at", F.monotonically_increasing_id()))  # partition and place in it
    counts = {r["part"]: r["n"] for r in values.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    start = F.create_map(*(F.lit(x) for pair in offsets for x in pair))[F.shiftright("at", 33)] if offsets else F.lit(0)
    return scratch.keep(values.select(name, (start + F.col("at").bitwiseAND(F.lit(2**33 - 1))).cast("long").alias(f"d_{name}")))


@dataclass
class _Search:
    """The median of one node so far: fixed leading keys, and the range of the next one."""

    need: float  # bytes of the node that are to go left
    total: float
    dimension: str
    fixed: list[int] = field(default_factory=list)
    low: int = 0
    high: int = 0
    before: float = 0.0  # bytes left of the range
    cut: list[int] | None = None  # keys up to these go left

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BINS))  # at most 2^54


def _of_nodes(rows: DataFrame, columns: list[str], values: list[tuple[int | None, ...]]) -> DataFrame:
    """Rows with what holds for their node; there are fewer nodes than shards, so the table is tiny."""
    each = F.array(*(F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(columns, x, strict=True))) for x in values))
    return rows.join(F.broadcast(rows.sparkSession.range(1).select(F.inline(each))), "node")


def _dimension(dims: list[str]) -> Column:
    return F.element_at(F.array(*dims), F.col("dim").cast("int"))


def _medians(rows: DataFrame, dims: list[str], searches: dict[int, _Search]) -> None:
    """Narrows every node's range, all nodes in one job a round, until each has its cut."""
    while open_ := {n: s for n, s in searches.items() if s.cut is None}:
        values = [(n, dims.index(s.dimension) + 1, len(s.fixed), *(s.fixed + [0, 0, 0])[:3], s.low, s.high, s.width) for n, s in open_.items()]
        now = _of_nodes(rows, ["node", "dim", "depth", "f0", "f1", "f2", "low", "high", "width"], values)
        now = now.withColumn("v", _dimension(dims)).withColumn("key", F.element_at(F.array("v", *KEYS), F.col("depth").cast("int") + 1))
        now = now.where("(depth = 0 or v = f0) and (depth < 2 or text_hash = f1) and (depth < 3 or key_id = f2) and key between low and high")
        # ids can lie further apart than a long holds, so both ends are divided first
        sums = now.groupBy("node", F.expr("key div width - low div width").alias("bin")).agg(F.sum("size").alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most"))
        bins: dict[int, list] = {}
        for r in sums.collect():  # at most BINS rows a node
            bins.setdefault(r["node"], []).append((r["least"], r["most"], r["bytes"]))
        for n, s in open_.items():
            _narrow(s, sorted(bins[n]))


def _narrow(s: _Search, bins: list[tuple[int, int, int]]) -> None:
    """Goes into the bin that holds the median; where that is light or one value of the last key, cuts beside it."""
    at = 0
    while at < len(bins) - 1 and s.before + bins[at][2] < s.need:
        s.before += bins[at][2]
        at += 1
    least, most, size = bins[at]
    if least == most and len(s.fixed) < len(KEYS) and size > CLOSE * s.total:
        s.fixed.append(least)  # a tie: the next key orders it
        s.low, s.high = -(2**63), 2**63 - 1
    elif least == most or size <= CLOSE * s.total:
        nearer_with = s.before + size - s.need <= s.need - s.before
        s.cut = [*s.fixed, most if nearer_with or at == 0 else bins[at - 1][1]]
    else:
        s.low, s.high = least, most


def _split(rows: DataFrame, dims: list[str], searches: dict[int, _Search]) -> DataFrame:
    """Every node's rows to its two children: keys up to the cut go left, in lexicographic order."""
    values = [(n, dims.index(s.dimension) + 1, *(s.cut + [None] * 3)[:4]) for n, s in searches.items()]
    now = _of_nodes(rows, ["node", "dim", "c0", "c1", "c2", "c3"], values).withColumn("v", _dimension(dims))
    third = "key_id < c2 or key_id = c2 and (c3 is null or row <= c3)"
    left = f"v < c0 or v = c0 and (c1 is null or text_hash < c1 or text_hash = c1 and (c2 is null or {third}))"
    return now.withColumn("node", F.expr(f"node * 2 + if({left}, 0, 1)")).drop("dim", "c0", "c1", "c2", "c3", "v")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs (doc_id, text, source, lang). shards: a power of two."""
    if shards & (shards - 1):
        raise ValueError("shards: a power of two")
    scratch = Scratch(docs.sparkSession)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data) + F.lit(1)).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(data), 1).alias("text_hash"),
        *(F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in STRINGS),
        F.monotonically_increasing_id().alias("row"),
    )
    slim = scratch.keep(slim.withColumns({"key_id": F.coalesce("doc_id", F.lit(0)), "d_size": F.round(F.log2("size") * 1e6).cast("long")}))
    dims = [f"d_{n}" for n in DIMENSIONS]
    ranked = slim
    for n in STRINGS:
        ranked = ranked.join(_ranks(scratch, slim, n), n)
    # both sides are written, so that the join on a text with very many copies is a skewed join that Spark splits
    ranked = scratch.keep(ranked.drop(*STRINGS))
    groups = scratch.keep(ranked.groupBy("text_hash").agg(*(F.min(d).alias(d) for d in dims)))
    rows = scratch.keep(ranked.drop(*dims).join(groups, "text_hash").withColumn("node", F.lit(1).cast("long")))
    scratch.drop(slim)
    whole: dict[str, int] | None = None
    current = rows
    for _ in range(shards.bit_length() - 1):
        ends = [f(d).alias(f"{name}_{d}") for d in dims for name, f in (("low", F.min), ("high", F.max))]
        nodes = {r["node"]: r for r in current.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}
        if not nodes:
            break
        spread = lambda r, d: r[f"high_{d}"] - r[f"low_{d}"]
        if whole is None:
            whole = {d: max(1, spread(nodes[1], d)) for d in dims}
        searches = {}
        for n, r in nodes.items():
            d = max(dims, key=lambda d: (spread(r, d) / whole[d], -dims.index(d)))
            searches[n] = _Search(r["bytes"] / 2, r["bytes"], d, low=r[f"low_{d}"], high=r[f"high_{d}"])
        _medians(current, dims, searches)
        current = _split(current, dims, searches)
    out = current.withColumn("shard", (F.col("node") - F.lit(shards)).cast("int"))
    buckets = max(1, -(-rows.count() // (shards * SLOT_ROWS)))
    out = scratch.keep(out.select("doc_id", "size", "text_crc32", "text_hash", "shard", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket")))
    scratch.drop(rows)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = out.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = out.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("text_hash", "doc_id")) - 1)
    return placed.join(offsets, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 of near equal bytes."""
    out = shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_kd_shards": op7_kd_shards}
ORACLE_SQL: dict[str, str] = {}
