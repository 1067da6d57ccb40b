"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search on it.

Equal vectors are one node; a node keeps its ``top + 1`` smallest ids, which are all that a list of ``top`` can need.

Graph: nodes start with the nearest of random hyperplane blocks of bounded size. In each round Spark joins edges
with edges: a node's neighbours, and those that have it as a neighbour, meet at that node (neighbours of neighbours), and
pairs that are new to each other are compared. A node keeps its ``degree`` nearest. It stops when a round changes
few edges. Of a hub's many reverse edges a random share takes part (the method's own sampling); nodes are never dropped.
Vectors travel as 8-bit codes there; the result's distances are of the original vectors in double precision.

Search: each query starts from its own node's graph list and from the nearest entry nodes. ``ENTRIES`` of these are broadcast;
where there are more than ``SPACING`` nodes to each, every ``SPACING``-th node is a second level under its nearest one, and a
query also starts from those under its ``CELLS`` nearest (at most ``ENTRIES`` under each, by a hash). Then it expands its best unexpanded nodes, all queries at once, a few joins a round, until its ``beam`` holds none.

Defined cases: null or zero vectors, and ones with null or non-finite components, take no part, nor do vectors that
differ from the most common length (ties: the larger); ties in distance go to the smaller id; an id is one candidate and one
query, and of several vectors that could take part it has the least (component by component); with fewer candidates than ``top`` all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.llm.common import Scratch, table

DEGREE = 32
REVERSE = 32  # reverse edges of a node that take part in a round, about
BEAM = 400
EXPAND = 80
ENTRIES = 512
SPACING = 64  # nodes for each entry node
CELLS = 4
BLOCK = 64  # nodes of a first block, about
SEED = 20240
HEAD = 8  # bytes before a code's components: scale and squared length


def encode(x: np.ndarray) -> list[bytes]:
    """8-bit codes: scale, squared length of the coded vector, components."""
    scale = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    q = np.rint(x / scale[:, None]).astype(np.int8)
    length = ((q.astype(np.float64) ** 2).sum(axis=1) * scale.astype(np.float64) ** 2).astype(np.float32)
    head = np.column_stack([scale, length]).astype("<f4").view(np.uint8).reshape(len(x), HEAD)
    both = np.concatenate([head, q.view(np.uint8)], axis=1)
    return [r.tobytes() for r in both]


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scales, squared lengths and components of a column of codes."""
    if not len(column):
        return np.zeros(0, np.float32), np.zeros(0, np.float32), np.zeros((0, 1), np.float32)
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    head = np.ascontiguousarray(raw[:, :HEAD]).view("<f4")
    return head[:, 0].copy(), head[:, 1].copy(), raw[:, HEAD:].view(np.int8).astype(np.float32)


def _squared(a: tuple, b: tuple) -> np.ndarray:
    """Squared distances between codes, rows by columns; the products are of whole numbers, so the order doesn't matter."""
    return np.maximum(0, a[1][:, None] + b[1][None, :] - 2 * (a[0][:, None] * b[0][None, :]) * (a[2] @ b[2].T))


def nodes_of(rows: DataFrame, top: int, is_query) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, vec) for distinct vectors, node the least id; (node, id) with the top + 1 smallest ids; (id, query) of queries.

    rows: id, vec (array).
    """
    vec = F.col("vec").cast("array<double>")
    good = rows.select(F.col("id").cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull()
        & F.col("vec").isNotNull()
        & (F.size("vec") > 0)
        & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists("vec", lambda v: v != 0)
    )
    sizes = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    good = good.where(F.size("vec") == (sizes[0]["n"] if sizes else 0)).groupBy("id").agg(F.min("vec").alias("vec"))
    keyed = good.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})
    least = keyed.groupBy("k1", "k2").agg(F.min("id").alias("node"))
    order = Window.partitionBy("k1", "k2").orderBy("id")
    few = keyed.select("k1", "k2", "id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1)
    members = few.join(least, ["k1", "k2"]).select("node", "id")
    nodes = keyed.join(least.withColumnRenamed("node", "id"), ["k1", "k2", "id"]).select(F.col("id").alias("node"), "vec")
    asked = keyed.where(is_query).select("id", "k1", "k2").join(least, ["k1", "k2"]).select("id", F.col("node").alias("query"))
    return nodes, members, asked


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes, and the block that random hyperplanes give each vector, at three sizes of block codes."""
    for batch in batches:
        n = batch.num_rows
        x = np.array(batch.column("vec").flatten()).reshape(n, -1) if n else np.zeros((0, 1))
        planes = np.random.default_rng(SEED).standard_normal((x.shape[1], 62))
        bits = (x @ planes > 0).astype(np.int64)
        sign = (bits << np.arange(62)).sum(axis=1) if n else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(encode(x) if n else [], pa.binary()), pa.array(sign, pa.int64())], ["node", "code", "sign"])


def _compare(degree: int):
    """Local joins: each row has a group's members (node, new, limit, code); pairs with a new one are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = batch.column("members")
                ends = np.concatenate([[0], np.cumsum(np.array(lists.value_lengths()))]).astype(int)
                flat = lists.flatten()
                node, new, limit = (np.array(flat.field(f)) for f in ("node", "new", "limit"))
                codes = _codes(flat.field("code"))
                out: list[tuple] = []
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    part = tuple(c[a:b] for c in codes)
                    d = _squared(part, part)
                    ids, fresh = node[a:b], new[a:b]
                    d[(ids[:, None] == ids[None, :]) | ~(fresh[:, None] | fresh[None, :])] = np.inf
                    if b - a > degree:
                        d[d > np.partition(d, degree - 1, axis=1)[:, degree - 1 : degree]] = np.inf
                    i, j = np.nonzero(d < limit[a:b][:, None])
                    out.append((ids[i], ids[j], d[i, j]))
                i, j, d = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(d.astype(np.float32), pa.float32())], ["node", "other", "d"])

    return run


PAIR = "node long, other long, d float"
FAR = float(np.finfo(np.float32).max)


def _merge(graph: DataFrame, found: DataFrame, degree: int) -> DataFrame:
    """The graph with each node's nearest of what it had and what was found; new: what it did not have."""
    some = found.distinct().groupBy("node").agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("found"))
    some = some.withColumn("found", F.slice("found", 1, degree))
    both = graph.join(some, "node", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<d:float,other:bigint>>")))
    both = both.withColumn("near", F.slice(F.array_sort(F.array_distinct(F.concat("old", "found"))), 1, degree))
    flagged = F.transform("near", lambda x: F.struct(x["d"].alias("d"), x["other"].alias("other"), (~F.array_contains(F.col("old"), x)).alias("new")))
    return both.select("node", F.col("near").alias("old"), flagged.alias("flagged"))


def build_graph(nodes: DataFrame, degree: int = DEGREE, max_rounds: int = 12, change: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(node, code) and (node, old: nearest (d, other) in order). nodes: node, vec; written anew, so it may be any plan."""
    scratch = Scratch(nodes.sparkSession)
    coded = scratch.keep(nodes.mapInArrow(_coded, "node long, code binary, sign long"))
    codes = coded.select("node", "code")
    n = coded.count()
    far = F.lit(FAR).cast("float")
    member = F.struct("node", F.lit(True).alias("new"), far.alias("limit"), "code")
    found = None
    bits = max(0, int(np.ceil(np.log2(max(1, n / BLOCK)))))
    for turn in range(3):  # three sets of blocks; a full one is cut by a hash
        mask = ((1 << bits) - 1) << (turn * bits % max(1, 62 - bits))
        block = coded.withColumn("block", F.col("sign").bitwiseAND(F.lit(mask)))
        sizes = block.groupBy("block").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("cuts"))
        block = block.join(sizes, "block").withColumn("cut", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("cuts")))
        near = block.groupBy("block", "cut").agg(F.collect_list(member).alias("members")).select("members").mapInArrow(_compare(degree), PAIR)
        found = near if found is None else found.unionByName(near)
    empty = codes.select("node", F.array().cast("array<struct<d:float,other:bigint>>").alias("old"))
    graph = scratch.keep(_merge(empty, found, degree))
    for turn in range(max_rounds):
        limit = F.when(F.size("old") >= degree, F.element_at("old", -1)["d"]).otherwise(far)
        limits = graph.select("node", limit.alias("limit"))
        edges = graph.select("node", F.explode("flagged").alias("e")).select("node", F.col("e.other").alias("other"), F.col("e.new").alias("new"))
        reverse_of = edges.groupBy("other").agg(F.count("*").alias("in"))
        share = F.pmod(F.xxhash64("node", "other", F.lit(turn)), F.lit(1_000_000)) < F.lit(1_000_000 * REVERSE) / F.col("in")
        back = edges.join(reverse_of, "other").where(share).select(F.col("other").alias("pivot"), "node", "new")
        meet = edges.select(F.col("node").alias("pivot"), F.col("other").alias("node"), "new").unionByName(back)
        meet = meet.unionByName(codes.select(F.col("node").alias("pivot"), "node", F.lit(False).alias("new")))
        full = meet.join(codes.join(limits, "node"), "node")
        groups = full.groupBy("pivot").agg(F.collect_list(F.struct("node", "new", "limit", "code")).alias("members"))
        groups = groups.where(F.exists("members", lambda m: m["new"])).select("members")
        old = graph
        graph = scratch.keep(_merge(graph.select("node", "old"), groups.mapInArrow(_compare(degree), PAIR), degree))
        scratch.drop(old)
        new = graph.agg(F.sum(F.size(F.filter("flagged", lambda e: e["new"])))).first()[0] or 0
        if new <= change * n * degree:
            break
    else:
        warnings.warn(f"the graph still changed after {max_rounds} rounds: {new} of {n * degree} edges were new", stacklevel=2)
    return codes, graph.select("node", "old")


def _start(entries):
    """Each query's graph list and nearest entry nodes: (query, code, beam, seen)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, all_codes = entries.value
        table_codes = _codes(pa.array(all_codes, pa.binary()))
        for batch in batches:
            d = _squared(_codes(batch.column("code")), table_codes) if batch.num_rows else np.zeros((0, 0))
            best = np.argsort(d, axis=1, kind="stable")[:, :EXPAND]
            beam = [[{"d": float(r[j]), "node": int(ids[j]), "open": True} for j in b] for r, b in zip(d, best, strict=True)]
            for held, near in zip(beam, batch.column("old").to_pylist(), strict=True):
                has = {e["node"] for e in held}
                held += [{"d": e["d"], "node": e["other"], "open": True} for e in near or [] if e["other"] not in has]
                held.sort(key=lambda e: (e["d"], e["node"]))
            seen = [[e["node"] for e in held] for held in beam]
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("code"), pa.array(beam, BEAM_TYPE), pa.array(seen, pa.list_(pa.int64()))], ["query", "code", "beam", "seen"])

    return run


def _cells(entries, most: int):
    """(node, code, cells): the nearest of the entry nodes, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_codes = _codes(pa.array(entries.value[1], pa.binary()))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                best = np.argsort(_squared(_codes(part.column("code")), table_codes), axis=1, kind="stable")[:, :most]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("code"), pa.array(best.tolist(), pa.list_(pa.int32()))], ["node", "code", "cells"])

    return run


BEAM_TYPE = pa.list_(pa.struct([("d", pa.float32()), ("node", pa.int64()), ("open", pa.bool_())]))
STATE = "query long, code binary, beam array<struct<d: float, node: bigint, open: boolean>>, seen array<bigint>"


def _advance(beam: int, expand: int = EXPAND):
    """Closes the nodes that were expanded, adds the candidates to the beam."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _codes(batch.column("code"))
            beams, seens = [], []
            rows = zip(batch.column("beam").to_pylist(), batch.column("seen").to_pylist(), batch.column("cands"), strict=True)
            for i, (held, seen, cands) in enumerate(rows):
                opened = 0
                for e in held:
                    if e["open"] and opened < expand:
                        e["open"] = False
                        opened += 1
                c = cands.values
                if c is not None and len(c):
                    node = np.array(c.field("node"))
                    d = _squared(tuple(o[i : i + 1] for o in own), _codes(c.field("code")))[0]
                    held += [{"d": float(x), "node": int(v), "open": True} for x, v in zip(d, node, strict=True)]
                    seen = seen + node.tolist()
                held.sort(key=lambda e: (e["d"], e["node"]))
                beams.append(held[:beam])
                seens.append(seen)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("code"), pa.array(beams, BEAM_TYPE), pa.array(seens, pa.list_(pa.int64()))], ["query", "code", "beam", "seen"])

    return run


def search(queries: DataFrame, codes: DataFrame, graph: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, node): what greedy search from its graph list and the entry nodes holds in its beam. queries: query, code.

    It goes on until no beam holds a node that has not been expanded; each round expands some of every open beam.
    """
    spark = queries.sparkSession
    scratch = Scratch(spark)
    links = graph.select("node", F.explode("old.other").alias("other"))
    into = links.groupBy("other").agg(F.count("*").alias("in"))
    share = F.pmod(F.xxhash64("node", "other"), F.lit(1_000_000)) < F.lit(1_000_000 * REVERSE) / F.col("in")
    back = links.join(into, "other").where(share).select(F.col("other").alias("node"), F.col("node").alias("other"))
    around = scratch.keep(links.unionByName(back).groupBy("node").agg(F.collect_set("other").alias("others")))
    first = codes.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).collect()
    if not first:
        return spark.createDataFrame([], "query long, node long")
    entries = spark.sparkContext.broadcast(([r["node"] for r in first], [bytes(r["code"]) for r in first]))
    starts = queries.select("query", "code").join(graph.select(F.col("node").alias("query"), "old"), "query", "left")
    state = scratch.keep(starts.mapInArrow(_start(entries), STATE))
    if codes.count() > SPACING * ENTRIES:
        of_cell = "node long, code binary, cells array<int>"
        below = codes.where(F.pmod(F.xxhash64("node", F.lit("entry")), F.lit(SPACING)) == 0).mapInArrow(_cells(entries, 1), of_cell)
        below = below.select("node", "code", F.col("cells")[0].alias("cell"))
        place = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("node"), "node"))
        below = scratch.keep(below.withColumn("place", place).where(F.col("place") <= ENTRIES))
        cells = queries.select(F.col("query").alias("node"), "code").mapInArrow(_cells(entries, CELLS), of_cell)
        more = cells.select(F.col("node").alias("query"), F.explode("cells").alias("cell")).join(below, "cell").join(state.select("query", "seen"), "query")
        more = more.where(~F.array_contains("seen", F.col("node"))).groupBy("query").agg(F.collect_list(F.struct("node", "code")).alias("cands"))
        state = scratch.keep(state.join(more, "query", "left").select("query", "code", "beam", "seen", "cands").mapInArrow(_advance(beam, 0), STATE))
    while True:
        open_ = F.slice(F.filter("beam", lambda e: e["open"]), 1, EXPAND)
        frontier = state.select("query", F.explode(F.transform(open_, lambda e: e["node"])).alias("node"))
        reached = frontier.join(around, "node").select("query", F.explode("others").alias("node")).distinct()
        fresh = reached.groupBy("query").agg(F.collect_list("node").alias("c")).join(state.select("query", "seen"), "query")
        fresh = fresh.select("query", F.explode(F.array_except("c", "seen")).alias("node")).join(codes, "node")
        cands = fresh.groupBy("query").agg(F.collect_list(F.struct("node", "code")).alias("cands"))
        done = state
        state = scratch.keep(state.join(cands, "query", "left").select("query", "code", "beam", "seen", "cands").mapInArrow(_advance(beam), STATE))
        scratch.drop(done)
        if state.where(F.exists("beam", lambda e: e["open"])).isEmpty():
            break
    return state.select("query", F.explode("beam.node").alias("node"))


def nearest(rows: DataFrame, is_query, top: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query row, itself left out. rows: id, vec."""
    scratch = Scratch(rows.sparkSession)
    nodes, members, asked = (scratch.keep(x) for x in nodes_of(rows, top, is_query))
    codes, graph = build_graph(nodes)
    starts = codes.join(asked.select(F.col("query").alias("node")).distinct(), "node").select(F.col("node").alias("query"), "code")
    found = search(starts, codes, graph)
    found = found.unionByName(starts.select("query", F.col("query").alias("node"))).distinct()
    pairs = found.join(nodes, "node").join(nodes.select(F.col("node").alias("query"), F.col("vec").alias("query_vec")), "query")
    square = F.aggregate(F.zip_with("vec", "query_vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    close = pairs.select("query", "node", F.sqrt(square).alias("score"))
    # each nearer node holds a nearer candidate, but for the query itself: top + 1 nodes are enough
    order = Window.partitionBy("query").orderBy("score", "node")
    close = close.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top + 1).drop("r")
    each = asked.withColumnRenamed("id", "query_id").join(close, "query").join(members.withColumnRenamed("id", "vec_id"), "node").where("query_id <> vec_id")
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return nearest(rows, F.col("id") % 100 == 0, 10)


QUERIES = {"op1_ann_search": op1_ann_search}
ORACLE_SQL: dict[str, str] = {}
