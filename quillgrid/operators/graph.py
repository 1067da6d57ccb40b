"""Traversal of dependency edges (dependent, precedent): closures, levels, cycles, paths, neighbourhoods.

All are frontier loops over DataFrames: a round's join costs the frontier's edges. Long loops cut their lineage by tables
written by columns in spark.checkpoint.dir: a checkpoint's rows take several times their disk. Loops end when nothing is left to do; only a caller's max_depth
cuts a result, and a caller's max_rounds that runs out raises an error.
"""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quillgrid-"))  # a local master: tests
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, written once by columns where all executors find them."""
    path = f"{folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rounds(most: int | None, what: str):
    """Numbers of rounds without end; an error if the caller's bound runs out."""
    for n in count():
        if n == most:
            raise RuntimeError(f"{what}: not finished after {most} rounds")
        yield n


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, both_ways: bool = False) -> DataFrame:
    """(id, depth) of what the seeds reach along (src, dst); seeds have depth 0. seeds: id."""
    steps = edges.select("src", "dst")
    if both_ways:
        steps = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        new = frontier.join(steps, frontier["id"] == steps["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(new.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier) if depth % 4 else cut(seen.unionByName(frontier))
    return seen


def downstream(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """What depends on the seeds, seeds among it. edges: dependent, precedent."""
    return reach(edges.select(F.col("precedent").alias("src"), F.col("dependent").alias("dst")), seeds, max_depth)


def levels(edges: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, level) with precedents first, and (id) of what lies on or behind a cycle and so has no level."""
    edges = edges.select("dependent", "precedent").distinct()
    left = cut(edges.select(F.col("dependent").alias("id")).unionByName(edges.select(F.col("precedent").alias("id"))).distinct())
    open_edges, done = edges, None
    for level in _rounds(max_rounds, "levels"):
        waiting = open_edges.select(F.col("dependent").alias("id")).distinct()
        free = cut(left.join(waiting, "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        if level % 16 == 15:
            done = cut(done)
        left = cut(left.join(free, "id", "left_anti"))
        open_edges = cut(open_edges.join(free.select(F.col("id").alias("precedent")), "precedent", "left_anti"))
    if done is None:
        done = left.limit(0).withColumn("level", F.lit(0))
    return done, left


def cyclic_core(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(dependent, precedent): edges between cells that are neither before nor behind every cycle: peeled from both ends."""
    left = cut(edges.select("dependent", "precedent").distinct())
    for _ in _rounds(max_rounds, "cyclic_core"):
        has_out = left.select(F.col("dependent").alias("precedent")).distinct()
        has_in = left.select(F.col("precedent").alias("dependent")).distinct()
        n = left.count()
        left = cut(left.join(has_out, "precedent", "left_semi").join(has_in, "dependent", "left_semi"))
        if left.count() == n:
            return left


def strongly_connected(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, component) for cells on cycles; component is the least id of the cycle's cells.

    Each round colours what each smallest remaining id reaches, forwards and backwards, and takes the intersection away.
    """
    left, out = cyclic_core(edges), None
    for _ in _rounds(max_rounds, "strongly_connected"):
        if left.isEmpty():
            break
        ids = left.select(F.col("dependent").alias("id")).unionByName(left.select(F.col("precedent").alias("id"))).distinct()
        forward = _least_label(left.select(F.col("dependent").alias("src"), F.col("precedent").alias("dst")), ids)
        # inside one colour, what reaches the colour's root belongs to the root's component
        roots = forward.where("id = label").select("id", "label")
        same = left.join(forward.select(F.col("id").alias("dependent"), F.col("label").alias("a")), "dependent").join(forward.select(F.col("id").alias("precedent"), F.col("label").alias("b")), "precedent").where("a = b")
        back = reach(same.select(F.col("precedent").alias("src"), F.col("dependent").alias("dst")), roots.select("id")).select("id")
        found = cut(forward.join(back, "id", "left_semi").select("id", F.col("label").alias("component")))
        out = found if out is None else out.unionByName(found)
        gone = found.select("id")
        left = left.join(gone.withColumnRenamed("id", "dependent"), "dependent", "left_anti").join(gone.withColumnRenamed("id", "precedent"), "precedent", "left_anti")
        left = cyclic_core(left)
    if out is None:
        return left.select(F.col("dependent").alias("id"), F.col("precedent").alias("component"))
    size = out.groupBy("component").count().where("count > 1").select("component")
    loops = edges.where("dependent = precedent").select(F.col("dependent").alias("id")).distinct()
    return out.join(size, "component", "left_semi").unionByName(out.join(size, "component", "left_anti").join(loops, "id", "left_semi"), allowMissingColumns=True).select("id", "component")


def _least_label(steps: DataFrame, ids: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, label): the least id that reaches it, itself included."""
    label = cut(ids.withColumn("label", F.col("id")))
    for _ in _rounds(max_rounds, "least label"):
        got = label.join(steps, label["id"] == steps["src"]).groupBy("dst").agg(F.min("label").alias("offer"))
        new = label.join(got.withColumnRenamed("dst", "id"), "id", "left").select("id", F.least("label", F.coalesce("offer", "label")).alias("label"), F.col("label").alias("was"))
        new = cut(new)
        if new.where("label <> was").isEmpty():
            return new.select("id", "label")
        label = new.select("id", "label")


def shortest_path(edges: DataFrame, start, end, max_depth: int | None = None) -> DataFrame:
    """(depth, path): one shortest path along (src, dst), the first as ids joined by ``>``; no row if there is none.

    Ids hold no ``>``, so of paths of one length to a node the first one begins the first path beyond it.
    """
    steps = edges.select("src", "dst").distinct()
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    paths = cut(spark.range(1).select(F.lit(start).cast(kind).alias("id"), F.array(F.lit(start).cast(kind)).alias("path")))
    seen = paths.select("id")
    for depth in count():
        hit = paths.where(F.col("id") == F.lit(end)).select(F.lit(depth).alias("depth"), "path")
        if depth == max_depth or paths.isEmpty() or not hit.isEmpty():
            return hit
        name = F.concat(F.array_join(F.transform("path", lambda x: x.cast("string")), ">"), F.lit(">"))  # s10> is before s1>
        new = paths.join(steps, paths["id"] == steps["src"]).groupBy(F.col("dst").alias("id")).agg(F.min_by("path", name).alias("path"))
        paths = cut(new.join(seen, "id", "left_anti").select("id", F.array_append("path", F.col("id")).alias("path")))
        seen = seen.unionByName(paths.select("id"))
        if depth % 4 == 3:
            seen = cut(seen)


def lift_edges(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Edges between owners (line items, tables) from edges between their cells; distinct, no loops. owner: id, owner."""
    a = owner.select(F.col("id").alias("dependent"), F.col("owner").alias("dependent_owner"))
    b = owner.select(F.col("id").alias("precedent"), F.col("owner").alias("precedent_owner"))
    return edges.join(a, "dependent").join(b, "precedent").where("dependent_owner <> precedent_owner").select("dependent_owner", "precedent_owner").distinct()


def ghosts(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(id) of endpoints outside a set whose other end is inside. inside: id."""
    ends = edges.join(inside.withColumnRenamed("id", "dependent"), "dependent", "left_semi").select(F.col("precedent").alias("id"))
    ends = ends.unionByName(edges.join(inside.withColumnRenamed("id", "precedent"), "precedent", "left_semi").select(F.col("dependent").alias("id")))
    return ends.distinct().join(inside, "id", "left_anti")


def connected(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, label): the least id of its component, along (src, dst) both ways; ids without edges label themselves.

    Each round hands the label of a neighbour's label to a node and to the node's label, so that rounds grow with the logarithm
    of the longest path and not with the path.
    """
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    now = cut(ids.select("id").distinct().withColumn("label", F.col("id")))
    for _ in _rounds(None, "connected"):
        above = now.select(F.col("id").alias("label"), F.col("label").alias("far"))
        seen = cut(now.join(above, "label"))
        near = both.join(seen.select(F.col("id").alias("dst"), "far"), "dst").groupBy("src").agg(F.min("far").alias("offer"))
        offers = near.join(seen.select(F.col("id").alias("src"), "label"), "src")
        every = offers.select(F.col("src").alias("id"), "offer").unionByName(offers.select(F.col("label").alias("id"), "offer")).unionByName(seen.select("id", F.col("far").alias("offer")))
        least = every.groupBy("id").agg(F.min("offer").alias("offer"))
        new = cut(now.join(least, "id").select("id", F.least("label", "offer").alias("label"), (F.col("offer") < F.col("label")).alias("moved")))
        done = new.where("moved").isEmpty()
        now = new.select("id", "label")
        if done:
            return now
