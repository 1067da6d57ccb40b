"""Shared helpers: tables, shared scratch tables, bounded samples, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only for a local master that names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillgrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Batches of at most 1000 rows between Spark and its Python workers from now on: rows hold whole texts, some very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


class Scratch:
    """Tables written under the shared folder.

    They cut lineage and survive lost executors; ``drop`` frees the ones that a later step has replaced.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillgrid-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


ID_WORDS = 1 << 17  # of 64 bits: what only_ids broadcasts at most, 8.4 million slots


def only_ids(docs: DataFrame, ids: DataFrame, inside: bool = True, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is in ids (one column of that name), or is not; a null key is in no ids.

    Long rows are not shuffled needlessly: a bit for each id's slot, packed into at most ``ID_WORDS`` rows however many ids
    there are, is broadcast first, and only rows whose bit is set are joined. With far more ids than slots all rows are.
    """
    slot = lambda: F.pmod(F.xxhash64(F.lit("slot"), F.col(key)), F.lit(ID_WORDS * 64))
    mark = "_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    words = ids.select(slot().alias("s")).distinct().groupBy(F.shiftright("s", 6).alias(mark + "word"))
    words = F.broadcast(words.agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias(mark + "bits")))
    rows = docs.withColumn(mark + "slot", slot()).withColumn(mark + "word", F.shiftright(mark + "slot", 6)).join(words, mark + "word", "left")
    hit = F.coalesce(F.expr(f"({mark}bits & shiftleft(1L, cast({mark}slot & 63 as int))) <> 0"), F.lit(False))
    near = rows.where(hit).select(*docs.columns)
    if inside:
        return near.join(ids, key, "left_semi")
    return rows.where(~hit).select(*docs.columns).unionByName(near.join(ids, key, "left_anti"))


def doc_hash_mod(col: str, m: int):
    """crc32 of the id as text, modulo m: the fold rule that the contracts name."""
    return F.crc32(F.col(col).cast("string")) % m


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of the key, so that every run takes the same rows.

    Only classifier fits use it; the bound is one of their documented parameters.
    """
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def connected_components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge (a, b); component is the smallest id reachable.

    Alternates two joins: links every neighbour of a vertex to the smallest one around it, then shortcuts to that
    one's own root. Rounds grow with the logarithm of the longest chain. State stays in shared tables.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("a").alias("other"))
    )
    both = scratch.keep(both.where("id <> other").distinct())
    label = scratch.keep(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")))
    for _ in range(max_rounds):
        near = (
            both.join(label.withColumnsRenamed({"id": "other"}), "other").groupBy("id").agg(F.min("component").alias("near"))
        )
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("root"))
        step = (
            label.join(near, "id")
            .join(jump, "component", "left")
            .select("id", F.least("component", "near", "root").alias("now"), F.col("component").alias("was"))
        )
        # a root whose members have found a smaller one follows them
        hooks = step.where("now < was").groupBy(F.col("was").alias("id")).agg(F.min("now").alias("hook"))
        new = scratch.keep(
            step.join(hooks, "id", "left").select(
                "id", F.least("now", F.coalesce("hook", "now")).alias("component"), F.col("was")
            )
        )
        changed = not new.where("component <> was").isEmpty()
        scratch.drop(label)
        label = new
        if not changed:
            break
    else:
        raise RuntimeError("components have not settled")
    return label.select("id", "component")
