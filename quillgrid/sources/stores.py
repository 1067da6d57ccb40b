"""Stores: graph files in JSON, snapshots, and registry tables that are appended to, listed, updated and deleted by task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

CELL = "struct<id:string,sheet:string,row:int,col:string,value:string,formula_raw:string,data_type:string,is_header:boolean,is_merged:boolean,merge_parent_id:string,number_format:string,dependencies:array<string>,dependents:array<string>,indicator_id:string,table_id:string,time_period:string>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, edges (dependent, precedent)) of cells.json files."""
    files = spark.read.schema(f"cells array<{CELL}>, dependencies array<struct<`from`:string,`to`:string>>").option("multiLine", True).json(path)
    cells = files.select(F.explode("cells").alias("c")).select("c.*").withColumn("num", F.expr("try_cast(value as double)"))
    edges = files.select(F.explode("dependencies").alias("d")).select(F.col("d.from").alias("dependent"), F.col("d.to").alias("precedent"))
    return cells, edges


def write_graph(cells: DataFrame, edges: DataFrame, path: str, task_id: str) -> None:
    """Cells and edges as lines of JSON, a folder a task."""
    cells.withColumn("task_id", F.lit(task_id)).write.mode("overwrite").partitionBy("task_id").option("partitionOverwriteMode", "dynamic").json(f"{path}/cells")
    edges.withColumn("task_id", F.lit(task_id)).write.mode("overwrite").partitionBy("task_id").option("partitionOverwriteMode", "dynamic").json(f"{path}/edges")


def write_snapshot(values: DataFrame, path: str, task_id: str, name: str) -> None:
    """Rows (id, num, txt) as a partition of the snapshot table; the same name is replaced."""
    rows = values.select("id", "num", "txt", F.lit(task_id).alias("task_id"), F.lit(name).alias("snapshot"))
    rows.write.mode("overwrite").partitionBy("task_id", "snapshot").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_snapshot(spark: SparkSession, path: str, task_id: str, name: str) -> DataFrame:
    """The filter prunes all other partitions."""
    return spark.read.parquet(path).where((F.col("task_id") == task_id) & (F.col("snapshot") == name)).select("id", "num", "txt")


def append(rows: DataFrame, path: str) -> None:
    """Adds records (task_id, saved_at, ...) to a registry table; records are never changed in place."""
    rows.write.mode("append").partitionBy("task_id").parquet(path)


def latest(records: DataFrame, keys: list[str], deleted: Column | None = None) -> DataFrame:
    """The newest record of each key: updates and upserts are later records, a deletion is one that says so."""
    order = Window.partitionBy(*keys).orderBy(F.desc("saved_at"))
    out = records.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
    return out if deleted is None else out.where(~F.coalesce(deleted, F.lit(False)))


def newest(records: DataFrame, task_id: str | None = None, limit: int | None = None) -> DataFrame:
    """A task's records, newest first."""
    out = records if task_id is None else records.where(F.col("task_id") == task_id)
    out = out.orderBy(F.desc("saved_at"))
    return out if limit is None else out.limit(limit)


def task_stats(layers: dict[str, DataFrame]) -> DataFrame:
    """(task_id, layer, n) over tables that carry task_id."""
    out = None
    for name, df in layers.items():
        n = df.groupBy("task_id").agg(F.count("*").alias("n")).select("task_id", F.lit(name).alias("layer"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def repeated_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Keys that break uniqueness, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
