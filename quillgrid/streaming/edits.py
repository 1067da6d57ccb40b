"""Edits as a stream: windowed counts of edits, and recalculation of what each micro-batch of edits reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgrid.operators.recalc import recalculate


def edit_rates(edits: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, scenario, n) by tumbling window of edit time ``ts``; edits later than the watermark are left out."""
    counts = edits.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "scenario").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "scenario", "n")


def sliding_rates(edits: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, scenario, n) by windows that overlap."""
    counts = edits.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "scenario").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "scenario", "n")


def sessions(edits: DataFrame, gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, end, scenario, n): runs of edits of a scenario that no pause longer than ``gap`` divides."""
    counts = edits.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "scenario").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "scenario", "n")


def recalculate_stream(edits: DataFrame, cells: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of edits (scenario, id, num, ts) is recalculated; its changes are written under its batch number.

    The last edit of a cell in a batch wins. A batch that runs again after a failure replaces its own folder.
    """

    def batch(rows: DataFrame, number: int) -> None:
        last = rows.groupBy("scenario", "id").agg(F.max_by("num", "ts").alias("num"))
        recalculate(cells, last).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return edits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
