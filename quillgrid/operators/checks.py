"""Checks of a grid's structure: date rows that mix formulas and constants, ranges that end too early, gaps; and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SEVERITIES = ["critical", "warning", "info"]


def mixed_rows(cells: DataFrame) -> DataFrame:
    """(sheet, row, static, formulas, first, last): rows that begin with a formula and hold constants too.

    cells: sheet, row, col (number), num, formula; label columns left out before.
    """
    formula = F.col("formula").isNotNull()
    rows = cells.where(formula | F.col("num").isNotNull()).groupBy("sheet", "row").agg(
        F.count(F.when(~formula, 1)).alias("static"), F.count(F.when(formula, 1)).alias("formulas"),
        F.min(F.when(formula, F.col("col"))).alias("first"), F.max(F.when(formula, F.col("col"))).alias("last"), F.min("col").alias("left"),
    )
    return rows.where((F.col("static") > 0) & (F.col("formulas") > 0) & (F.col("first") <= F.col("left") + 1)).drop("left")


def gaps(cells: DataFrame, least: int = 2) -> DataFrame:
    """(sheet, row, static): rows with at least ``least`` constants between their first and last formula column."""
    row = Window.partitionBy("sheet", "row")
    at = F.when(F.col("formula").isNotNull(), F.col("col"))
    marked = cells.withColumns({"first": F.min(at).over(row), "last": F.max(at).over(row)})
    inside = marked.where(F.col("formula").isNull() & F.col("num").isNotNull() & (F.col("col") > F.col("first")) & (F.col("col") < F.col("last")))
    return inside.groupBy("sheet", "row").agg(F.count("*").alias("static")).where(F.col("static") >= least)


def short_ranges(blocks: DataFrame) -> DataFrame:
    """Blocks whose range ends in another column than their data. blocks: sheet, row, formula, data_end (letters)."""
    end = F.regexp_extract("formula", r"\$([A-Z]+)\$\d+:\$([A-Z]+)\$\d+", 2)
    return blocks.withColumn("range_end", end).where((F.col("range_end") != "") & (F.col("range_end") != F.col("data_end")))


def by_severity(defects: DataFrame) -> DataFrame:
    """Defects, the most severe first. defects: severity, sheet, row."""
    rank = F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), F.col("severity"))
    return defects.withColumn("rank", F.when(rank == 0, len(SEVERITIES) + 1).otherwise(rank)).orderBy("rank", "sheet", "row")
