"""Snapshots: tolerant comparison, roll-ups to line items and sheets, summaries and causes.

A snapshot is rows (id, num DOUBLE, txt STRING); null in both is an empty cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def equal(a_num: Column, a_txt: Column, b_num: Column, b_txt: Column) -> Column:
    """Numbers within 1e-9, absolute or relative; texts exactly; empty equals only empty."""
    gap = F.abs(a_num - b_num)
    near = (gap <= TOLERANCE) | (gap <= TOLERANCE * F.greatest(F.abs(a_num), F.abs(b_num)))
    numbers = a_num.isNotNull() & b_num.isNotNull()
    return F.when(numbers, near).otherwise(a_num.isNull() & b_num.isNull() & a_txt.eqNullSafe(b_txt))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, old_num, new_num, old_txt, new_txt, magnitude, direction) of cells that differ, over both snapshots' ids."""
    a = old.select("id", F.col("num").alias("old_num"), F.col("txt").alias("old_txt"))
    b = new.select("id", F.col("num").alias("new_num"), F.col("txt").alias("new_txt"))
    rows = a.join(b, "id", "full_outer").where(~equal(F.col("old_num"), F.col("old_txt"), F.col("new_num"), F.col("new_txt")))
    magnitude = F.coalesce(F.abs(F.col("new_num") - F.col("old_num")), F.abs("old_num"), F.abs("new_num"), F.lit(0.0))
    one_sided = (F.col("old_num").isNull() & F.col("old_txt").isNull()) | (F.col("new_num").isNull() & F.col("new_txt").isNull())
    direction = F.when(one_sided, "increase").when(F.col("old_num").isNull() | F.col("new_num").isNull(), "unchanged").when(F.col("new_num") >= F.col("old_num"), "increase").otherwise("decrease")
    return rows.select("id", "old_num", "new_num", "old_txt", "new_txt", magnitude.alias("magnitude"), direction.alias("direction"))


def by_owner(changes: DataFrame, owner: DataFrame) -> DataFrame:
    """(owner, changed, total, up, down) for line items or sheets. owner: id, owner."""
    count = lambda d: F.count_if(F.col("direction") == d)
    return changes.join(owner, "id").groupBy("owner").agg(F.count("*").alias("changed"), F.sum("magnitude").alias("total"), count("increase").alias("up"), count("decrease").alias("down"))


def summary(changes: DataFrame) -> DataFrame:
    """One row: changes, sums by direction, the largest one's id."""
    some = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("magnitude"))), F.lit(0.0))
    return changes.agg(F.count("*").alias("changed"), some("increase").alias("increase"), some("decrease").alias("decrease"), F.max_by("id", F.struct("magnitude", -F.col("id").cast("double"))).alias("largest"))


def root_class(formula_changed: Column, old_missing: Column, new_missing: Column, precedent_changed: Column) -> Column:
    """Cause of a differing cell, first match: its formula, a lost value, a changed precedent that reached it, its own value."""
    return F.when(formula_changed, "formula_changed").when(new_missing & ~old_missing, "cache_loss").when(precedent_changed, "propagation").otherwise("value_changed")


def trace_root(changes: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """(id, root, hops): follows the first differing precedent, at most ``depth`` times. edges: dependent, precedent, operand_no."""
    first = edges.join(changes.select(F.col("id").alias("precedent")), "precedent", "left_semi").groupBy("dependent").agg(F.min_by("precedent", "operand_no").alias("next"))
    out = changes.select("id", F.col("id").alias("root"), F.lit(0).alias("hops"))
    for _ in range(depth):
        out = out.join(first.withColumnRenamed("dependent", "root"), "root", "left").select("id", F.coalesce("next", "root").alias("root"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops"))
    return out
