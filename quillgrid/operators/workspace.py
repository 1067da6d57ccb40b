"""Work on a model: scenarios with pending edits, history of changes, rollback, parameters that can be edited, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def merged_edits(overrides: DataFrame, pending: DataFrame) -> DataFrame:
    """(scenario, id, num): a scenario's overrides with its pending edits, which win. Both: scenario, id, num."""
    both = overrides.withColumn("rank", F.lit(0)).unionByName(pending.withColumn("rank", F.lit(1)))
    return both.groupBy("scenario", "id").agg(F.max_by("num", "rank").alias("num"))


def history(changes: DataFrame) -> DataFrame:
    """(id, seq, before, after): each change of a cell with the value it replaced. changes: id, seq, num, first (value before any)."""
    order = Window.partitionBy("id").orderBy("seq")
    return changes.select("id", "seq", F.when(F.row_number().over(order) == 1, F.col("first")).otherwise(F.lag("num").over(order)).alias("before"), F.col("num").alias("after"))


def rolled_back(records: DataFrame, undone: DataFrame) -> DataFrame:
    """(id, num): every cell's value without the records in undone (id, seq). records: id, seq, before, after.

    The last record that stands gives the value; a cell whose records are all undone has what it had before the first.
    """
    marked = records.join(undone.withColumn("gone", F.lit(True)), ["id", "seq"], "left")
    last = F.max_by("after", F.when(F.col("gone").isNull(), F.col("seq")))
    return marked.groupBy("id").agg(F.coalesce(last, F.min_by("before", "seq")).alias("num"))


def direct_dependents(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, edited): the cells that read an edited cell themselves, with the number of edits each reads."""
    hit = edges.join(edits.select(F.col("id").alias("precedent")).distinct(), "precedent", "left_semi")
    return hit.groupBy(F.col("dependent").alias("id")).agg(F.count_distinct("precedent").alias("edited"))


def editable(cells: DataFrame, labels: list[str]) -> DataFrame:
    """Constants with a number, outside of label columns. cells: col, num, formula."""
    return cells.where(F.col("formula").isNull() & F.col("num").isNotNull() & ~F.col("col").isin(*labels))


def by_keywords(items: DataFrame, keywords: list[str]) -> DataFrame:
    """(keyword, item_id): for each keyword the first item, by ``place``, whose name holds it. items: item_id, name, place."""
    words = F.explode(F.array(*(F.lit(k) for k in keywords))).alias("keyword")
    hits = items.select("item_id", "name", "place", words).where(F.contains(F.lower("name"), F.lower("keyword")))
    return hits.groupBy("keyword").agg(F.min_by("item_id", F.struct("place", "item_id")).alias("item_id"))


def safe_number(text: Column) -> Column:
    """A number in a text; truth values and all else are none."""
    return F.when(~F.lower(text).isin("true", "false"), F.regexp_replace(F.trim(text), ",", "").try_cast("double"))


def synced(items: DataFrame, cells: DataFrame, roles: DataFrame) -> DataFrame:
    """(item_id, series, summary): a line item's values by period from time columns, its summary from total or value columns.

    items: item_id, sheet, row; cells: sheet, row, col, num; roles: sheet, col, role, period.
    """
    held = items.join(cells, ["sheet", "row"]).join(F.broadcast(roles), ["sheet", "col"])
    time = F.col("role") == "time_series"
    pairs = F.array_sort(F.collect_list(F.when(time & F.col("num").isNotNull(), F.struct("period", "num"))))
    return held.groupBy("item_id").agg(F.map_from_entries(pairs).alias("series"), F.min_by("num", F.when(F.col("role") == "total", F.col("col"))).alias("summary"))
