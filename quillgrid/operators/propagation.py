"""How far a change goes: for each root cell what depends on it, nearest first, with what it is and the line items it belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.operators.graph import cut


def propagation(edges: DataFrame, roots: DataFrame, changed: DataFrame, owner: DataFrame, max_depth: int = 10, max_nodes: int = 500) -> DataFrame:
    """(root, id, kind, depth, truncated): a view of ``max_nodes`` cells a root, by depth and id, and the line items of those cells.

    edges: dependent, precedent; roots: id; changed: id; owner: id, owner. kind: root, changed, downstream, item; an item has the
    least depth of its cells. truncated: the root reaches more cells than the view holds. All roots go at once; a root that
    has cells enough is not followed further, and a level keeps of each root only the first that the view can hold. Cycles
    end where they meet a cell that is known. The root stands whether or not it has edges; null ids take no part.
    """
    steps = edges.select(F.col("dependent").alias("next"), F.col("precedent").alias("id")).dropna()  # what is doubled ends with what a round finds
    start = roots.select(F.col("id").alias("root"), "id").dropna().distinct()
    order = Window.partitionBy("root").orderBy("id")
    seen = frontier = cut(start.withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        new = frontier.join(steps, "id").select("root", F.col("next").alias("id")).distinct().join(seen, ["root", "id"], "left_anti")
        # one more than fits, so that a cut shows
        new = cut(new.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_nodes + 1).select("root", "id", F.lit(depth).alias("depth")))
        if new.isEmpty():
            break
        seen = cut(seen.unionByName(new))
        full = seen.groupBy("root").count().where(F.col("count") > max_nodes).select("root")
        frontier = new.join(full, "root", "left_anti")
    full = seen.groupBy("root").agg((F.count("*") > max_nodes).alias("truncated"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("depth", "id"))
    shown = cut(seen.withColumn("n", place).where(F.col("n") <= max_nodes).select("root", "id", "depth"))
    marked = shown.join(changed.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    kind = F.when(F.col("id") == F.col("root"), "root").when(F.col("hit"), "changed").otherwise("downstream")
    items = shown.join(owner.select("id", "owner").distinct(), "id").groupBy("root", F.col("owner").alias("id")).agg(F.min("depth").alias("depth")).withColumn("kind", F.lit("item"))
    return marked.select("root", "id", kind.alias("kind"), "depth").unionByName(items.select("root", "id", "kind", "depth")).join(full, "root")


def links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, dependent, precedent): the edges between the cells of each view. nodes: what ``propagation`` returns."""
    cells = nodes.where("kind <> 'item'").select("root", "id")
    first = cells.join(edges.select("dependent", F.col("precedent").alias("id")), "id").withColumnRenamed("id", "precedent")
    return first.join(cells.withColumnRenamed("id", "dependent"), ["root", "dependent"]).select("root", "dependent", "precedent").distinct()
