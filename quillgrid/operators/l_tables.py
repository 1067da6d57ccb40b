"""L-shaped tables: a tall merged cell at the left ties the rows beside and below it to one table.

Everything but the choice between anchors is found for all anchors at once. Rows are scanned by lane, which is a sheet, the
anchor's column and the rightmost column in use near it; anchors of a lane share the scan. No table goes on over as many empty rows
of its whole sheet as end one, so a lane is scanned only in the parts between such gaps in which an anchor of its own goes on. Scans
go by blocks of rows, and only one row a block meets the other blocks, so that a tall sheet is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.operators import graph, tables

BLOCK = 4096  # rows of a block in scans
STEP = 16  # rows of the lowest blocks in which places meet ranges, and the factor of each higher level
NEAR = 64  # rows of a block in which anchors meet the rows they look at
LOOK = 50  # rows below an anchor's first that tell how far right its table goes
GAP = 3  # so many empty rows end a table
APART = 5  # so many empty columns are still inside a table
ABOVE = 4  # a row above belongs to the table if it begins at most so many columns right of the anchor
LANE = ["sheet", "c1", "edge"]
ANCHOR = ["sheet", "r1", "c1"]


def nearest(rows: DataFrame, keys: list[str], at: str, value: Column, name: str, after: bool, block: int = BLOCK) -> DataFrame:
    """Each row with the first ``value`` that isn't null strictly after it (or before it) in the order of ``at``, as ``name``."""
    rows = rows.withColumns({"_v": value, "_b": F.floor(F.col(at) / block)})
    # against the way of the search: Spark carries a growing frame along, but walks a shrinking one again for every row
    way = (lambda c: F.desc(c)) if after else (lambda c: F.asc(c))
    onward = lambda w: F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    edge = (F.min_by if after else F.max_by)("_v", F.when(F.col("_v").isNotNull(), F.col(at)))
    blocks = rows.groupBy(*keys, "_b").agg(edge.alias("_v"))
    later = blocks.withColumn("_far", onward(Window.partitionBy(*keys).orderBy(way("_b")))).drop("_v")
    near = rows.withColumn("_near", onward(Window.partitionBy(*keys, "_b").orderBy(way(at))))
    return near.join(later, [*keys, "_b"]).withColumn(name, F.coalesce("_near", "_far")).drop("_v", "_b", "_near", "_far")


def anchors(cells: DataFrame, merges: DataFrame, least_rows: int = 3, most_cols: int = 2) -> DataFrame:
    """(sheet, r1, c1, r2, c2): tall, narrow merged cells that hold something; of two at one place the larger."""
    tall = merges.groupBy(*ANCHOR).agg(F.max("r2").alias("r2"), F.max("c2").alias("c2")).where((F.col("r2") - F.col("r1") >= least_rows - 1) & (F.col("c2") - F.col("c1") < most_cols))
    return tall.join(cells.select("sheet", F.col("row").alias("r1"), F.col("col").alias("c1")), ANCHOR, "left_semi")


def filled(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, text, num, before): one row a cell that holds something, a text before a number.

    before is the last column of the part of the row that ends more than ``APART`` empty columns to the left; null if none does.
    """
    cells = cells.select("sheet", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "text", "num").repartition("sheet", "row")  # once for all below
    one = cells.groupBy("sheet", "row", "col").agg(F.min(F.when(F.trim("text") != "", F.col("text"))).alias("text"), F.min("num").alias("num"))
    one = one.where("text is not null or num is not null").withColumn("num", F.when(F.col("text").isNull(), F.col("num")))
    across = Window.partitionBy("sheet", "row").orderBy("col")
    gone = F.lag("col").over(across)
    return one.withColumn("gone", gone).withColumn("before", F.max(F.when(F.col("col") - F.col("gone") - 1 > APART, F.col("gone"))).over(across)).drop("gone")


def _extents(cells: DataFrame, merges: DataFrame, found: DataFrame, words: str) -> DataFrame:
    """(anchor, r2, c2, edge, top, bottom) of each anchor as if there were no other."""
    text = F.col("text").isNotNull()
    rows = cells.groupBy("sheet", "row").agg(
        F.sort_array(F.collect_list("col")).alias("cols"), F.count("*").alias("n"), F.count("text").alias("texts"),
        F.count(F.when(text & F.col("text").rlike(words), 1)).alias("words"), F.count(F.when(text & ~F.trim("text").rlike("^[0-9]+$"), 1)).alias("notes"),
    )
    rows = rows.select("sheet", "row", "cols", ((F.col("texts") == F.col("n")) & (F.col("texts") > 1) & (F.col("words") > 1)).alias("header"), ((F.col("n") == 1) & (F.col("notes") == 1)).alias("note"))
    rows = graph.cut(_parts(rows))
    r1, r2 = F.col("r1"), F.col("r2")
    block = lambda row: F.floor(row / NEAR)
    looked = F.struct("row", "start", "cols", F.array_max("cols").alias("last"))
    near = rows.groupBy("sheet", block(F.col("row")).alias("block")).agg(F.collect_list(looked).alias("near"))
    blocks = F.array_union(F.sequence(block(r1 - 1), block(r1 + LOOK)), F.sequence(block(r2 + 1), block(r2 + GAP)))
    of = lambda low, high, what: F.transform(F.filter("near", lambda x: (x["row"] >= low) & (x["row"] <= high)), what)
    far, start = F.array_max(of(r1, r1 + LOOK, lambda x: x["last"])), F.array_min(of(r2 + 1, r2 + GAP, lambda x: x["start"]))
    over = F.get(of(r1 - 1, r1 - 1, lambda x: x["cols"]), F.lit(0))
    # of the row above: its first column, and its first that isn't left of the anchor; numbers, as arrays are aggregated by sorting
    met = found.withColumn("block", F.explode(blocks)).join(near, ["sheet", "block"]).select(*ANCHOR, "r2", "c2", far.alias("far"), over.alias("over"), start.alias("start"))
    onward = F.array_min(F.filter("over", lambda c: c >= F.col("c1")))
    known = met.groupBy(*ANCHOR, "r2", "c2").agg(F.max("far").alias("far"), F.max(F.array_min("over")).alias("over"), F.max(onward).alias("onward"), F.min("start").alias("start"))
    known = known.withColumn("edge", F.greatest("c2", "far"))
    tied = (F.col("over") - F.col("c1") <= ABOVE) & (F.col("onward") <= F.col("edge"))
    known = graph.cut(known.select(*ANCHOR, "r2", "c2", "edge", (F.col("r1") - F.coalesce(tied, F.lit(False)).cast("int")).alias("top"), "start"))

    scan = [*LANE, "start"]
    blocked = rows.withColumn("part", F.floor(F.col("row") / BLOCK))
    lanes = known.groupBy(*scan).agg(F.min("r2").alias("from")).join(blocked.select("sheet", "start", "part").distinct(), ["sheet", "start"])
    laned = blocked.join(lanes, ["sheet", "start", "part"]).where(F.col("row") > F.col("from")).where(F.exists("cols", lambda c: (c >= F.col("c1")) & (c <= F.col("edge"))))
    # each step below reads the one before it twice, so that without cuts the lanes' rows would be made anew many times
    laned = graph.cut(laned.select(*scan, "row", "header", "note", (F.array_max("cols") <= F.col("c1") + 3).alias("narrow")))
    held = _near(laned.where("narrow").select("sheet", "row", F.col("c1").alias("col")).distinct(), merges, "r1", "r2").where("row between r1 and r2 and col between c1 and c2")
    held = held.select("sheet", "row", F.col("col").alias("c1")).distinct().withColumn("held", F.lit(True))
    laned = graph.cut(laned.join(held, ["sheet", "row", "c1"], "left").select(*scan, "row", (F.col("header") | F.col("note") | (F.col("narrow") & F.col("held").isNotNull())).alias("fresh")))
    laned = graph.cut(nearest(laned, scan, "row", F.col("row"), "prev", after=False))
    empty = F.col("row") - F.col("prev") - 1
    ends = nearest(laned, scan, "row", F.when((empty >= GAP) | ((empty > 0) & F.col("fresh")), F.struct("prev")), "stop", after=True)
    ends = ends.join(laned.groupBy(*scan).agg(F.max("row").alias("last")), scan)
    step = F.struct("row", "fresh", F.coalesce("stop.prev", "last").alias("end"))
    both = graph.cut(ends.select(*scan, (2 * F.col("row")).alias("at"), step.alias("step"))).unionByName(known.where("start is not null").select(*scan, (2 * F.col("r2") + 1).alias("at")).distinct(), allowMissingColumns=True)
    after = nearest(both, scan, "at", F.col("step"), "next", after=True, block=2 * BLOCK).where("at % 2 <> 0").select(*scan, ((F.col("at") - 1) / 2).cast("int").alias("r2"), "next")
    empty = F.col("next.row") - F.col("r2") - 1
    goes_on = (empty < GAP) & ((empty == 0) | ~F.col("next.fresh"))
    return known.join(after, [*scan, "r2"], "left").select(*ANCHOR, "r2", "c2", "edge", "top", F.when(F.coalesce(goes_on, F.lit(False)), F.col("next.end")).otherwise(F.col("r2")).alias("bottom"))


def _parts(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of sheets with ``start``, the first row of their part of the sheet; between two parts lie ``GAP`` empty rows or more."""
    within, blockwise = Window.partitionBy("sheet", "_b").orderBy("row"), Window.partitionBy("sheet").orderBy("_b")
    rows = rows.withColumn("_b", F.floor(F.col("row") / block)).withColumn("_first", F.when(F.col("row") - F.lag("row").over(within) > GAP, F.col("row")))
    rows = graph.cut(rows.withColumn("_own", F.last("_first", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))).drop("_first"))
    blocks = rows.groupBy("sheet", "_b").agg(F.min("row").alias("a"), F.max("row").alias("z"), F.max("_own").alias("own"))
    gone = F.lag("z").over(blockwise)
    blocks = blocks.withColumn("head", F.when(gone.isNull() | (F.col("a") - gone > GAP), F.col("a")))
    before = F.last(F.coalesce("own", "head"), ignorenulls=True).over(blockwise.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("sheet", "_b", F.coalesce("head", before).alias("_lead"))
    return rows.join(blocks, ["sheet", "_b"]).withColumn("start", F.coalesce("_own", "_lead")).drop("_b", "_own", "_lead")


def _near(places: DataFrame, ranges: DataFrame, top: str, bottom: str) -> DataFrame:
    """Places with the ranges of their sheet that meet their block of rows. Short ranges are met by low blocks, tall ones by high ones.

    A range lies in 17 blocks of its level at most, up to the highest level, so it meets few places outside it and is copied little.
    """
    height = F.col(bottom) - F.col(top) + 1
    level = F.when(height <= STEP**2, 1).when(height <= STEP**3, 2).otherwise(3)
    block = lambda row: F.floor(F.col(row) / F.pow(F.lit(STEP), F.col("level")))
    blocks = ranges.withColumn("level", level).withColumn("block", F.explode(F.sequence(block(top), block(bottom))))
    placed = places.withColumn("level", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("block", block("row"))
    return placed.join(blocks, ["sheet", "level", "block"]).drop("level", "block")


def _covered(at: DataFrame, by: DataFrame) -> DataFrame:
    """Places with the tables that would take them. at: sheet, row, col, before; by: extents."""
    near = _near(at, by, "top", "bottom")
    return near.where("row between top and bottom and col between c1 and edge and coalesce(before, 0) < c1")


def _chosen(extents: DataFrame, cells: DataFrame) -> DataFrame:
    """The extents that stand: in the order of (r1, c1) one whose anchor a standing one has taken is none.

    Of the anchors of a lane with one end the first open one takes all that the others do, so a round asks only that one.
    """
    place = cells.select("sheet", F.col("row").alias("r1"), F.col("col").alias("c1"), "before")
    later = "r1 < row or (r1 = row and c1 < col)"
    left, out = graph.cut(extents.join(place, ANCHOR)), None
    while not left.isEmpty():
        first = F.row_number().over(Window.partitionBy(*LANE, "bottom").orderBy("r1"))
        heads = left.withColumn("n", first).where("n = 1").drop("n", "before")
        at = left.select("sheet", F.col("r1").alias("row"), F.col("c1").alias("col"), "before")
        taken = graph.cut(_covered(at, heads).where(later).select("sheet", F.col("row").alias("r1"), F.col("col").alias("c1")))
        free = graph.cut(left.join(taken, ANCHOR, "left_anti"))
        out = free if out is None else out.unionByName(free)
        # what a table that now stands would take, whether or not it is the first of its lane
        gone = _covered(at, free.drop("before")).where(later).select("sheet", F.col("row").alias("r1"), F.col("col").alias("c1")).distinct()
        left = graph.cut(left.join(gone, ANCHOR, "left_anti").join(free, ANCHOR, "left_anti"))
    return (left if out is None else out).drop("before")


def claimed(cells: DataFrame, merges: DataFrame, words: str = tables.HEADER_WORDS) -> tuple[DataFrame, DataFrame]:
    """Cells as ``filled`` gives them with their table (null: none), and the tables (sheet, r1, c1, r2, c2, edge, top, bottom).

    cells: sheet, row, col (numbers), text, num; merges: sheet, r1, c1, r2, c2. A table goes right to the last column in use in the
    anchor's first row and the 50 below, up by one row that begins near the anchor, and down over gaps of two empty rows at most;
    after a gap, a row of header words, a single note and another merged cell with little beside it end it. In a row it takes the
    part that is up to five empty columns apart. A cell is the first table's that reaches it; an anchor inside such a table
    founds none. Rows with a null sheet, row or column take no part.
    """
    merges = merges.select("sheet", *(F.col(c).cast("int").alias(c) for c in ("r1", "c1", "r2", "c2"))).dropna()
    cells = graph.cut(filled(cells.dropna(subset=["sheet", "row", "col"])))
    found = _chosen(_extents(cells, merges, anchors(cells, merges), words), cells)
    found = graph.cut(found)
    owner = _covered(cells.select("sheet", "row", "col", "before"), found).groupBy("sheet", "row", "col").agg(F.min(F.struct("r1", "c1")).alias("table"))
    return cells.join(owner, ["sheet", "row", "col"], "left"), found


def detect(cells: DataFrame, merges: DataFrame, words: str = tables.HEADER_WORDS) -> DataFrame:
    """(sheet, r1, c1, title, top, bottom, left, right, n): the L-shaped tables, their filled cells with the anchor's own place."""
    owned, found = claimed(cells, merges, words)
    sizes = owned.where("table is not null").groupBy("sheet", "table.r1", "table.c1").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min("col").alias("l"), F.max("col").alias("r"), F.count("*").alias("n"))
    title = owned.select("sheet", F.col("row").alias("r1"), F.col("col").alias("c1"), F.trim("text").alias("title"))
    out = found.join(sizes, ANCHOR).join(title, ANCHOR)
    return out.select(*ANCHOR, "title", F.least("a", "r1").alias("top"), F.greatest("b", "r2").alias("bottom"), F.least("l", "c1").alias("left"), F.greatest("r", "c2").alias("right"), "n")
