"""Structure of grids and series: headers, roles, islands, carried categories, ranges, spines, nearest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.functions.cells import role_of

BLOCK = 512  # rows of a block in range joins


def header_rows(cells: DataFrame, within: int = 5) -> DataFrame:
    """(sheet, row): the first all-text row without formulas among a sheet's first used rows. cells: sheet, row, num, txt, formula."""
    rows = cells.groupBy("sheet", "row").agg(F.bool_and(F.col("txt").isNotNull() & F.col("num").isNull() & F.col("formula").isNull()).alias("text_only"))
    order = Window.partitionBy("sheet").orderBy("row")
    early = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= within)
    return early.where("text_only").groupBy("sheet").agg(F.min("row").alias("row"))


def column_roles(cells: DataFrame, sample: int = 10) -> DataFrame:
    """(sheet, col, role): by header word, else by what the first data rows hold. cells: sheet, row, col, header, num, txt."""
    order = Window.partitionBy("sheet", "col").orderBy("row")
    some = cells.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    share = lambda c: F.avg(c.cast("double"))
    number = F.col("num").isNotNull()
    seq = number & (F.col("num") > 0) & (F.col("num") < 1000) & (F.col("num") == F.floor("num"))
    dates = number & (F.col("num") >= 36526) & (F.col("num") <= 73050) & (F.col("num") == F.floor("num"))
    stats = some.groupBy("sheet", "col").agg(F.first("header").alias("header"), share(F.col("txt").isNotNull() & ~number).alias("texts"), share(seq).alias("seqs"), share(dates).alias("dates"), share(number).alias("numbers"))
    by_data = F.when(F.col("texts") > 0.6, "name").when(F.col("seqs") > 0.5, "sequence").when(F.col("dates") > 0.5, "time_series").when(F.col("numbers") > 0.5, "total").otherwise("notes")
    return stats.select("sheet", "col", F.coalesce(role_of(F.col("header")), by_data).alias("role"))


def islands(rows: DataFrame, keys: list[str], at: str, gap: int = 5) -> DataFrame:
    """(keys, island, first, last, n): runs of positions with gaps of ``gap`` at most."""
    order = Window.partitionBy(*keys).orderBy(at)
    starts = (F.col(at) - F.lag(at).over(order) > gap).cast("int")
    marked = rows.withColumn("island", F.coalesce(F.sum(F.coalesce(starts, F.lit(0))).over(order), F.lit(0)))
    return marked.groupBy(*keys, "island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def carry(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The last value that isn't null, carried down."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def in_ranges(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells with the ranges that hold them. cells: sheet, row, col; ranges: sheet, r1, r2, c1, c2.

    Rows are cut into blocks, so the join is by equal block and only then by bounds; ranges have no length limit.
    """
    blocks = F.sequence(F.floor(F.col("r1") / BLOCK), F.floor(F.col("r2") / BLOCK))
    wide = ranges.withColumn("block", F.explode(blocks))
    near = cells.withColumn("block", F.floor(F.col("row") / BLOCK)).join(wide, ["sheet", "block"])
    return near.where("row between r1 and r2 and col between c1 and c2").drop("block")


def nearest_above(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, reach: int | None = None) -> DataFrame:
    """Each row with the nearest mark above it, at most ``reach`` rows away. marks: keys, at, mark.

    One sort of both sides together: the last mark is carried down, no range join.
    """
    both = rows.withColumns({"mark": F.lit(None).cast(dict(marks.dtypes)["mark"]), "mark_at": F.lit(None).cast(dict(marks.dtypes)[at]), "is_row": F.lit(1)})
    other = marks.select(*keys, at, "mark").withColumns({"mark_at": F.col(at), "is_row": F.lit(0)})
    w = Window.partitionBy(*keys).orderBy(at, F.desc("is_row")).rowsBetween(Window.unboundedPreceding, 0)
    got = both.unionByName(other, allowMissingColumns=True).withColumn("found", F.last(F.when(F.col("is_row") == 0, F.struct("mark", "mark_at")), ignorenulls=True).over(w))
    got = got.where("is_row = 1").drop("mark", "mark_at", "is_row")
    near = F.lit(True) if reach is None else F.col(at) - F.col("found.mark_at") <= reach
    return got.withColumns({"mark": F.when(near, F.col("found.mark")), "mark_at": F.when(near, F.col("found.mark_at"))}).drop("found")


def fill_years(rows: DataFrame, keys: list[str], year: str, values: list[str]) -> DataFrame:
    """Every year between a group's first and last, with 0 where it has no row."""
    ends = rows.groupBy(*keys).agg(F.min(year).alias("a"), F.max(year).alias("b"))
    spine = ends.select(*keys, F.explode(F.sequence("a", "b")).alias(year))
    return spine.join(rows, [*keys, year], "left").fillna(0, values)


def quality_score(total: Column, linked: Column, formulas: Column, in_tables: Column, cyclic: Column) -> Column:
    """0.30 links + 0.25 formulas in the band 20-80 % + 0.25 tables + 0.20 no cycles, 0 to 100."""
    share = F.try_divide(formulas, total)
    band = F.when((share >= 0.2) & (share <= 0.8), 1.0).when(share < 0.2, share / 0.2).otherwise((1 - share) / 0.2)
    parts = [0.30 * F.try_divide(linked, total), 0.25 * band, 0.25 * F.try_divide(in_tables, total), 0.20 * (1 - F.try_divide(cyclic, total))]
    return F.coalesce(100 * (parts[0] + parts[1] + parts[2] + parts[3]), F.lit(0.0))


def header_confidence(headers: DataFrame, edges: DataFrame, last_row: int = 5) -> DataFrame:
    """(confidence): the share of header cells that are texts in the first rows and have dependents; 0 without headers.

    headers: id, row, type; edges: dependent, precedent.
    """
    used = edges.select(F.col("precedent").alias("id")).distinct().withColumn("used", F.lit(True))
    good = (F.col("type") == "string") & (F.col("row") <= last_row) & F.col("used").isNotNull()
    return headers.join(used, "id", "left").agg(F.coalesce(F.avg(F.coalesce(good, F.lit(False)).cast("double")), F.lit(0.0)).alias("confidence"))
