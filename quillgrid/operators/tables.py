"""Tables of a sheet: connected regions of filled cells, neighbours merged, title and header rows, line items.

A table is named by the least (sheet, row, col) of its cells. Cells are dealt to tiles of fixed size by one shuffle; what
touches inside a tile is a piece, and only pieces at the edges of tiles go into the graph that joins them to regions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.operators import graph

BLOCK = 256  # rows; neighbours are looked for by blocks
TALL, WIDE = 256, 16  # rows and columns of a tile
TILED = "sheet {sheet}, down int, over int, cells array<struct<at:int,piece:int>>, boxes array<struct<piece:int,top:int,bottom:int,left:int,right:int,n:int,open:boolean>>"
# Words that mark a header cell.
HEADER_WORDS = "序号|编号|序|项目|名称|参数|指标|科目|类别|分类|大类"


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of n nodes is connected with along a[i] - b[i]."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of tiles with the least cell that they touch inside the tile, and the boxes of these pieces."""
    for batch in batches:
        sizes = batch.column("cells").value_lengths().to_numpy(zero_copy_only=False)
        tile = np.repeat(np.arange(len(sizes)), sizes)
        key = np.sort(tile * (TALL * WIDE) + batch.column("cells").flatten().to_numpy(zero_copy_only=False))
        at = key % (TALL * WIDE)
        row, col = at // WIDE, at % WIDE
        a, b = [], []
        for step, may in ((1, col < WIDE - 1), (WIDE, row < TALL - 1)):
            to = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
            met = np.flatnonzero(may & (key[to] == key + step))
            a.append(met)
            b.append(to[met])
        label = _labels(len(key), np.concatenate(a), np.concatenate(b))
        cells = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(at[label], pa.int32())], ["at", "piece"])
        order = np.argsort(label, kind="stable")
        first = np.flatnonzero(np.diff(label[order], prepend=-1))
        edge = (row == 0) | (row == TALL - 1) | (col == 0) | (col == WIDE - 1)
        over = lambda f, v: f.reduceat(v[order], first) if len(first) else v[:0]
        n = np.diff(first, append=len(key))
        found = [at[order][first], over(np.minimum, row), over(np.maximum, row), over(np.minimum, col), over(np.maximum, col), n]
        boxes = pa.StructArray.from_arrays([*(pa.array(v, pa.int32()) for v in found), pa.array(over(np.logical_or, edge), pa.bool_())], ["piece", "top", "bottom", "left", "right", "n", "open"])
        ends = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends(sizes), cells), pa.ListArray.from_arrays(ends(np.bincount(tile[order][first], minlength=len(sizes))), boxes)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sheet", "down", "over")), *lists], ["sheet", "down", "over", "cells", "boxes"])


def _tiled(cells: DataFrame) -> DataFrame:
    """A row a tile: its cells with their pieces and its pieces' boxes, by offsets in the tile."""
    row, col = F.col("row").cast("int"), F.col("col").cast("int")
    at = cells.dropna(subset=["sheet", "row", "col"]).select("sheet", F.floor(row / TALL).cast("int").alias("down"), F.floor(col / WIDE).cast("int").alias("over"), (F.pmod(row, F.lit(TALL)) * WIDE + F.pmod(col, F.lit(WIDE))).alias("at"))
    return graph.cut(at.groupBy("sheet", "down", "over").agg(F.collect_set("at").alias("cells")).mapInArrow(_pieces, TILED.format(sheet=dict(cells.dtypes)["sheet"])))


def _id(at: Column) -> Column:
    return F.struct("sheet", (F.col("down") * TALL + F.floor(at / WIDE)).cast("int").alias("row"), (F.col("over") * WIDE + at % WIDE).cast("int").alias("col"))


def _joined(tiles: DataFrame) -> DataFrame:
    """(id, label) of the pieces that touch a piece of another tile."""
    at = lambda c: F.floor(c["at"] / WIDE)
    across = lambda c: c["at"] % WIDE

    def side(keep, place, name: str, down: int = 0, over: int = 0) -> DataFrame:
        each = tiles.select("*", F.explode(F.filter("cells", keep)).alias("c"))
        return each.select("sheet", (F.col("down") + down).alias("d"), (F.col("over") + over).alias("o"), place(F.col("c")).alias("place"), _id(F.col("c.piece")).alias(name))

    edge = ["sheet", "d", "o", "place"]
    below = side(lambda c: at(c) == TALL - 1, across, "src", down=1).join(side(lambda c: at(c) == 0, across, "dst"), edge)
    right = side(lambda c: across(c) == WIDE - 1, at, "src", over=1).join(side(lambda c: across(c) == 0, at, "dst"), edge)
    edges = graph.cut(below.select("src", "dst").unionByName(right.select("src", "dst")).distinct())
    return graph.connected(edges, edges.select(F.explode(F.array("src", "dst")).alias("id")))


def regions(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, region): filled cells that touch by an edge have one region. cells: sheet, row, col (number)."""
    tiles = _tiled(cells)
    each = tiles.select("sheet", "down", "over", F.explode("cells").alias("c")).select("sheet", _id(F.col("c.at")).alias("at"), _id(F.col("c.piece")).alias("id"))
    return each.join(_joined(tiles), "id", "left").select("sheet", "at.row", "at.col", F.coalesce("label", "id").alias("region"))


def region_boxes(cells: DataFrame) -> DataFrame:
    """``boxes`` of the regions of cells, from the boxes of their pieces; only pieces at the edges of tiles are joined to others."""
    tiles = _tiled(cells)
    at = lambda c: (F.col("over") * WIDE + F.col(f"b.{c}")).alias(c)
    down = lambda c: (F.col("down") * TALL + F.col(f"b.{c}")).alias(c)
    each = tiles.select("sheet", "down", "over", F.explode("boxes").alias("b")).select("sheet", _id(F.col("b.piece")).alias("region"), down("top"), down("bottom"), at("left"), at("right"), F.col("b.n").cast("long").alias("n"), "b.open")
    edge = each.where("open").join(_joined(tiles).withColumnRenamed("id", "region"), "region", "left").withColumn("region", F.coalesce("label", "region"))
    whole = edge.groupBy("sheet", "region").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("left").alias("left"), F.max("right").alias("right"), F.sum("n").alias("n"))
    return each.where("not open").drop("open").unionByName(whole).where("bottom > top")


def boxes(placed: DataFrame) -> DataFrame:
    """(sheet, region, top, bottom, left, right, n) of regions with more than one row."""
    out = placed.groupBy("sheet", "region").agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"), F.count("*").alias("n"))
    return out.where("bottom > top")


def merged(found: DataFrame, widest: int = 3) -> DataFrame:
    """(region, table): boxes whose rows overlap and that are 1 to ``widest`` empty columns apart are one table, transitively.

    The row in which the upper box begins always bridges the two, so there is no further condition.
    """
    blocks = F.explode(F.sequence(F.floor(F.col("top") / BLOCK), F.floor(F.col("bottom") / BLOCK)))
    near = F.explode(F.transform(F.sequence(F.lit(1), F.lit(widest)), lambda g: (F.col("right") + 1 + g).cast("int")))
    one = found.select("sheet", F.col("region").alias("src"), F.col("top").alias("a"), F.col("bottom").alias("b"), "right", blocks.alias("block"))
    one = one.select("sheet", "src", "a", "b", "block", near.alias("left"))
    two = found.select("sheet", F.col("region").alias("dst"), "top", "bottom", "left", blocks.alias("block"))
    pairs = one.join(two, ["sheet", "left", "block"]).where("a <= bottom and top <= b").select("src", "dst").distinct()
    pairs = graph.cut(pairs)
    near = graph.connected(pairs, pairs.select(F.explode(F.array("src", "dst")).alias("id"))).select(F.col("id").alias("region"), F.col("label").alias("table"))
    return found.select("region").join(near, "region", "left").withColumn("table", F.coalesce("table", "region"))


def is_date(num: Column) -> Column:
    return (num >= 36526) & (num <= 73050) & (num == F.floor(num))


def heads(cells: DataFrame, words: str = HEADER_WORDS) -> DataFrame:
    """(table, title, header_row, data_start, data_end) of tables with at least two rows of data. cells: table, row, col, text, num.

    A first row of one or two texts without a header word is the title. A header has three header words, or five values with
    numbers among them, or three dates; the next row is the header instead if it is a better one. Without a header, data
    start at once.
    """
    text = F.col("text").isNotNull() & (F.trim("text") != "")
    date = F.coalesce(is_date(F.col("num")), F.lit(False))
    rows = cells.groupBy("table", "row").agg(
        F.count("*").alias("n"), F.count(F.when(text, 1)).alias("texts"), F.count(F.when(F.col("num").isNotNull() & ~date, 1)).alias("nums"),
        F.count(F.when(date, 1)).alias("dates"), F.count(F.when(text & F.lower("text").rlike(words), 1)).alias("words"), F.min_by(F.when(text, F.col("text")), F.when(text, F.col("col"))).alias("first"),
    )
    place = F.row_number().over(Window.partitionBy("table").orderBy("row"))
    top = rows.withColumn("place", place).where("place <= 3").groupBy("table").agg(F.array_sort(F.collect_list(F.struct("row", "n", "texts", "nums", "dates", "words", "first"))).alias("r"))
    ends = rows.groupBy("table").agg(F.max("row").alias("data_end"), F.count("*").alias("height"))
    df = top.join(ends, "table")
    one = F.get("r", F.lit(0))
    titled = (one["n"] <= 2) & (one["texts"] >= 1) & (one["nums"] == 0) & (one["words"] == 0) & (F.col("height") >= 3)
    df = df.withColumns({"head": F.when(titled, F.get("r", F.lit(1))).otherwise(one), "after": F.when(titled, F.get("r", F.lit(2))).otherwise(F.get("r", F.lit(1))), "title": F.when(titled, one["first"])})
    h, a = F.col("head"), F.col("after")
    proper = (h["words"] >= 3) | ((h["n"] >= 5) & (h["nums"] > 0)) | ((h["dates"] >= 3) & (h["n"] >= 3))
    better = (a["row"] == h["row"] + 1) & (((a["words"] > h["words"]) & (a["words"] >= 2)) | ((a["dates"] >= 3) & (a["dates"] > h["dates"])))
    df = df.withColumns({"proper": proper, "better": proper & F.coalesce(better, F.lit(False)), "first": one["first"]})
    header = F.when(F.col("better"), a["row"]).otherwise(h["row"])
    title = F.coalesce("title", F.when(F.col("better"), F.col("first")))
    out = df.select("table", title.alias("title"), header.alias("header_row"), F.when(F.col("proper"), header + 1).otherwise(header).alias("data_start"), "data_end")
    return out.where("data_end - data_start >= 1")


def item_id(sheet: Column, row: Column, category: Column, name: Column) -> Column:
    """IND_<sheet>_<row>_<category>_<name>, with anything but letters, digits and underscores replaced."""
    clean = lambda c, n: F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}_]", "_"), 1, n)
    return F.replace(F.concat(F.lit("IND_"), sheet.cast("string"), F.lit("_"), row.cast("string"), F.lit("_"), clean(category, 15), F.lit("_"), clean(name, 30)), F.lit(" "), F.lit("_"))


def line_items(cells: DataFrame, roles: DataFrame) -> DataFrame:
    """(item_id, table, sheet, row, name, category, unit, total, series, cells): a row a line item, its category carried down.

    cells: table, sheet, row, col, text, num, of data rows; roles: table, col, role (name, category, unit, total, period),
    period (label). The name is that column's, or else the first text of two letters or more. The total is that column's, or
    else the first number right of the name. Rows without a name are no items.
    """
    cells = cells.join(roles, ["table", "col"], "left")
    by = lambda role, value: F.max(F.when(F.col("role") == role, value))
    text = F.trim(F.col("text"))
    long = F.char_length(text) > 1
    rows = cells.groupBy("table", "sheet", "row").agg(
        by("name", F.coalesce(F.nullif(text, F.lit("")), F.col("num").cast("string"))).alias("named"), 
        F.min_by(F.when(long, text), F.when(long, F.col("col"))).alias("other"), by("category", F.nullif(text, F.lit(""))).alias("own"),
        by("unit", F.nullif(text, F.lit(""))).alias("unit"), by("total", F.col("num")).alias("total"),
        F.array_sort(F.collect_list(F.when(F.col("num").isNotNull(), F.struct("col", "num")))).alias("nums"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "period", F.struct(F.coalesce("period", F.col("col").cast("string")).alias("period"), "col", "num")))).alias("p"),
        F.array_sort(F.collect_list(F.struct("col"))).alias("at_cols"),
    )
    names = roles.where("role = 'name'").groupBy("table").agg(F.max("col").alias("at"))
    latest = F.filter("p", lambda x, i: F.coalesce(F.get("p", (i + 1).cast("int"))["period"] != x["period"], F.lit(True)))  # columns of one period: the last
    series = F.map_from_entries(F.transform(latest, lambda x: F.struct(x["period"], x["num"])))
    rows = rows.join(names, "table", "left").withColumn("series", series)
    right = F.get(F.filter("nums", lambda x: x["col"] > F.col("at")), F.lit(0))["num"]
    rows = rows.withColumns({"name": F.coalesce("named", "other"), "total": F.coalesce("total", right)}).where("name is not null")
    carried = F.last("own", ignorenulls=True).over(Window.partitionBy("table").orderBy("row"))
    rows = rows.withColumn("category", carried)
    ids = F.transform("at_cols", lambda c: F.concat_ws("_", F.col("sheet").cast("string"), F.col("row").cast("string"), c["col"].cast("string")))
    return rows.select(item_id(F.col("sheet"), F.col("row"), F.col("category"), F.col("name")).alias("item_id"), "table", "sheet", "row", "name", "category", "unit", "total", "series", ids.alias("cells"))
