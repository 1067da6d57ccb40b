"""Table detection, line items and simulations on small sheets."""

import random

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import graph, simulation, tables


def _boxes(spark, cells):
    found = tables.boxes(tables.regions(spark.createDataFrame(cells, "sheet string, row int, col int")))
    return found, {(r.sheet, r.top, r.bottom, r.left, r.right, r.n) for r in found.collect()}


def test_connected_on_a_long_chain_and_loose_ids(spark):
    n = 3000
    edges = spark.range(n - 1).select((F.col("id") * 7919 % n).alias("src"), ((F.col("id") + 1) * 7919 % n).alias("dst"))
    got = graph.connected(edges, spark.range(n + 5).select("id"))
    assert got.where("id < 3000").select("label").distinct().collect() == [(0,)]
    assert got.where("id >= 3000 and id = label").count() == 5


def test_snake_is_one_region_and_diagonals_are_none(spark):
    snake = [("a", r, c) for r in range(1, 20, 2) for c in range(1, 6)] + [("a", r, 5 if r % 4 == 2 else 1) for r in range(2, 19, 2)]
    loose = [("b", 1, 1), ("b", 2, 2), ("b", 3, 3)]
    _, got = _boxes(spark, snake + loose + snake[:3])
    assert got == {("a", 1, 19, 1, 5, len(snake))}


def test_empty_sheet(spark):
    found, got = _boxes(spark, [])
    assert got == set() and tables.merged(found).count() == 0


def test_neighbours_merge_by_gap(spark):
    def block(sheet, top, left):
        return [(sheet, top + i, left + j) for i in range(2) for j in range(2)]

    found, got = _boxes(spark, block("a", 1, 1) + block("a", 2, 6) + block("a", 2, 12) + block("a", 300, 6))  # gaps of 3 and 4, and no common row
    assert len(got) == 4
    sizes = sorted(r["count"] for r in tables.merged(found).groupBy("table").count().collect())
    assert sizes == [1, 1, 2]


def test_neighbours_merge_across_blocks(spark):
    cells = [("a", r, 1) for r in range(1, 700)] + [("a", r, 3) for r in range(500, 900)]
    found, _ = _boxes(spark, cells)
    assert tables.merged(found).select("table").distinct().count() == 1


def test_two_row_header_with_title(spark):
    rows = [("t", 1, 1, "Plan", None), ("t", 2, 1, "序号", None), ("t", 2, 2, "项目", None), ("t", 2, 3, "类别", None)]
    rows += [("t", 3, c, None, 45292.0 + c) for c in (1, 2, 3)] + [("t", r, c, None, 1.5) for r in (4, 5) for c in (1, 2)]
    rows += [("one_row", 1, 1, "x", None), ("one_row", 1, 2, "y", None)]
    got = tables.heads(spark.createDataFrame(rows, "table string, row int, col int, text string, num double")).collect()
    assert [tuple(r) for r in got] == [("t", "Plan", 3, 4, 5)]


def test_line_items_carry_category_and_skip_nameless_rows(spark):
    cells = [("t", 1, 1, "Sales", None), ("t", 1, 2, "Power", None), ("t", 1, 3, None, 5.0), ("t", 2, 2, "Heat", None), ("t", 2, 4, None, 7.0), ("t", 3, 3, None, 1.0), ("t", 4, 2, " ", None)]
    df = spark.createDataFrame(cells, "table string, row int, col int, text string, num double").withColumn("sheet", F.lit("s"))
    roles = spark.createDataFrame([("t", 1, "category", None), ("t", 2, "name", None), ("t", 3, "period", "2024"), ("t", 4, "period", "2024")], "table string, col int, role string, period string")
    got = {r.row: r for r in tables.line_items(df, roles).collect()}
    assert set(got) == {1, 2}
    assert (got[1].name, got[1].category, got[1].total, got[1].series) == ("Power", "Sales", 5.0, {"2024": 5.0})
    assert (got[2].item_id, got[2].category, got[2].total, got[2].series, got[2].cells) == ("IND_s_2_Sales_Heat", "Sales", 7.0, {"2024": 7.0}, ["s_2_2", "s_2_4"])


def test_draws_stay_in_their_ranges(spark):
    configs = spark.createDataFrame([(1, 100.0, 10.0, [1.0])], "project int, hours double, grid_price double, capex array<double>")
    plan = [simulation.Distribution("hours", "uniform"), simulation.Distribution("grid_price", "normal", std=100.0), simulation.Distribution("capex")]
    got = simulation.draws(configs, plan, 500)
    s = got.agg(F.min("hours"), F.max("hours"), F.min("grid_price"), F.count_distinct("project"), F.count_distinct("capex")).first()
    assert 90 <= s[0] < 92 and 108 < s[1] <= 110 and s[2] == 0.0 and s[3] == 500 and s[4] == 1
    with pytest.raises(ValueError):
        simulation.draws(configs, [simulation.Distribution("hours", "cauchy")], 2)


def test_financing_from_injections(spark):
    """Interest of the published construction schedule: 106,971.73 within a thousandth."""
    from quillgrid.operators import model

    # Month of each injection, its amount, and what its period invests.
    rows = [("2023-03", 6000, 28514.73), ("2023-12", 15000, 66534.38), ("2024-12", 20000, 92411.92), ("2025-12", 25000, 104888.03), ("2026-12", 28000, 114702.85), ("2027-12", 35000, 153329.43), ("2028-12", 33000, 140584.94), ("2029-08", 15000, 71022.45), ("2029-12", 10000, 47348.30), ("2030-07", 12000, 50636.92)]
    total = sum(r[2] for r in rows)
    net = (total - 10000) / total
    injections = spark.createDataFrame([(1, i, label, float(a), v * net) for i, (label, a, v) in enumerate(rows)], "project int, number int, label string, amount double, invested double")
    starts = spark.sql("select 1 as project, date'2023-02-01' as start")
    yearly = spark.createDataFrame([(1, 2023, 900.0)], "project int, year int, amount double")
    got = model.financing_periods(injections, starts, yearly, 0.043, 0.75).orderBy("number").collect()
    assert sum(r["interest"] for r in got) == pytest.approx(106971.73, rel=1e-3)
    assert [r["months"] for r in got] == [2, 9, 12, 12, 12, 12, 12, 8, 4, 7]
    split = model.financing_periods(injections.drop("invested"), starts, yearly, 0.043).orderBy("number").collect()
    assert [r["invested"] for r in split[:3]] == pytest.approx([900 * 2 / 11, 900 * 9 / 11, 0.0]) and split[0]["debt"] == 0.0


def test_regions_across_tiles_equal_a_walk(spark):
    """Tiles are joined: cells around the edges of tiles, in both directions, against a walk over all cells."""
    rng = random.Random(3)
    cells = {("s", r, c) for r in range(245, 270) for c in range(8, 40) if rng.random() < 0.6} | {("t", 255, 15), ("t", 256, 16)} | {("u", r, 3) for r in range(600)}
    seen, want = set(), {}
    for start in sorted(cells):
        todo = [start] if start not in seen else []
        while todo:
            at = todo.pop()
            if at in cells and at not in seen:
                seen.add(at)
                want[at] = start
                s, r, c = at
                todo += [(s, r + 1, c), (s, r - 1, c), (s, r, c + 1), (s, r, c - 1)]
    df = spark.createDataFrame([*sorted(cells), ("s", None, 1)], "sheet string, row int, col int")
    got = {(r["sheet"], r["row"], r["col"]): tuple(r["region"]) for r in tables.regions(df).collect()}
    assert got == want
    names = ["sheet", "region", "top", "bottom", "left", "right", "n"]
    assert sorted(map(tuple, tables.region_boxes(df).select(*names).collect())) == sorted(map(tuple, tables.boxes(tables.regions(df)).select(*names).collect()))
