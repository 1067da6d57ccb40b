"""L-shaped tables on planted grids, and the scan by blocks against a plain one."""

import random

from pyspark.sql import functions as F

from quillgrid.operators import l_tables

CELLS = "sheet string, row int, col int, text string, num double"
MERGES = "sheet string, r1 int, c1 int, r2 int, c2 int"


def test_nearest_equals_a_plain_scan(spark):
    rng = random.Random(5)
    rows = [(k, at, rng.choice([None, None, at * 10])) for k in "ab" for at in rng.sample(range(100), 40)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    for after in (True, False):
        got = {(r.k, r.at): r.x for r in l_tables.nearest(df, ["k"], "at", F.col("v"), "x", after, block=4).collect()}
        for k, at, _ in rows:
            other = [(p, v) for kk, p, v in rows if kk == k and v is not None and (p > at if after else p < at)]
            assert got[k, at] == ((min if after else max)(other)[1] if other else None)


def _found(spark, cells, merges):
    out = l_tables.detect(spark.createDataFrame(cells, CELLS), spark.createDataFrame(merges, MERGES)).collect()
    return {(r.sheet, r.r1, r.c1): (r.title, r.top, r.bottom, r.left, r.right, r.n) for r in out}


def test_planted_tables(spark):
    num = lambda s, r, c: (s, r, c, None, 1.0)
    txt = lambda s, r, c, t: (s, r, c, t, None)
    cells = [
        # a: header row above, gap of two rows inside, another anchor within (founds none), a cell far to the right, three empty rows
        txt("a", 1, 2, "名称"), txt("a", 1, 3, "数值"), txt("a", 2, 1, "Costs"), num("a", 2, 3), num("a", 4, 3), num("a", 7, 3), txt("a", 8, 1, "More"), num("a", 8, 6), num("a", 12, 3), num("a", 8, 13),
        # b: a row of header words after a gap begins something else
        txt("b", 5, 1, "One"), num("b", 5, 2), num("b", 8, 2), txt("b", 10, 1, "项目"), txt("b", 10, 2, "指标"), num("b", 11, 2),
        # c: a note after a gap; the row above the second anchor is the first one's
        txt("c", 1, 1, "One"), num("c", 2, 2), num("c", 4, 2), txt("c", 5, 1, "Two"), num("c", 6, 2), txt("c", 9, 2, "a note"),
        # d: too short and too wide merges, an empty one
        txt("d", 1, 1, "short"), num("d", 1, 2), txt("d", 5, 1, "wide"), num("d", 5, 4), num("d", 9, 2),
        # e: another merged cell with little beside it after a gap
        txt("e", 1, 1, "One"), num("e", 1, 9), num("e", 3, 2), txt("e", 5, 1, "Two"), num("e", 5, 2), num("e", 6, 2), (None, 1, 1, "x", None),
    ]
    merges = [("a", 2, 1, 4, 1), ("a", 8, 1, 10, 1), ("b", 5, 1, 7, 1), ("c", 1, 1, 3, 1), ("c", 5, 1, 7, 1), ("d", 1, 1, 2, 1), ("d", 5, 1, 8, 3), ("d", 9, 5, 12, 5), ("e", 1, 1, 3, 1), ("e", 5, 1, 7, 1), ("e", None, 1, 7, 1)]
    got = _found(spark, cells, merges)
    assert got == {
        ("a", 2, 1): ("Costs", 1, 8, 1, 6, 8),
        ("b", 5, 1): ("One", 5, 8, 1, 2, 3),
        ("c", 1, 1): ("One", 1, 6, 1, 2, 5),
        ("e", 1, 1): ("One", 1, 3, 1, 2, 2),
        ("e", 5, 1): ("Two", 5, 7, 1, 2, 3),
    }


def test_no_cells_and_no_merges(spark):
    assert _found(spark, [], [("a", 1, 1, 3, 1)]) == {}
    assert _found(spark, [("a", 1, 1, "x", None)], []) == {}


def test_nearest_value_is_found_by_a_growing_frame(spark):
    """A frame that shrinks to the end is walked again for every row."""
    rows = spark.createDataFrame([(k, at, v) for k in "ab" for at, v in ((1, None), (3, 7), (4, None), (9, 8), (12, None))], "k string, at int, v int")
    for after in (True, False):
        out = l_tables.nearest(rows, ["k"], "at", F.col("v"), "found", after=after, block=4)
        assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString()
        want = {1: 7, 3: 8, 4: 8, 9: None, 12: None} if after else {1: None, 3: None, 4: 7, 9: 7, 12: 8}
        assert {(r["k"], r["at"]): r["found"] for r in out.collect()} == {(k, at): v for k in "ab" for at, v in want.items()}


def test_places_meet_ranges_of_every_height(spark):
    ranges = spark.createDataFrame([(1, 5, 5), (1, -3, 40), (1, 10, 900), (1, 0, 70000), (2, 5, 5)], "sheet int, r1 int, r2 int")
    places = spark.createDataFrame([(1, r) for r in (-3, 5, 6, 40, 41, 900, 69999)], "sheet int, row int")
    got = l_tables._near(places, ranges, "r1", "r2").where("row between r1 and r2").select("row", "r1", "r2").collect()
    want = [(r.row, s.r1, s.r2) for r in places.collect() for s in ranges.collect() if s.sheet == 1 and s.r1 <= r.row <= s.r2]
    assert sorted(map(tuple, got)) == sorted(want)


def test_parts_of_a_sheet_are_apart_by_empty_rows(spark):
    rng = random.Random(3)
    rows = [(s, r) for s in "ab" for r in sorted(rng.sample(range(-20, 180), 60))] + [("c", r) for r in range(30)]
    got = {(r.sheet, r.row): r.start for r in l_tables._parts(spark.createDataFrame(rows, "sheet string, row int"), block=8).collect()}
    start, was = None, (None, None)
    for s, r in rows:
        start = r if was[0] != s or r - was[1] - 1 >= l_tables.GAP else start
        was = (s, r)
        assert got[s, r] == start
    assert len(got) == len(rows)


def test_lanes_are_scanned_only_where_an_anchor_goes_on(spark, monkeypatch):
    """Of a sheet of 400 rows in parts of four, two anchors' parts are scanned; without parts each lane took all rows."""
    cells = [("a", r, c, None, 1.0) for r in range(400) if r % 8 < 4 for c in (2, 3)] + [("a", 80, 1, "One", None), ("a", 240, 1, "Two", None), ("a", 240, 9, None, 2.0)]
    scanned, plain = [], l_tables.nearest
    monkeypatch.setattr(l_tables, "nearest", lambda rows, *a, **kw: scanned.append(rows.count()) or plain(rows, *a, **kw))
    got = _found(spark, cells, [("a", 80, 1, 82, 1), ("a", 240, 1, 242, 1)])
    assert got == {("a", 80, 1): ("One", 80, 83, 1, 3, 9), ("a", 240, 1): ("Two", 240, 243, 1, 9, 10)}
    assert scanned and max(scanned) <= 4
