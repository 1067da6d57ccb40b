"""Metrics of a workbook: which rule wins, what is computed, and what is left out."""

import pytest

from quillgrid.operators.bundle import bundle

ITEMS = "book string, item_id long, place long, `table` string, row int, name string, total double"
CELLS = "book string, item_id long, col int, num double, period string"


def _run(spark, items, cells):
    out = bundle(spark.createDataFrame(items, ITEMS), spark.createDataFrame(cells, CELLS))
    return {r.book: r.asDict() for r in out.collect()}


def _years(book, item, values, first=2024):
    return [(book, item, 5 + i, float(v), f"{first + i}年") for i, v in enumerate(values)]


def test_rules(spark):
    items = [
        # a: equity flows after tax win, though running sums and other flows come first; the rate is in percent
        ("a", 1, 1, "表5", 3, "净现金流量", None), ("a", 2, 2, "表6", 4, "资本金累计税后净现金流量", None), ("a", 3, 3, "表6", 5, "资本金税后净现金流量", None),
        ("a", 4, 4, "表1", 6, "基准收益率", 10.0), ("a", 5, 5, "表2", 7, "投资回收期", None), ("a", 6, 6, "表6", 8, "投资回收期", None), ("a", 7, 7, "表6", 9, "DSCR", None),
        # b: a single dated point isn't enough for an item, two items together are
        ("b", 1, 1, "t", 1, "净现金流量一", None), ("b", 2, 2, "t", 2, "净现金流量二", None), ("b", 3, 3, "t", 3, "所得税", None),
        # c: nothing is read
        ("c", 1, 1, "t", 1, "装机容量", 5.0), ("c", 2, 2, "t", 2, None, 5.0),
    ]
    cells = [
        *_years("a", 1, [1, 1, 1]), *_years("a", 2, [2, 2, 2]), *_years("a", 3, [-100, 60, 60]), ("a", 5, 4, 7.0, None), ("a", 6, 4, 9.0, None), *_years("a", 7, [1.5, 1.1]),
        ("b", 1, 5, -10.0, "2024"), ("b", 2, 6, 12.0, "第2025年"), ("b", 2, 7, 3.0, "P1"), ("b", 2, 8, None, "2026"), ("b", 3, 5, 4.0, "2024"), ("b", 3, 6, -4.0, "2025"), ("c", 1, 4, 1.0, None),
    ]
    got = _run(spark, items, cells)
    a, b, c = got["a"], got["b"], got["c"]
    assert a["irr_after_tax"] == pytest.approx(0.1306624, abs=1e-6) and a["npv_after_tax"] == pytest.approx(-100 + 60 / 1.1 + 60 / 1.21)
    assert a["payback_period"] == 9.0 and a["sources"] == {"payback_period": "表6 D8", "irr_after_tax": "computed"}
    assert a["cover_series"] == {"2024年": 1.5, "2025年": 1.1} and a["cover_avg"] == pytest.approx(1.3) and a["cover_min"] == 1.1
    assert b["irr_after_tax"] == pytest.approx(0.2) and b["npv_after_tax"] == pytest.approx(-10 + 12 / 1.08) and b["payback_period"] == pytest.approx(10 / 12)
    assert b["total_tax"] is None and b["annual_net_cashflow"] == pytest.approx(5 / 3)
    assert all(v is None or v == {} for k, v in c.items() if k != "book")


def test_no_items(spark):
    assert _run(spark, [], [("a", 1, 4, 1.0, None)]) == {}
