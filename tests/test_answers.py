"""What-if questions: what is understood, which scenario each makes, and the tiers."""

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import answers

ITEMS = "item_id long, place long, `table` string, row int, name string, total double, total_id string"


def test_parsed(spark):
    """Patterns are greedy: of two letters of direction the first stays with the parameter, whose name need only be like it."""
    rows = [
        ("如果上网电价提高5%，IRR变成多少", ("up", "上网电价", 5.0)), ("假设总投资降低20%，净现值变化多大", ("down", "总投资", 20.0)), ("电价下降3.5%后NPV变成多少", ("down", "电价下", 3.5)),
        ("如果利率为4.2，NPV变成多少", ("set", "利率", 4.2)), ("如果电价上涨一些%，IRR变成多少", ("up", "电价上", 10.0)), ("电价增加5%", ("up", "电价", 5.0)), ("项目在哪里", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(rows)], "i long, q string").select("i", answers.parsed(F.col("q")).alias("p"))
    got = {r.i: r.p and (r.p.way, r.p.param, r.p.amount) for r in df.collect()}
    assert got == {i: w for i, (_, w) in enumerate(rows)}


def _answer(spark, questions, items=None, points=None):
    params = spark.createDataFrame([(1, "p", "电价", 2.0, 1), (2, "q", "利率", 0.0, 2), (3, "z", "装机", 5.0, 3)], "item_id long, id string, name string, num double, place int")
    cells = spark.createDataFrame([("p", 2.0, None), ("q", 0.0, None), ("z", 5.0, None), ("a", -10.0, None), ("b", 12.0, "=p*6"), ("w", 9.0, "=z+4")], "id string, num double, formula string")
    items = [(1, 1, "t", 1, "税后净现金流量", None, None)] if items is None else items
    points = [(1, "a", 5, -10.0, "2024"), (1, "b", 6, 12.0, "2025")] if points is None else points
    out = answers.answer(spark.createDataFrame(questions, "question_id long, question string"), params, cells, spark.createDataFrame(items, ITEMS), spark.createDataFrame(points, "item_id long, id string, col int, num double, period string"))
    return {(r.question_id, r.metric): r for r in out.collect()}


def test_tiers(spark):
    got = _answer(spark, [(1, "如果电价增加10%，IRR变成多少"), (2, "如果装机增加10%，IRR变成多少"), (3, "如果利率增加10%，IRR变成多少"), (4, "回收期是多少"), (5, "DSCR是多少"), (6, None), (7, "如果电价增加10%，NPV变成多少")])
    one = got[1, "irr_after_tax"]
    assert (one.tier, one.asked, one.param_before, one.param_after) == ("what_if", True, 2.0, pytest.approx(2.2))
    assert one.before == pytest.approx(0.2) and one.after == pytest.approx(0.32) and one.percent == pytest.approx(60)
    assert got[7, "npv_after_tax"].after == pytest.approx(-10 + 13.2 / 1.08) and got[7, "npv_after_tax"].asked and not got[7, "irr_after_tax"].asked
    still = got[2, "irr_after_tax"]  # the change reaches no metric
    assert still.tier == "what_if" and still.delta == 0
    assert got[3, "irr_after_tax"].tier == "metric"  # a parameter of 0 is none; the metric is still known
    assert got[4, "payback_period"].tier == "metric" and got[4, "payback_period"].before == pytest.approx(10 / 12)
    assert got[5, None].tier == got[6, None].tier == "open"


def test_a_metric_that_vanishes_and_no_metrics(spark):
    got = _answer(spark, [(1, "如果电价为-3，IRR变成多少"), (2, "如果电价为0，IRR变成多少")])
    assert got[2, "irr_after_tax"].before == pytest.approx(0.2) and got[2, "irr_after_tax"].after is None and got[2, "irr_after_tax"].delta is None
    got = _answer(spark, [(1, "如果电价增加10%，IRR变成多少"), (2, "IRR是多少")], [], [])
    assert got[1, None].tier == "what_if" and got[1, None].param_after == pytest.approx(2.2) and got[2, None].tier == "open"
    assert _answer(spark, []) == {}
