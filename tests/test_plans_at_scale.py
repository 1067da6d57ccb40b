"""Plans of queries whose small inputs are exploded: nothing that grows is broadcast, sorted in one task or shuffled again."""

import re

from pyspark.sql import functions as F

from quillgrid.operators import graph, recalc
from quillgrid.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_are_not_broadcast_for_the_histogram(spark):
    assert "Broadcast" not in _plan(QUERIES["mc_histogram"](spark, SF))


def test_pieces_of_names_are_not_broadcast(spark):
    assert "Broadcast" not in _plan(QUERIES["retrieval_score"](spark, SF))


def test_runs_are_not_shuffled_by_iteration(spark):
    for name in ("mc_fast_stats", "mc_percentiles", "mc_confidence", "mc_prob_above"):
        assert not re.search(r"hashpartitioning\([^)]*iteration", _plan(QUERIES[name](spark, SF)))


def test_no_type_of_events_is_ranked_in_one_task(spark):
    plan = _plan(QUERIES["approximate_aggregates"](spark, SF))
    assert "1000000" not in plan and "distinct user_id" not in plan


def test_shortest_path_is_the_first_as_text(spark):
    edges = spark.createDataFrame([("c1", "s1"), ("c1", "s10"), ("s1", "x"), ("s10", "x"), ("x", "y")], "src string, dst string")
    assert [tuple(r) for r in graph.shortest_path(edges, "c1", "y").collect()] == [(3, ["c1", "s10", "x", "y"])]


def test_simulated_projects_are_dealt_by_number(spark):
    """They are small rows and much work; joined by size they would be few tasks."""
    for name in ("mc_fast_stats", "mc_percentiles", "mc_confidence", "mc_prob_above"):
        assert "REPARTITION_BY_NUM" in _plan(QUERIES[name](spark, SF))


def test_the_best_items_are_found_without_a_broadcast(spark):
    assert "Broadcast" not in _plan(QUERIES["retrieval_topk"](spark, SF))


def test_parts_of_ranges_are_not_broadcast(spark):
    """Tables that are small as files may hold many rows; the parts of ranges are dealt by scenario and range."""
    cells = spark.createDataFrame([("S!A1", 1.0, None, None), ("S!A2", 2.0, None, None), ("S!B1", 3.0, "=SUM(A1:A2)", None)], "id string, num double, formula string, txt string")
    run = recalc._Run(cells, spark.createDataFrame([("s", "S!A1", 5.0, None)], "scenario string, id string, num double, txt string"))
    run.fixed = None
    run.push(run.edits.select("scenario", "id", *recalc._typed(F.col("num"), F.col("txt"), F.lit(None).cast("string"))))
    level = next(level for level, kind in run.kinds if kind == "range")
    out = run.values(run.folders.get("inbox", recalc.INBOX, level), level)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r["scenario"], r["n"]) for r in out.collect()] == [("s", 7.0)]
