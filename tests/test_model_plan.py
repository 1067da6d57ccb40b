"""The model's plan: no statement is computed inside another one's walk over the years."""

import pytest

from quillgrid.operators import model, simulation, simulation_queries
from quillgrid.operators.model_queries import projects

SF = "/root/testdata/sf0.001"


def test_steps_of_the_model_stay_apart(spark):
    was = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        runs = simulation.draws(projects(spark, SF), simulation_queries.VARIED, 2)
        plan = model.metrics(model.run(runs)).select("project", "npv_total")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", was)
    assert any(" AS cf_total#" in line for line in plan.split("\n"))
    assert not any(" AS cf_total#" in line and "used_loss" in line for line in plan.split("\n"))


def test_projects_are_dealt_to_many_tasks(spark):
    assert projects(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_what_runs_share_is_computed_before_they_are_exploded(spark):
    """The schedule is computed once a project; the drawn parameters come in above it."""
    was = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = simulation_queries._simulated(spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", was)
    drawn, owed = (next(n for n, line in enumerate(plan) if f" AS {c}#" in line) for c in ("grid_price", "debt_in"))
    assert drawn < owed


def test_scheduled_parameters_are_not_changed_after_the_schedule(spark):
    with pytest.raises(ValueError, match="loan_rate"):
        simulation.draws(model.schedule(projects(spark, SF)), [simulation.Distribution("loan_rate")], 2)
