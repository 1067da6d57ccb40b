"""Counts by stage come with the run itself."""

import pytest
from pyspark.sql import functions as F

from quillgrid.operators.recalc import recalculate
from quillgrid.operators.stages import Stages, watch_recalculation


def _jobs(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    action()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_counts_need_no_job_of_their_own(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    stages = Stages()
    watched = stages.watch("in", rows, odd=F.col("id") % 2 == 1, none=F.lit(None).cast("boolean"))
    out = stages.watch("out", watched.groupBy("k").count(), big=F.col("count") > 142)
    plain = _jobs(spark, "plain", lambda: rows.groupBy("k").count().collect())
    assert _jobs(spark, "watched", lambda: out.collect()) == plain
    assert _jobs(spark, "report", stages.report) == 0
    assert stages.report() == {"in": {"rows": 1000, "odd": 500, "none": 0}, "out": {"rows": 7, "big": 6}}
    with pytest.raises(ValueError):
        stages.watch("in", rows)


def test_recalculation_and_no_rows(spark):
    cells = spark.createDataFrame([("a", 2.0, None), ("b", 4.0, "=a*2"), ("c", 0.5, "=1/a"), ("d", 1.0, '=IF(a=0,"none",1)'), ("e", 0.0, "=a*0"), ("f", 7.0, "=7+z")], "id string, num double, formula string")
    edits = spark.createDataFrame([("s", "a", 0.0)], "scenario string, id string, num double")
    stages = Stages()
    watch_recalculation(stages, recalculate(cells, edits)).collect()
    stages.watch("empty", cells.limit(0)).collect()
    assert stages.report() == {"recalculate": {"rows": 5, "errors": 1, "texts": 1, "blanks": 0, "moved": 4}, "empty": {"rows": 0}}
