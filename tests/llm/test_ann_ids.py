"""Queries whose id has several rows."""

import numpy as np
from pyspark.sql import functions as F

from quillgrid.llm import ann


def test_an_id_with_bad_and_good_rows_still_asks(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(1, 40)]
    vec = good[19][1]
    for bad in ([(20, None)], [(20, [1.0])], [(20, [0.0] * 4)], [(20, [float("inf")] * 4), (20, vec)]):
        df = spark.createDataFrame(bad + good, "id long, vec array<double>")
        got = [(r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("id") == 20, 3).orderBy("rank").collect()]
        want = sorted((float(np.linalg.norm(np.array(v) - vec)), i) for i, v in good if i != 20)[:3]
        assert got == [(n + 1, i) for n, (_, i) in enumerate(want)]


def test_an_id_with_two_good_vectors_asks_with_the_least(spark):
    rows = [(20, [5.0, 5.0]), (20, [1.0, 9.0]), (1, [1.0, 8.0]), (2, [5.0, 4.0]), (3, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    assert [r["vec_id"] for r in ann.nearest(df, F.col("id") == 20, 1).collect()] == [1]
