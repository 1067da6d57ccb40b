"""Investment by year and coverage on small projects, nulls and empty ones among them."""

import pytest

from quillgrid.operators import investment


def _frames(spark, items, projects):
    return spark.createDataFrame(items, "project string, year int, item string, amount double"), spark.createDataFrame(projects, "project string, start_year int, end_year int, escalation double")


def test_by_year_and_coverage(spark):
    items, projects = _frames(
        spark,
        [("a", 2024, "x", 100.0), ("a", 2025, "x", 60.0), ("a", 2025, "y", 40.0), ("a", 2025, None, None), ("b", 2024, "x", 50.0), ("b", 2025, "x", 40.0), ("b", 2025, investment.CONTINGENCY, 10.0), ("c", 2030, "x", 0.0), (None, 2024, "x", 1.0), ("a", None, "x", 1.0)],
        [("a", 2024, 2025, 0.1), ("b", 2024, 2026, 0.5), ("c", 2024, 2025, None), ("d", 2024, 2025, 0.1), ("e", None, 2025, 0.1)],
    )
    got = {(r.project, r.year): tuple(r)[2:] for r in investment.by_year(items, projects).collect()}
    assert got[("a", 2024)] == (100.0, 0.0, 100.0, pytest.approx(100 / 221)) and got[("a", 2025)] == (100.0, pytest.approx(21.0), pytest.approx(121.0), pytest.approx(121 / 221))
    assert got[("b", 2024)] == (50.0, 0.0, 50.0, 0.5) and got[("b", 2025)] == (40.0, 10.0, 50.0, 0.5) and got[("c", 2030)] == (0.0, 0.0, 0.0, 0.0) and len(got) == 5
    fits = {r.project: (r.missing, r.extra) for r in investment.coverage(items, projects).collect()}
    assert fits == {"b": ([2026], []), "c": ([2024, 2025], [2030]), "d": ([2024, 2025], [])}


def test_nothing(spark):
    items, projects = _frames(spark, [], [])
    assert investment.by_year(items, projects).count() == 0 and investment.coverage(items, projects).count() == 0
