"""Simulations and scenarios of the whole project model: every run is a row of the model's plan.

Runs are made by exploding each project's row, so nothing is joined or shuffled before the statistics. A run's project is a
struct (project, run), which the model passes through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.operators import model, whatif

# Parameters that can't be negative.
NON_NEGATIVE = ["grid_price", "pump_price", "capacity_price", "capacity_mw", "hours"]
# Overrides of the three named scenarios.
SCENARIOS = {
    "pessimistic": {"grid_price": 0.315, "pump_price": 0.2539, "hours": 1052.36},
    "base": {},
    "optimistic": {"grid_price": 0.385, "pump_price": 0.2078, "hours": 1286.22},
}


@dataclass(frozen=True)
class Distribution:
    """How a parameter varies around its value; offsets and std are absolute, a tenth of the value by default."""

    param: str
    kind: str = "normal"  # normal, uniform, triangular, lognormal
    std: float | None = None
    low: float | None = None
    high: float | None = None
    sigma: float = 0.1  # of the logarithm, for lognormal; the value is the median

    def draw(self, u: Column, z: Column) -> Column:
        """A value from a number in (0, 1), or from a standard normal one."""
        v = F.col(self.param)
        or_tenth = lambda x, sign=1: F.lit(x) if x is not None else v * (0.1 * sign)
        low, high = or_tenth(self.low, -1), or_tenth(self.high)
        if self.kind == "normal":
            return v + or_tenth(self.std) * z
        if self.kind == "uniform":
            return v + low + (high - low) * u
        if self.kind == "triangular":
            rising = v + low + F.sqrt(u * (high - low) * -low)
            return F.when(u < -low / (high - low), rising).otherwise(v + high - F.sqrt((1 - u) * (high - low) * high))
        if self.kind == "lognormal":
            return F.exp(F.when(v > 0, F.log(v)).otherwise(0.0) + self.sigma * z)
        raise ValueError(f"no distribution {self.kind}")


def _after_schedule(configs: DataFrame, changed: set[str]) -> None:
    if "loan" in configs.columns and changed & model.SCHEDULED:
        raise ValueError(f"the schedule follows from {sorted(changed & model.SCHEDULED)}: change them before it")


def draws(configs: DataFrame, distributions: list[Distribution], iterations: int) -> DataFrame:
    """The configs once for each iteration with their parameters drawn; arrays by year (capex) are left as they are.

    Configs may have their schedule already, unless a drawn parameter is one of those it follows from.
    """
    _after_schedule(configs, {d.param for d in distributions})
    kinds = dict(configs.dtypes)
    each = configs.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)).cast("array<bigint>")))
    drawn = {}
    for k, d in enumerate(distributions, 1):
        if kinds[d.param].startswith("array"):
            continue
        i, p = F.col("run"), F.lit(k).cast("bigint")
        value = d.draw(whatif.uniform(i, p, 3), whatif.normal(i, p))
        drawn[d.param] = F.greatest(F.lit(0.0), value) if d.param in NON_NEGATIVE else value
    return each.withColumns(drawn | {"project": F.struct("project", "run")}).drop("run")


def scenarios(configs: DataFrame, overrides: dict[str, dict[str, float]] = SCENARIOS) -> DataFrame:
    """The configs once for each named scenario, with its parameters in place of their own; they may have their schedule, as in ``draws``."""
    _after_schedule(configs, {p for o in overrides.values() for p in o})
    each = configs.withColumn("run", F.explode(F.array(*map(F.lit, overrides))))
    changed = {}
    for param in sorted({p for o in overrides.values() for p in o}):
        value = F.col(param)
        for name, o in overrides.items():
            if param in o:
                value = F.when(F.col("run") == name, F.lit(o[param])).otherwise(value)
        changed[param] = value
    return each.withColumns(changed | {"project": F.struct("project", "run")}).drop("run")


def long_metrics(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(project, run, metric, value) from the model's metrics of runs."""
    wide = metrics.select("project.project", "project.run", *(F.col(n).cast("double") for n in names))
    return wide.unpivot(["project", "run"], names, "metric", "value")


def statistics(runs: DataFrame) -> DataFrame:
    """By project and metric: n, mean, sample std, least, most, p10 to p90. A group holds the iterations of one project."""
    points = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
    at = F.percentile("value", F.array(*map(F.lit, points.values())))
    out = runs.groupBy("project", "metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("least"), F.max("value").alias("most"), at.alias("at"),
    )
    return out.select("*", *(F.get("at", F.lit(i)).alias(n) for i, n in enumerate(points))).drop("at")


def interval(runs: DataFrame, level: float = 0.95, threshold: float = 0.0) -> DataFrame:
    """By project and metric: the percentiles that hold ``level`` of the runs, and the share of runs strictly above threshold."""
    cut = (1 - level) / 2
    ends = F.percentile("value", F.array(F.lit(cut), F.lit(1 - cut)))
    out = runs.groupBy("project", "metric").agg(ends.alias("ends"), F.avg((F.col("value") > threshold).cast("double")).alias("above"))
    return out.select("project", "metric", F.get("ends", F.lit(0)).alias("low"), F.get("ends", F.lit(1)).alias("high"), "above")


def compared(runs: DataFrame, names: list[str], base: str = "base") -> DataFrame:
    """(project, metric, a column for each scenario, and <scenario>_delta to the base)."""
    wide = runs.groupBy("project", "metric").agg(*(F.max(F.when(F.col("run") == n, F.col("value"))).alias(n) for n in names))
    return wide.select("*", *((F.col(n) - F.col(base)).alias(f"{n}_delta") for n in names if n != base))
