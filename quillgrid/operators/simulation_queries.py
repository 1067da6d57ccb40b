"""Simulations, scenarios and returns of the whole model, with SQL: the model's SQL over varied parameters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import model, simulation
from quillgrid.operators.model_queries import FULL, projects
from quillgrid.registry import Registry

registry = Registry()
query = registry.query

RUNS = 40
VARIED = [
    simulation.Distribution("grid_price", "normal"),
    simulation.Distribution("pump_price", "uniform", low=-0.02, high=0.03),
    simulation.Distribution("hours", "triangular"),
    simulation.Distribution("capacity_price", "lognormal", sigma=0.05),
]
NPVS = ["npv_total", "npv_equity"]


def _uniform_sql(p: int, stream: int) -> str:
    x = f"((run * 48271 + {p * 16807 + stream * 69621 + 12345}) % 2147483647)"
    for _ in range(3):
        x = f"(({x} * 48271) % 2147483647)"
    return f"(({x} + 0.5) / 2147483647::double)"


def _normal_sql(p: int) -> str:
    return f"(sqrt(-2 * ln({_uniform_sql(p, 1)})) * cos(2 * {math.pi!r}::double * {_uniform_sql(p, 2)}))"


def _full_over(configs: str) -> str:
    """The model's SQL over other configs: project, mw, b, price, and grid, pump and hours in place of constants."""
    rest = FULL[FULL.index("y as (") :]
    for fixed, name in (("1169.29::double", "hours"), ("0.35::double", "grid"), ("0.23085::double", "pump")):
        rest = rest.replace(fixed, name)
    return f"{configs},\n{rest}"


_OWN = "own as (select s_suppkey as own, 600 + (s_suppkey % 13) * 100.0::double as mw, 4 + s_suppkey % 4 as b, 500 + (s_suppkey % 7) * 50.0::double as price from supplier)"
_U3 = _uniform_sql(3, 3)
SIMULATED = _full_over(f"""{_OWN}, draw as (select run, 0.35::double + 0.35::double * 0.1::double * {_normal_sql(1)} as grid, 0.23085::double - 0.02::double + 0.05::double * {_uniform_sql(2, 3)} as pump,
  case when {_U3} < 0.5 then 1169.29::double * 0.9::double + sqrt({_U3} * 0.2::double * 0.1::double) * 1169.29::double else 1169.29::double * 1.1::double - sqrt((1 - {_U3}) * 0.2::double * 0.1::double) * 1169.29::double end as hours, {_normal_sql(4)} as z from range({RUNS}) r(run)),
c as (select own * {RUNS} + run as project, mw, b, exp(ln(price) + 0.05::double * z) as price, greatest(0.0, grid) as grid, greatest(0.0, pump) as pump, greatest(0.0, hours) as hours from own, draw)""") + f""",
n as (select project, sum(cf_total / power(1.08::double, i)) as npv_total, sum(cf_equity / power(1.08::double, i)) as npv_equity from h group by 1),
u as (select project // {RUNS} as project, 'npv_total' as metric, npv_total as value from n union all select project // {RUNS}, 'npv_equity', npv_equity from n)"""


def _simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = simulation.draws(model.schedule(projects(spark, sf_dir)), VARIED, RUNS)
    return simulation.long_metrics(model.metrics(model.operate(runs)), NPVS)


@query(f"""with recursive {SIMULATED} select project, metric, count(*) as n, round(avg(value), 2) as mean, round(stddev_samp(value), 2) as std, round(min(value), 2) as least, round(max(value), 2) as most,
round(quantile_cont(value, 0.1), 2) as p10, round(quantile_cont(value, 0.25), 2) as p25, round(quantile_cont(value, 0.5), 2) as p50, round(quantile_cont(value, 0.75), 2) as p75, round(quantile_cont(value, 0.9), 2) as p90 from u group by 1, 2""")
def model_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parameters of every project drawn from four kinds of distribution; statistics of its net present values."""
    out = simulation.statistics(_simulated(spark, sf_dir))
    return out.select("project", "metric", "n", *(F.round(c, 2).alias(c) for c in out.columns[3:]))


@query(f"""with recursive {SIMULATED} select project, metric, round(quantile_cont(value, 0.025), 2) as low, round(quantile_cont(value, 0.975), 2) as high, round(avg(case when value > 0 then 1.0 else 0 end), 6) as above from u group by 1, 2""")
def model_mc_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of 95 % of a project's runs, and the share of them above zero."""
    out = simulation.interval(_simulated(spark, sf_dir))
    return out.select("project", "metric", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), F.round("above", 6).alias("above"))


NAMED = _full_over(f"""{_OWN}, named(k, run, grid, pump, hours) as (values (0, 'pessimistic', 0.315::double, 0.2539::double, 1052.36::double), (1, 'base', 0.35, 0.23085, 1169.29), (2, 'optimistic', 0.385, 0.2078, 1286.22)),
c as (select own * 3 + k as project, mw, b, price, grid, pump, hours from own, named)""") + """,
a as (select project // 3 as project, run, sum(cf_total / power(1.08::double, i)) as npv_total, sum(cf_equity / power(1.08::double, i)) as npv_equity, sum(profit_equity - tax_equity) / sum(revenue) as margin from h join named on named.k = project % 3 group by h.project, run),
e as (select project, run, 'npv_total' as metric, npv_total as value from a union all select project, run, 'npv_equity', npv_equity from a union all select project, run, 'margin', margin from a)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.long_metrics(model.metrics(model.operate(simulation.scenarios(model.schedule(projects(spark, sf_dir))))), [*NPVS, "margin"])


@query(f"with recursive {NAMED} select project, run as scenario, metric, round(value, 3) as value from e")
def model_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every project in the three named scenarios."""
    return _named(spark, sf_dir).select("project", F.col("run").alias("scenario"), "metric", F.round("value", 3).alias("value"))


@query(f"""with recursive {NAMED}, wide as (select project, metric, max(case when run = 'pessimistic' then value end) as p, max(case when run = 'base' then value end) as b, max(case when run = 'optimistic' then value end) as o from e group by 1, 2)
select project, metric, round(p, 3) as pessimistic, round(b, 3) as base, round(o, 3) as optimistic, round(p - b, 3) as pessimistic_delta, round(o - b, 3) as optimistic_delta from wide""")
def model_scenario_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named scenarios side by side, with their distance from the base."""
    out = simulation.compared(_named(spark, sf_dir), list(simulation.SCENARIOS))
    return out.select("project", "metric", *(F.round(c, 3).alias(c) for c in out.columns[2:]))


_ROOT = """{name}(project, lo, hi, step) as (select project, -0.5::double, 1.0::double, 0 from flows
  union all select project, case when up = (v > 0) then mid else lo end, case when up = (v > 0) then hi else mid end, step + 1
  from (select r.project, lo, hi, step, (lo + hi) / 2 as mid, list_sum(list_transform({flow}, lambda f: f.v * power(1 + lo, -f.t))) > 0 as up, list_sum(list_transform({flow}, lambda f: f.v * power(1 + (lo + hi) / 2, -f.t))) as v
        from {name} r join flows using (project) where step < 50))"""

#: A return is given where the value changes its sign between the ends of the search.
_BRACKET = "(list_sum(list_transform({flow}, lambda f: f.v * power(0.5::double, -f.t))) > 0) <> (list_sum(list_transform({flow}, lambda f: f.v * power(2.0::double, -f.t))) > 0)"


@query(f"""with recursive {FULL},
flows as (select project, list({{'v': cf_total, 't': date_diff('day', date '2024-12-31', make_date(cast(2024 + i as int), 12, 31)) / 365.0::double}} order by i) as total, list({{'v': cf_equity, 't': date_diff('day', date '2024-12-31', make_date(cast(2024 + i as int), 12, 31)) / 365.0::double}} order by i) as equity from h group by 1),
{_ROOT.format(name="rt", flow="total")}, {_ROOT.format(name="re", flow="equity")}
select project, case when {_BRACKET.format(flow="total")} then round(rt.lo, 7) end as irr_total, case when {_BRACKET.format(flow="equity")} then round(re.lo, 7) end as irr_equity
from rt join re using (project) join flows using (project) where rt.step = 50 and re.step = 50""")
def model_irr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal rates of return of both cash flows, on dates."""
    out = model.metrics(model.run(projects(spark, sf_dir)))
    return out.select("project", F.round("irr_total", 7).alias("irr_total"), F.round("irr_equity", 7).alias("irr_equity"))
