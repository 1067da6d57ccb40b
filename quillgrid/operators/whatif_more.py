"""More what-if queries: matrices, comparisons, classification, simulation, ranks, over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.operators import whatif
from quillgrid.registry import Registry, table

#: The words of this table's types stand in for the domain's.
PART_CLASSES = [("investment", "STEEL|BRASS|NICKEL"), ("cost", "COPPER|TIN"), ("revenue", "")]

registry = Registry()
query = registry.query
STEPS = [-0.10, -0.05, 0.05, 0.10]


@query("""with p as (select p_brand as param, sum(p_retailprice) as value from part group by 1),
s as (select unnest([-0.10, -0.05, 0.05, 0.10])::double as perturbation)
select param, round(sum(case when perturbation = -0.10 then value * (1 + perturbation) - value end), 3) as p_m10, round(sum(case when perturbation = -0.05 then value * (1 + perturbation) - value end), 3) as p_m5,
  round(sum(case when perturbation = 0.05 then value * (1 + perturbation) - value end), 3) as p_5, round(sum(case when perturbation = 0.10 then value * (1 + perturbation) - value end), 3) as p_10 from p, s group by 1""")
def sensitivity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of total price by brand and perturbation, pivoted."""
    params = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("param")).agg(F.sum("p_retailprice").alias("value"))
    rows = whatif.perturb(params, STEPS).withColumn("metric", F.col("changed") - F.col("value"))
    out = whatif.matrix(rows, STEPS)
    return out.select("param", *(F.round(c, 3).alias(c) for c in out.columns[1:]))


@query("""with b as (select param, sum(value) as spread, max(case when perturbation > 0 and place_up = 1 then impact end) as up, max(case when perturbation < 0 and place_down = 1 then impact end) as down
from (select *, abs(impact) as value, row_number() over (partition by param, perturbation > 0 order by abs(perturbation)) as place_up, row_number() over (partition by param, perturbation > 0 order by abs(perturbation)) as place_down
      from (select p_type as param, perturbation, sum(p_retailprice) * perturbation as impact from part, (select unnest([-0.10, -0.05, 0.05, 0.10])::double as perturbation) s group by 1, 2)) group by 1)
select param, round(up, 3) as up, round(down, 3) as down, cast(row_number() over (order by round(greatest(abs(up), abs(down)), 3) desc, param) as int) as place from b""")
def tornado_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart rows: a parameter's impact at the perturbation nearest to zero on either side, by largest impact."""
    params = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("param")).agg(F.sum("p_retailprice").alias("value"))
    rows = whatif.perturb(params, STEPS).withColumn("impact", F.col("changed") - F.col("value"))
    side = lambda up: F.min_by(F.when((F.col("perturbation") > 0) == F.lit(up), F.col("impact")), F.when((F.col("perturbation") > 0) == F.lit(up), F.abs("perturbation")))
    out = rows.groupBy("param").agg(F.round(side(True), 3).alias("up"), F.round(side(False), 3).alias("down"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.greatest(F.abs("up"), F.abs("down"))), "param")))


SCENARIOS = "s(scenario, fr, fc) as (values ('base', 1.0::double, 1.0::double), ('pessimistic', 0.9, 1.1), ('optimistic', 1.1, 0.9))"
METRICS = f"""{SCENARIOS}, t as (select sum(l_extendedprice * (1 - l_discount)) as r, sum(l_extendedprice * l_tax) as c from lineitem),
m as (select scenario, 'revenue' as metric, r * fr as value from t, s union all select scenario, 'cost', c * fc from t, s union all select scenario, 'profit', r * fr - c * fc from t, s)"""


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario, metric, value) for three named scenarios."""
    grid = spark.createDataFrame([("base", 1.0, 1.0), ("pessimistic", 0.9, 1.1), ("optimistic", 1.1, 0.9)], "scenario string, fr double, fc double")
    li = table(spark, sf_dir, "lineitem")
    total = li.agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"), F.sum(F.col("l_extendedprice") * F.col("l_tax")).alias("c"))
    wide = grid.join(F.broadcast(total), how="cross").select("scenario", (F.col("r") * F.col("fr")).alias("revenue"), (F.col("c") * F.col("fc")).alias("cost"))
    return wide.withColumn("profit", F.col("revenue") - F.col("cost")).unpivot("scenario", ["revenue", "cost", "profit"], "metric", "value")


@query(f"""with {METRICS} select metric, round(max(case when scenario = 'base' then value end), 2) as base, round(max(case when scenario = 'pessimistic' then value end), 2) as pessimistic, round(max(case when scenario = 'optimistic' then value end), 2) as optimistic from m group by 1""")
def scenario_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by scenario."""
    out = _scenarios(spark, sf_dir).groupBy("metric").pivot("scenario", ["base", "pessimistic", "optimistic"]).agg(F.first("value"))
    return out.select("metric", *(F.round(c, 2).alias(c) for c in out.columns[1:]))


@query(f"""with {METRICS} select m.scenario, m.metric, round(m.value - b.value, 2) as delta, round((m.value - b.value) / b.value, 6) as share from m join m b on b.metric = m.metric and b.scenario = 'base' where m.scenario <> 'base'""")
def scenario_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scenario against the base."""
    rows = _scenarios(spark, sf_dir)
    base = rows.where("scenario = 'base'").select("metric", F.col("value").alias("base"))
    delta = F.col("value") - F.col("base")
    return rows.where("scenario <> 'base'").join(base, "metric").select("scenario", "metric", F.round(delta, 2).alias("delta"), F.round(delta / F.col("base"), 6).alias("share"))


@query("""select p_partkey, case when regexp_matches(upper(p_type), 'STEEL|BRASS|NICKEL|INVEST|CAPEX') then 'investment' when regexp_matches(upper(p_type), 'COPPER|TIN|COST|EXPENSE') then 'cost' else 'revenue' end as kind from part""")
def classify_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword class of each parameter; revenue by default."""
    return table(spark, sf_dir, "part").select("p_partkey", whatif.classify(F.col("p_type"), PART_CLASSES).alias("kind"))


N = 200  # iterations of a project
_X = "(({i} * 48271 + {p} * 16807 + {s} * 69621 + 12345) % 2147483647)"
for _ in range(3):
    _X = f"(({_X} * 48271) % 2147483647)"
U1, U2 = (f"(({_X.replace('{i}', 'i').replace('{p}', 'p').replace('{s}', s)}) + 0.5) / 2147483647::double" for s in ("1", "2"))
SIMULATED = f"""f as (select l_suppkey as project, ascii(l_returnflag)::bigint as p, sum(l_extendedprice) as t from lineitem group by 1, 2),
e as (select project, p, round(0.05 + (p - 65) / 1000.0, 6)::double * 4 * round(t / sum(t) over (partition by project), 6) - 0.1 as e, round(0.04 + 0.01 * count(*) over (partition by project), 6)::double as base from f),
z as (select project, i, p, e, base, 0.1 * sqrt(-2 * ln({U1})) * cos(2 * {math.pi!r}::double * {U2}) as change from range({N}) r(i), e),
v as (select project, i as iteration, greatest(-0.5, first(base) + sum(change * e)) as value from z group by 1, 2)"""


def _simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as projects; their parameters are their return flags, with an elasticity by the flag's share of the revenue."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("project"), F.ascii("l_returnflag").cast("long").alias("param_id")).agg(F.sum("l_extendedprice").alias("t"))
    # a project is a small row and much work, so rows are dealt by number and not by size
    f = f.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "project")
    own = Window.partitionBy("project")
    slope = F.round(0.05 + (F.col("param_id") - 65) / 1000.0, 6) * 4 * F.round(F.col("t") / F.sum("t").over(own), 6) - 0.1
    return whatif.linear_simulation(f.select("project", "param_id", slope.alias("elasticity"), F.round(0.04 + 0.01 * F.count("*").over(own), 6).alias("base")), N, ["project"])


@query(f"with {SIMULATED} select project, count(*) as n, round(avg(value), 8) as mean, round(stddev_pop(value), 8) as std, round(min(value), 8) as least, round(max(value), 8) as most, round(quantile_cont(value, 0.05), 8) as p5, round(quantile_cont(value, 0.25), 8) as p25, round(quantile_cont(value, 0.5), 8) as median, round(quantile_cont(value, 0.75), 8) as p75, round(quantile_cont(value, 0.95), 8) as p95 from v group by 1")
def mc_fast_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linearised Monte Carlo of each project: change times elasticity, in SQL only."""
    out = whatif.statistics(_simulated(spark, sf_dir), "value", ["project"])
    return out.select("project", "n", *(F.round(c, 8).alias(c) for c in out.columns[2:]))


@query(f"with {SIMULATED}, x as (select project, quantile_cont(value, [0, .05, .1, .15, .2, .25, .3, .35, .4, .45, .5, .55, .6, .65, .7, .75, .8, .85, .9, .95, 1]) as x from v group by 1) select project, cast(i * 5 as int) as percent, round(x[i + 1], 8) as value from x, range(21) r(i)")
def mc_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles 0 to 100 by 5 of each project."""
    steps = [i / 20 for i in range(21)]
    row = _simulated(spark, sf_dir).groupBy("project").agg(F.percentile("value", F.array(*map(F.lit, steps))).alias("p"))
    return row.select("project", F.posexplode("p").alias("i", "v")).select("project", (F.col("i") * 5).cast("int").alias("percent"), F.round("v", 8).alias("value"))


@query(f"with {SIMULATED}, t as (select unnest([0.04, 0.06, 0.08, 0.10])::double as threshold) select project, threshold, round(avg(case when value >= threshold then 1.0 else 0 end), 6) as at_least, round(avg(case when value > threshold then 1.0 else 0 end), 6) as above from v, t group by 1, 2")
def mc_prob_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a project's runs at or above, and above, each threshold."""
    each = _simulated(spark, sf_dir).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.04, 0.06, 0.08, 0.10)))))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return each.groupBy("project", "threshold").agg(share(F.col("value") >= F.col("threshold")).alias("at_least"), share(F.col("value") > F.col("threshold")).alias("above"))


@query(f"with {SIMULATED} select project, count(*) as n, round(avg(value), 8) as mean, round(avg(value) - 1.96 * stddev_pop(value) / sqrt(count(*)), 8) as low, round(avg(value) + 1.96 * stddev_pop(value) / sqrt(count(*)), 8) as high from v group by 1 having count(*) >= 30")
def mc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each project and its normal interval."""
    out = whatif.confidence(_simulated(spark, sf_dir), "value", ["project"])
    return out.select("project", "n", *(F.round(c, 8).alias(c) for c in ("mean", "low", "high")))


@query(f"""with {SIMULATED}, x as (select project, count(*) as n, min(value) as a, max(value) as b, greatest(10, least(50, count(*) // 20)) as bins from v group by 1)
select project, cast(least(bins - 1, floor((value - a) / ((b - a) / bins))) as int) as bin, count(*) as n from v join x using (project) group by 1, 2""")
def mc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each project by bin of the result."""
    return whatif.histogram(_simulated(spark, sf_dir), "value", ["project"]).select("project", "bin", "n")


@query("""with s as (select c_nationkey, sum(o_totalprice) as base, sum(o_totalprice * (1 + 0.1 * (o_orderkey % 3 = 0)::int)) as moved from orders join customer on c_custkey = o_custkey group by 1)
select c_nationkey, round((moved - base) / base / 0.1, 8) as elasticity from s""")
def elasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of a nation's total between two points, over the relative change of a third of its orders."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    moved = F.col("o_totalprice") * (1 + 0.1 * (F.col("o_orderkey") % 3 == 0).cast("int"))
    sums = o.groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("base"), F.sum(moved).alias("moved"))
    return sums.select("c_nationkey", F.round((F.col("moved") - F.col("base")) / F.col("base") / 0.1, 8).alias("elasticity"))


PROJECTS = "p as (select n_name as project, round(sum(o_totalprice), 2) as revenue, round(avg(o_totalprice), 4) as mean, count(*)::double as risk from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1), u as (select project, 'revenue' as metric, revenue as value from p union all select project, 'mean', mean from p union all select project, 'risk', risk from p)"


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, metric, value): nations as projects."""
    by_cust = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    nation = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("project")))  # 25 rows by definition
    each = by_cust.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(nation, "c_nationkey")
    wide = each.groupBy("project").agg(F.round(F.sum("s"), 2).alias("revenue"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean"), F.sum("n").cast("double").alias("risk"))
    return wide.unpivot("project", ["revenue", "mean", "risk"], "metric", "value")


@query(f"with {PROJECTS} select project, metric, value, cast(row_number() over (partition by metric order by case when metric = 'risk' then value else -value end, project) as int) as place from u")
def rank_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by metric; more is better but for risk."""
    return whatif.rank(_projects(spark, sf_dir), {"revenue": True, "mean": True, "risk": False}).select("project", "metric", "value", "place")


@query(f"with {PROJECTS} select project, metric, round(case when max(value) over w - min(value) over w < 1e-10 then 0.5 else (value - min(value) over w) / (max(value) over w - min(value) over w) end, 6) as scaled from u window w as (partition by metric)")
def scenario_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics scaled to 0..1."""
    return whatif.radar(_projects(spark, sf_dir)).select("project", "metric", F.round("scaled", 6).alias("scaled"))


@query("""with t as (select sum(l_extendedprice) as e, sum(l_extendedprice * l_discount) as d from lineitem)
select round((1 - 0.9) * e / d, 3) as discount_factor, true as found from t""")
def break_even_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor on discounts at which net revenue is 90 % of gross: a search whose rounds are scenario tables."""
    li = table(spark, sf_dir, "lineitem")
    total = li.agg(F.sum("l_extendedprice").alias("e"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("d")).persist()
    evaluate = lambda c: c.join(F.broadcast(total), how="cross").select("candidate", ((F.col("e") - F.col("d") * F.col("candidate")) / F.col("e")).alias("metric"))
    got = whatif.break_even(evaluate, spark, 0.0, 20.0, 0.9)
    total.unpersist()
    return spark.createDataFrame([(round(got.get("value") or 0.0, 3), got["found"])], "discount_factor double, found boolean")
