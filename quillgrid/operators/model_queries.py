"""Project model queries: a project a supplier, with parameters that follow from its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import model
from quillgrid.registry import Registry, table

registry = Registry()
query = registry.query


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    mw, build = 600 + (k % 13) * 100.0, (4 + k % 4).cast("int")
    asset = lambda name, per_mw, residual, life: F.struct(F.lit(name).alias("name"), (mw * per_mw).alias("original"), F.lit(residual).alias("residual"), F.lit(life).alias("life"))
    fixed = {"equity_ratio": 0.25, "construction_rate": 0.043, "loan_rate": 0.043, "subsidy": 10000.0, "working_capital": 700.0, "hours": 1169.29, "grid_price": 0.35, "pump_price": 0.23085, "aux_rate": 0.02, "vat_rate": 0.13, "surcharge_rate": 0.1, "prepaid_amount": 500.0}
    # a project is a small row and much work, so rows are dealt by number and not by size
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "supplier").repartition(tasks, "s_suppkey").select(
        k.alias("project"), F.lit(2024).alias("start_year"), build.alias("build_years"), F.lit(20).alias("op_years"),
        F.array_repeat(mw * 600 / build, build).alias("capex"), mw.alias("capacity_mw"), (500 + (k % 7) * 50.0).alias("capacity_price"),
        F.lit(15).alias("loan_years"), (mw * 60).alias("input_vat"), F.lit(10).alias("input_vat_years"),
        F.array(asset("fixed", 550, 0.05, 29.0), asset("intangible", 50, 0.0, 18.0)).alias("assets"),
        F.lit(5).alias("prepaid_cycle"), F.lit(5).alias("prepaid_period"), F.lit(None).cast("array<double>").alias("ratios"),
        *(F.lit(v).alias(n) for n, v in fixed.items()),
    )


YEARS = """c as (select s_suppkey as project, 600 + (s_suppkey % 13) * 100.0::double as mw, 4 + s_suppkey % 4 as b, 500 + (s_suppkey % 7) * 50.0::double as price from supplier),
y as (select *, unnest(range(0, b + 20)) as i from c), q as (select *, case when i >= b then 1.0::double else 0 end as ratio from y),
v as (select *, mw * price * ratio / 10 / 1.13::double as cap, mw * 1169.29::double * ratio * 0.98::double * 0.35::double / 10 / 1.13::double as energy,
  case when i >= b then greatest(0.0, least(mw * 60 / 10, mw * 60 - mw * 6 * (i - b))) else 0 end as ded,
  ((mw * 550 * 0.95::double / 29 + mw * 50 / 18) * ratio + 100 * ratio) as dep from q),
w as (select *, cap + energy as revenue, greatest(0.0, (cap + energy) * 0.13::double - ded) * 0.1::double as surcharge,
  ratio * (mw * 0.02::double + mw * 1169.29::double / 0.75::double * 0.23085::double / 10 + mw * 600 * 0.0083::double + 2777.5::double) + dep as cost from v)"""


@query(f"with {YEARS} select project, cast(2024 + i as int) as year, round(cap, 6) as capacity_revenue, round(energy, 6) as energy_revenue, round(ded, 6) as vat_deducted, round(surcharge, 6) as surcharge, round(dep, 6) as depreciation, round(cost, 6) as production_cost from w")
def model_revenue_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue, VAT, surcharge, depreciation and cost by year."""
    columns = ["capacity_revenue", "energy_revenue", "vat_deducted", "surcharge", "depreciation", "production_cost"]
    out = model.by_year(model.run(projects(spark, sf_dir)), columns)
    return out.select("project", "year", *(F.round(c, 6).alias(c) for c in columns))


FULL = f"""{YEARS},
f(project, i, debt, interest) as (
  select project, 0::bigint, mw * 600 / b * 0.75 * (1 + 0.0215::double), mw * 600 / b * 0.75 * 0.0215::double from c
  union all select f.project, f.i + 1, f.debt * 1.043::double + mw * 600 / b * 0.75 * (1 + 0.0215::double), f.debt * 0.043::double + mw * 600 / b * 0.75 * 0.0215::double from f join c using (project) where f.i + 1 < b),
l as (select project, sum(interest) as capitalised from f group by 1),
d as (select w.*, (mw * 600 + capitalised) * 0.75 as p, case when w.i < w.b then mw * 600 / w.b else 0 end as invested, coalesce(f.interest, 0) as built from w join l using (project) left join f on f.project = w.project and f.i = w.i),
m as (select *, p * 0.043::double / (1 - power(1.043::double, -15)) as pay, i - b as k from d),
o as (select *, case when k between 1 and 15 then (p * power(1.043::double, k - 1) - pay * (power(1.043::double, k - 1) - 1) / 0.043::double) * 0.043::double else 0 end as interest from m),
s as (select *, case when k between 1 and 15 then pay - interest else 0 end as principal, revenue - surcharge - cost as profit_total, revenue - surcharge - cost - interest as profit_equity from o),
x as (select project, i, 'total' as side, profit_total as profit from s union all select project, i, 'equity', profit_equity from s),
t(project, side, i, profit, l1, l2, l3, l4, l5, used) as (
  select project, side, i, profit, greatest(0.0, -profit), 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double from x where i = 0
  union all select n.project, n.side, n.i, n.profit, greatest(0.0, -n.profit),
    greatest(0.0, t.l1 - greatest(0.0, greatest(0.0, n.profit) - t.l5 - t.l4 - t.l3 - t.l2)), greatest(0.0, t.l2 - greatest(0.0, greatest(0.0, n.profit) - t.l5 - t.l4 - t.l3)),
    greatest(0.0, t.l3 - greatest(0.0, greatest(0.0, n.profit) - t.l5 - t.l4)), greatest(0.0, t.l4 - greatest(0.0, greatest(0.0, n.profit) - t.l5)),
    least(greatest(0.0, n.profit), t.l1 + t.l2 + t.l3 + t.l4 + t.l5)
  from t join x n on n.project = t.project and n.side = t.side and n.i = t.i + 1),
g as (select s.*, greatest(0.0, a.profit - a.used) * 0.25 as tax_total, greatest(0.0, e.profit - e.used) * 0.25 as tax_equity,
  case when s.i = b + 19 then mw * 550 * 0.05::double + 700 else 0 end as ends, case when s.i = b then 700 else 0 end as started, cost - dep + surcharge as running
  from s join t a on a.project = s.project and a.i = s.i and a.side = 'total' join t e on e.project = s.project and e.i = s.i and e.side = 'equity'),
h as (select *, revenue + ends - (invested - 10000 * invested / (mw * 600)) - started - running - tax_total as cf_total,
  revenue + ends + (invested + built) * 0.75 - (invested + built) * 0.25 - started - running - tax_equity - principal - interest as cf_equity from g)"""


@query(f"with recursive {FULL} select project, cast(2024 + i as int) as year, round(interest, 5) as interest, round(principal, 5) as principal, round(tax_total, 5) as tax_total, round(tax_equity, 5) as tax_equity, round(cf_total, 5) as cf_total, round(cf_equity, 5) as cf_equity from h")
def model_cash_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debt service, taxes and both cash flows by year."""
    columns = ["interest", "principal", "tax_total", "tax_equity", "cf_total", "cf_equity"]
    out = model.by_year(model.run(projects(spark, sf_dir)), columns)
    return out.select("project", "year", *(F.round(c, 5).alias(c) for c in columns))


@query(f"""with recursive {FULL}, cum as (select *, sum(cf_total) over (partition by project order by i) as total from h),
pay as (select project, min(case when i = 0 and total >= 0 then 0.0 when total >= 0 and cf_total > 0 then i - 1 + abs(total - cf_total) / cf_total end) as payback from cum group by 1),
r as (select project, sum(cf_total / power(1.08::double, i)) as npv_total, sum(cf_equity / power(1.08::double, i)) as npv_equity, min(case when principal + interest > 0 then (profit_equity + interest + dep) / (principal + interest) end) as dscr_min, sum(profit_equity - tax_equity) / sum(revenue) as margin from h group by 1)
select project, round(npv_total, 4) as npv_total, round(npv_equity, 4) as npv_equity, round(payback, 2) as payback, round(dscr_min, 4) as dscr_min, round(margin, 8) as margin from r join pay using (project)""")
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return metrics of every project."""
    out = model.metrics(model.run(projects(spark, sf_dir)))
    return out.select("project", F.round("npv_total", 4).alias("npv_total"), F.round("npv_equity", 4).alias("npv_equity"), "payback", "dscr_min", F.round("margin", 8).alias("margin"))


@query("""with p as (select s_suppkey as project, date '2023-02-01' + cast(s_suppkey % 28 as int) as a, date '2030-07-31' as b from supplier),
e as (select project, a as d from p union select project, b from p union select project, date '2030-08-31' from p union select project, date '2050-07-31' from p
  union select project, make_date(y, 12, 31) from p, range(2023, 2030) r(y) union select project, make_date(y, 12, 31) from p, range(2030, 2050) r(y)),
i as (select project, d as period_start, lead(d) over (partition by project order by d) as period_end from e)
select project, period_start, period_end, cast(round_even(date_diff('day', period_start, period_end) / 30.0, 0) as int) as months, cast(year(period_end) as int) as end_year, case when period_end >= date '2030-08-01' then 'operation' else 'construction' end as phase from i where period_end is not null""")
def model_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of construction and operation."""
    day = lambda d: F.lit(d).cast("date")
    params = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project"), F.date_add(day("2023-02-01"), (F.col("s_suppkey") % 28).cast("int")).alias("start"), day("2030-07-31").alias("end"), day("2030-08-01").alias("op_start"), day("2050-07-31").alias("op_end"), F.lit(None).cast("array<date>").alias("milestones"))
    return model.timeline(params)


@query(f"with recursive {FULL} select project, cast(2024 + i as int) as year, round(revenue - running - tax_equity, 4) as cf_operating, round(ends - invested - (invested + built) * 0.25 - started, 4) as cf_investing, round((invested + built) * 0.75 - principal - interest, 4) as cf_financing from h")
def model_plan_cash_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operating, investing and financing cash flows by year."""
    columns = ["cf_operating", "cf_investing", "cf_financing"]
    out = model.by_year(model.run(projects(spark, sf_dir)), columns)
    return out.select("project", "year", *(F.round(c, 4).alias(c) for c in columns))


@query(f"""with recursive {FULL}, dis as (select project, i, cf_total / power(1.08::double, i) as v from h), cum as (select *, sum(v) over (partition by project order by i) as total from dis),
pay as (select project, min(case when i = 0 and total >= 0 then 0.0 when total >= 0 and v > 0 then i - 1 + abs(total - v) / v end) as turn from cum group by 1),
r as (select project, avg(case when principal + interest > 0 then (profit_equity + interest + dep) / (principal + interest) end) as a, sum(profit_equity - tax_equity) as net, max(revenue) as most from h group by 1)
select project, round(turn, 2) as payback_dynamic, round(a, 4) as dscr_avg from r join pay using (project)""")
def model_debt_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted payback and mean debt cover of every project."""
    return model.metrics(model.run(projects(spark, sf_dir))).select("project", "payback_dynamic", "dscr_avg")


@query(f"""with recursive {FULL},
z(project, k, reserve, retained) as (
  select project, -1::bigint, 0.0::double, 0.0::double from c
  union all select z.project, z.k + 1, z.reserve + case when n.net > 0 then n.legal else 0 end, z.retained + case when n.net > 0 then n.net - n.legal else n.net end
  from z join (select h.project, h.k, profit_equity - tax_equity as net, z.reserve as had, case when z.reserve + (profit_equity - tax_equity) * 0.1 > 5000 then greatest(0.0, 5000 - z.reserve) else (profit_equity - tax_equity) * 0.1 end as legal from h join z on z.project = h.project and h.k = z.k + 1) n on n.project = z.project and n.k = z.k + 1),
u as (select h.*, sum((invested + built) * 0.25) over (partition by h.project order by h.i) as equity_sum, sum((invested + built) * 0.75) over (partition by h.project order by h.i) as debt_sum from h),
j as (select u.project, u.i, case when u.k < 0 then equity_sum + debt_sum else greatest(mw * 550 - mw * 550 * 0.95::double / 29 * (u.k + 1), mw * 550 * 0.05::double) + greatest(mw * 50 - mw * 50 / 18 * (u.k + 1), 0.0) + greatest(0.0, (floor(u.k / 5.0) + 1) * 500 - 100 * (u.k + 1)) + 700 end as non_cash,
  case when u.k < 0 then debt_sum when u.k = 0 then p + 490 when u.k > 15 then 490.0 else p * power(1.043::double, u.k) - pay * (power(1.043::double, u.k) - 1) / 0.043::double + 490 end as liabilities,
  case when u.k < 0 then equity_sum else equity_sum + 210 end as paid_in, case when u.k < 0 then 0.0 else z.reserve end as reserve, case when u.k < 0 then 0.0 else z.retained end as retained
  from u left join z on z.project = u.project and z.k = u.k)
select project, cast(2024 + i as int) as year, round(non_cash, 3) as non_cash, round(liabilities, 3) as liabilities, round(paid_in, 3) as paid_in, round(reserve, 3) as reserve, round(retained, 3) as retained,
  round(liabilities + paid_in + reserve + retained, 3) as total_assets, round(liabilities + paid_in + reserve + retained - non_cash, 3) as cash from j""")
def model_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance sheets by year; cash balances them."""
    out = model.balance(model.run(projects(spark, sf_dir)))
    return out.select("project", "year", *(F.round(c, 3).alias(c) for c in ("non_cash", "liabilities", "paid_in", "reserve", "retained", "total_assets", "cash")))
