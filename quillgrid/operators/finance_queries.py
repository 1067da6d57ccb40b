"""Finance queries over the driver's tables. Periods are years of shipment; a customer's or segment's flows are its orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.functions import finance
from quillgrid.operators import model
from quillgrid.registry import Registry, table

registry = Registry()
query = registry.query


def yearly_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, year, flow): an outlay in the first year, revenue less costs after it."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.year("l_shipdate").alias("year"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    by_order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    seg = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    sums = li.join(by_order, "l_orderkey").groupBy("o_custkey", "year").agg(F.sum("net").alias("net"))
    sums = sums.join(seg, "o_custkey").groupBy("segment", "year").agg(F.sum("net").alias("net"))
    first = Window.partitionBy("segment")
    return sums.withColumn("flow", F.when(F.col("year") == F.min("year").over(first), -2.5 * F.col("net")).otherwise(F.col("net"))).select("segment", "year", "flow")


FLOWS = """
li as (select l_orderkey, year(l_shipdate) as year, l_extendedprice * (1 - l_discount) as net from lineitem),
s as (select c_mktsegment as segment, year, sum(net) as net from li join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey group by 1, 2),
flows as (select segment, year, case when year = min(year) over (partition by segment) then -2.5 * net else net end as flow from s)"""


@query(f"""with recursive {FLOWS.strip()},
f as (select segment, flow, row_number() over (partition by segment order by year) - 1 as t from flows),
g(segment, step, low, high) as (
  select distinct segment, 0, cast(-0.5 as double), cast(1.0 as double) from f
  union all
  select g.segment, g.step + 1,
         case when sign((select sum(flow / power(1 + (g.low + g.high) / 2, t)) from f where f.segment = g.segment)) = sign((select sum(flow / power(1 + g.low, t)) from f where f.segment = g.segment)) then (g.low + g.high) / 2 else g.low end,
         case when sign((select sum(flow / power(1 + (g.low + g.high) / 2, t)) from f where f.segment = g.segment)) = sign((select sum(flow / power(1 + g.low, t)) from f where f.segment = g.segment)) then g.high else (g.low + g.high) / 2 end
  from g where step < 50),
ends as (select segment, sum(flow / power(0.5, t)) as a, sum(flow / power(2.0, t)) as b from f group by 1)
select g.segment, case when sign(a) * sign(b) < 0 then round((low + high) / 2, 8) end as irr from g join ends using (segment) where step = 50""")
def irr_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal rate of return by bisection inside one expression, a row a segment."""
    flows = yearly_flows(spark, sf_dir).groupBy("segment").agg(finance.in_order("year", "flow").alias("flows"))
    return flows.select("segment", F.round(finance.irr(F.col("flows"), steps=50), 8).alias("irr"))


@query("""with y as (select o_custkey, year(o_orderdate) as year, sum(o_totalprice) as flow from orders group by 1, 2),
t as (select *, row_number() over (partition by o_custkey order by year) - 1 as t from y)
select o_custkey, round(sum(flow / power(1.08, t)), 4) as npv, count(*) as periods from t group by 1""")
def npv_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net present value of each customer's yearly orders at 8 %, the first year undiscounted."""
    yearly = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("flow"))
    flows = yearly.groupBy("o_custkey").agg(finance.in_order("year", "flow").alias("flows"))
    return flows.select("o_custkey", F.round(finance.npv(F.col("flows"), 0.08), 4).alias("npv"), F.size("flows").cast("long").alias("periods"))


@query("""with d as (select o_custkey, o_totalprice, date_diff('day', min(o_orderdate) over (partition by o_custkey), o_orderdate) as days from (select o_custkey, o_totalprice, cast(o_orderdate as date) as o_orderdate from orders))
select o_custkey, round(sum(o_totalprice / power(1.08, days / 365.0)), 4) as xnpv from d group by 1""")
def xnpv_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated net present value, days from each customer's first order over 365."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    each = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("day", "o_totalprice"))).alias("s"))
    days = F.transform("s", lambda x: F.datediff(x["day"], F.col("s")[0]["day"]))
    return each.select("o_custkey", F.round(finance.xnpv(F.transform("s", lambda x: x["o_totalprice"]), days, 0.08), 4).alias("xnpv"))


PAYBACK = """c as (select segment, year, flow, sum(flow) over (partition by segment order by year) as cum, row_number() over (partition by segment order by year) - 1 as t from {source})
select segment, round(min(case when t = 0 and cum >= 0 then 0.0 when t > 0 and cum - flow < 0 and cum >= 0 then t - 1 + (flow - cum) / flow end), 4) as payback from c group by 1"""


@query(f"with {FLOWS.strip()}, {PAYBACK.format(source='flows')}")
def payback_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years until the running sum turns, interpolated."""
    out = finance.payback(yearly_flows(spark, sf_dir), ["segment"], "year", "flow")
    return out.select("segment", F.round("payback", 4).alias("payback"))


@query(f"with {FLOWS.strip()}, df as (select segment, year, flow / power(1.08, row_number() over (partition by segment order by year) - 1) as flow from flows), {PAYBACK.format(source='df')}")
def payback_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on flows discounted at 8 %."""
    t = F.row_number().over(Window.partitionBy("segment").orderBy("year")) - 1
    flows = yearly_flows(spark, sf_dir).withColumn("flow", F.col("flow") / F.pow(F.lit(1.08), t))
    return finance.payback(flows, ["segment"], "year", "flow").select("segment", F.round("payback", 4).alias("payback"))


def _loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One loan a supplier: its balance without sign, 4.3 % a year, 5 to 15 years; a row a year of repayment."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("p"), (5 + F.pmod("s_suppkey", F.lit(11))).alias("n"))
    return s.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))


LOANS = "l as (select s_suppkey, abs(s_acctbal) as p, 5 + s_suppkey % 11 as n, unnest(range(1, 6 + s_suppkey % 11)) as k, 0.043::double as r from supplier)"


@query(f"""with {LOANS}, m as (select *, p * r / (1 - power(1 + r, -n)) as pay from l),
b as (select *, p * power(1 + r, k) - pay * (power(1 + r, k) - 1) / r as bal, p * power(1 + r, k - 1) - pay * (power(1 + r, k - 1) - 1) / r as prev from m)
select s_suppkey, k, round(pay, 6) as payment, round(prev * r, 6) as interest, round(pay - prev * r, 6) as principal_part, round(greatest(0.0, bal), 6) as balance from b""")
def loan_equal_installment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal instalments in closed form: no recurrence, a row a year."""
    rows = _loans(spark, sf_dir)
    parts = finance.equal_instalment(F.col("p"), F.lit(0.043), F.col("k"), F.col("n"))
    return rows.select("s_suppkey", "k", *(F.round(c, 6).alias(n) for n, c in parts.items()))


@query(f"""with {LOANS} select s_suppkey, k, round(p / n + p * (1 - (k - 1) / n::double) * r, 7) as payment, round(p * (1 - (k - 1) / n::double) * r, 7) as interest, round(p / n, 7) as principal_part, round(greatest(0.0, p * (1 - k / n::double)), 7) as balance from l""")
def loan_equal_principal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal parts of principal, in closed form."""
    rows = _loans(spark, sf_dir)
    parts = finance.equal_principal(F.col("p"), F.lit(0.043), F.col("k"), F.col("n"))
    return rows.select("s_suppkey", "k", *(F.round(c, 7).alias(n) for n, c in parts.items()))


@query("""with a as (select p_partkey, p_retailprice as o, 3 + p_size % 8 as life, unnest(range(1, 11)) as age from part)
select p_partkey, age, round(case when age <= life then o * 0.95::double / life else 0 end, 7) as depreciation, round(o - least(age, life) * (o * 0.95::double / life), 7) as net_value from a""")
def depreciation_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight line over ten years, capped at the life, and what is left."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("o"), (3 + F.col("p_size") % 8).alias("life"))
    rows = part.withColumn("age", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))))
    yearly = finance.straight_line(F.col("o"), 0.05, F.col("life"), F.col("age"), cap_at_life=True)
    left = F.col("o") - F.least(F.col("age"), F.col("life").cast("long")) * finance.straight_line(F.col("o"), 0.05, F.col("life"), F.col("age"))
    return rows.select("p_partkey", "age", F.round(yearly, 7).alias("depreciation"), F.round(left, 7).alias("net_value"))


@query("""with y as (select p_partkey, p_retailprice as amount, unnest(range(0, 24)) as since from part)
select p_partkey, since, round(case when since % 8 < 5 then amount / 5 else 0 end, 4) as amortised from y""")
def prepaid_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-term prepayments: paid every 8 years, written off over the first 5 of them."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    rows = part.withColumn("since", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    return rows.select("p_partkey", "since", F.round(F.when(F.pmod("since", F.lit(8)) < 5, F.col("p_retailprice") / 5).otherwise(0.0), 4).alias("amortised"))


HURDLE = 0.987654321  # of the mean; so odd a share that no sum ends in a rounding tie
PROFITS = f"""y as (select n_name as nation, year(o_orderdate) as year, sum(o_totalprice) as v from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1, 2),
p as (select nation, year, v - {HURDLE} * avg(v) over (partition by nation) as profit from y)"""


def _profits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, year, profit): a nation's yearly orders less a share of their mean, so that losses occur."""
    yearly = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    sums = yearly.join(cust, "o_custkey").join(nation, "c_nationkey").groupBy("nation", "year").agg(F.sum("v").alias("v"))
    return sums.select("nation", "year", (F.col("v") - HURDLE * F.avg("v").over(Window.partitionBy("nation"))).alias("profit"))


@query(f"""with recursive {PROFITS},
q as (select *, row_number() over (partition by nation order by year) as k from p),
t(nation, k, year, profit, l1, l2, l3, l4, l5, used) as (
  select nation, k, year, profit, greatest(0.0, -profit), 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double from q where k = 1
  union all
  select n.nation, n.k, n.year, n.profit, greatest(0.0, -n.profit),
    greatest(0.0, t.l1 - greatest(0.0, greatest(0.0, n.profit) - t.l5 - t.l4 - t.l3 - t.l2)),
    greatest(0.0, t.l2 - greatest(0.0, greatest(0.0, n.profit) - t.l5 - t.l4 - t.l3)),
    greatest(0.0, t.l3 - greatest(0.0, greatest(0.0, n.profit) - t.l5 - t.l4)),
    greatest(0.0, t.l4 - greatest(0.0, greatest(0.0, n.profit) - t.l5)),
    least(greatest(0.0, n.profit), t.l1 + t.l2 + t.l3 + t.l4 + t.l5)
  from t join q n on n.nation = t.nation and n.k = t.k + 1)
select nation, year, round(profit, 3) as profit, round(used, 3) as used_loss, round(greatest(0.0, profit - used), 3) as taxable, round(greatest(0.0, profit - used) * 0.25, 3) as tax from t""")
def tax_loss_carryforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Income tax at 25 % after losses of the last 5 years, oldest first: one fold over a nation's years."""
    rows = _profits(spark, sf_dir).groupBy("nation").agg(F.sort_array(F.collect_list("year")).alias("years"), finance.in_order("year", "profit").alias("profits"))
    out = rows.select("nation", F.explode(F.arrays_zip(F.col("years"), finance.loss_carry_forward(F.col("profits"), 0.25, 5).alias("t"))).alias("x"))
    return out.select("nation", F.col("x.years").alias("year"), *(F.round(F.col(f"x.t.{c}"), 3).alias(c) for c in ("profit", "used_loss", "taxable", "tax")))


@query(f"""with recursive {PROFITS},
q as (select *, row_number() over (partition by nation order by year) as k from p),
t(nation, k, year, reserve) as (
  select nation, k, year, least(500000.0, greatest(0.0, profit) * 0.1) from q where k = 1
  union all select n.nation, n.k, n.year, least(500000.0, t.reserve + greatest(0.0, n.profit) * 0.1) from t join q n on n.nation = t.nation and n.k = t.k + 1)
select nation, year, round(reserve, 2) as reserve from t""")
def capped_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutory reserve: a tenth of each profit until a cap."""
    rows = _profits(spark, sf_dir).withColumn("part", F.greatest(F.lit(0.0), F.col("profit")) * 0.1)
    rows = rows.groupBy("nation").agg(F.sort_array(F.collect_list("year")).alias("years"), finance.in_order("year", "part").alias("parts"))
    out = rows.select("nation", F.explode(F.arrays_zip(F.col("years"), finance.capped_running_sum(F.col("parts"), 500000.0).alias("r"))).alias("x"))
    return out.select("nation", F.col("x.years").alias("year"), F.round("x.r", 2).alias("reserve"))


@query("""with y as (select s_suppkey, year(l_shipdate) as year, sum(l_extendedprice) as gross from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2),
v as (select s_suppkey, year, gross / 1.13 * 0.13 as output_vat, coalesce(sum(gross / 1.13 * 0.13) over (partition by s_suppkey order by year rows between unbounded preceding and 1 preceding), 0) as before from y)
select s_suppkey, year, round(output_vat, 4) as output_vat, round(least(output_vat, greatest(0.0, 200000 - before)), 4) as deducted, round(output_vat - least(output_vat, greatest(0.0, 200000 - before)), 4) as payable from v""")
def vat_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input VAT on investment is deducted from output VAT until its balance is used up."""
    yearly = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), F.year("l_shipdate").alias("year")).agg(F.sum("l_extendedprice").alias("gross"))
    yearly = yearly.join(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", "left_semi").withColumn("output_vat", F.col("gross") / 1.13 * 0.13)
    before = F.coalesce(F.sum("output_vat").over(Window.partitionBy("s_suppkey").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    deducted = F.least(F.col("output_vat"), F.greatest(F.lit(0.0), 200000 - before))
    rows = yearly.withColumn("d", deducted)
    return rows.select("s_suppkey", "year", F.round("output_vat", 4).alias("output_vat"), F.round("d", 4).alias("deducted"), F.round(F.col("output_vat") - F.col("d"), 4).alias("payable"))


@query("""with y as (select o_orderpriority as item, year(o_orderdate) as year, sum(o_totalprice) as x from orders group by 1, 2)
select item, year, round(x / sum(x) over (partition by item), 8) as progress, round(x - 1000000 * x / sum(x) over (partition by item), 2) as net from y""")
def subsidy_prorata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investment net of a subsidy that is spread by each year's share of the total."""
    yearly = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("item"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("x"))
    share = F.col("x") / F.sum("x").over(Window.partitionBy("item"))
    return yearly.select("item", "year", F.round(share, 8).alias("progress"), F.round(F.col("x") - 1000000 * share, 2).alias("net"))


STATEMENTS = """st as (select o_custkey, year(o_orderdate) as year, sum(o_totalprice) as assets, sum(case when o_orderstatus = 'O' then o_totalprice else 0 end) as liabilities,
  sum(case when o_orderstatus = 'F' then 0.1::double * o_totalprice else 0 end) as profit from orders group by 1, 2)"""


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's yearly statement: all orders are assets, open ones are owed, finished ones earn a tenth."""
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    owed = F.sum(F.when(status == "O", price).otherwise(0.0))
    earned = F.sum(F.when(status == "F", 0.1 * price).otherwise(0.0))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year"))
    return rows.agg(F.sum(price).alias("assets"), owed.alias("liabilities"), earned.alias("profit"))


@query(f"with {STATEMENTS} select o_custkey, year, round(liabilities / assets, 8) as debt_ratio from st where assets > 0")
def debt_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liabilities over assets by year."""
    return _statements(spark, sf_dir).where("assets > 0").select("o_custkey", "year", F.round(finance.debt_ratio(F.col("liabilities"), F.col("assets")), 8).alias("debt_ratio"))


@query(f"with {STATEMENTS} select o_custkey, round(sum(profit) / avg(assets - liabilities) / count(case when profit <> 0 then 1 end), 8) as roe from st group by 1 having avg(assets - liabilities) > 0 and count(case when profit <> 0 then 1 end) > 0")
def return_on_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean yearly return on mean equity."""
    rows = _statements(spark, sf_dir)
    out = rows.groupBy("o_custkey").agg(F.round(finance.return_on_equity(F.col("profit"), F.col("assets") - F.col("liabilities")), 8).alias("roe"))
    return out.where("roe is not null")


@query("""with recursive o as (select n_nationkey as project, year(o_orderdate) as year, month(o_orderdate) as m, floor(o_totalprice) as v from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey),
y as (select project, year, sum(v) as spent from o group by 1, 2),
i as (select project, year, case when m <= 6 then 6 else 12 end as m, 0.4::double * sum(v) as amount from o group by all),
e as (select *, row_number() over (partition by project order by year, m) as number, last_day(make_date(year, m, 1)) as fin from i),
f as (select e.*, coalesce(lag(fin) over (partition by project order by number) + 1, make_date(min(year) over (partition by project), 1, 15)) as beg from e),
g as (select *, cast(round_even((fin - beg) / 30.0, 0) as int) as months from f),
h as (select g.*, y.spent * months / sum(months) over (partition by g.project, g.year) as invested from g join y on y.project = g.project and y.year = g.year),
d as (select *, greatest(0, invested - amount) as debt, (fin - beg) / 365.0 as share from h),
r as (select project, number, 0.0::double as owed, debt * 0.043 * share * 0.5 as interest, debt + debt * 0.043 * share * 0.5 as still, year from d where number = 1
  union all select d.project, d.number, case when d.year <> r.year then r.owed + r.still else r.owed end, (case when d.year <> r.year then r.owed + r.still else r.owed end) * 0.043 * share + debt * 0.043 * share * 0.5,
    (case when d.year <> r.year then 0 else r.still end) + debt + (case when d.year <> r.year then r.owed + r.still else r.owed end) * 0.043 * share + debt * 0.043 * share * 0.5, d.year from r join d on d.project = r.project and d.number = r.number + 1)
select d.project, d.number::int as number, beg as period_start, fin as period_end, months, round(invested, 4) as invested, amount as equity, round(debt, 4) as debt, round(interest, 4) as interest from d join r on r.project = d.project and r.number = d.number""")
def financing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as projects: orders of a year are its investment, equity comes in twice a year for 40 % of them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("project"))
    o = table(spark, sf_dir, "orders").join(c, "o_custkey").select("project", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("m"), F.floor("o_totalprice").cast("double").alias("v"))
    yearly = o.groupBy("project", "year").agg(F.sum("v").alias("amount"))
    half = o.groupBy("project", "year", F.when(F.col("m") <= 6, "06").otherwise("12").alias("m")).agg((0.4 * F.sum("v")).alias("amount"))
    number = F.row_number().over(Window.partitionBy("project").orderBy("year", "m"))
    injections = half.select("project", number.alias("number"), F.concat("year", F.lit("-"), "m").alias("label"), "amount")
    starts = yearly.groupBy("project").agg(F.make_date(F.min("year"), F.lit(1), F.lit(15)).alias("start"))
    out = model.financing_periods(injections, starts, yearly, 0.043)
    return out.select("project", "number", "period_start", "period_end", "months", F.round("invested", 4).alias("invested"), "equity", F.round("debt", 4).alias("debt"), F.round("interest", 4).alias("interest"))
