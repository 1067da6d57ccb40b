"""Queries of work on a model, structure checks and the data behind charts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import checks, workspace
from quillgrid.registry import Registry, table

registry = Registry()
query = registry.query


@query("""
with o as (select o_orderpriority as scenario, cast(o_custkey as varchar) as id, max(o_totalprice) as num from orders where o_orderstatus = 'F' group by 1, 2),
p as (select o_orderpriority as scenario, cast(o_custkey as varchar) as id, max(o_totalprice) as num from orders where o_orderstatus <> 'F' or o_orderstatus is null group by 1, 2)
select coalesce(o.scenario, p.scenario) as scenario, coalesce(o.id, p.id) as id, coalesce(p.num, o.num) as num from o full join p on o.scenario = p.scenario and o.id = p.id""")
def scenario_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of each scenario with its pending edits, which win."""
    orders = table(spark, sf_dir, "orders")
    final = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    side = lambda s: orders.where(s).groupBy(F.col("o_orderpriority").alias("scenario"), F.col("o_custkey").cast("string").alias("id")).agg(F.max("o_totalprice").alias("num"))
    return workspace.merged_edits(side(final), side(~final))


_CHANGES = "c as (select user_id as id, event_id as seq, value as num from events where value is not null)"


@query("""select user_id as id, event_id as seq, case when row_number() over w = 1 then 0 else lag(value) over w end as before, value as after from events window w as (partition by user_id order by event_id)""")
def change_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of their user's value; a null is a change to a blank."""
    changes = table(spark, sf_dir, "events")
    return workspace.history(changes.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("value").alias("num"), F.lit(0.0).alias("first")))


@query(f"""with {_CHANGES}, h as (select id, seq, coalesce(lag(num) over (partition by id order by seq), 0) as before, num as after from c)
select id, coalesce(max_by(after, seq) filter (where seq % 3 <> 0), min_by(before, seq)) as num from h group by id""")
def rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third change undone."""
    records = change_history(spark, sf_dir)
    return workspace.rolled_back(records, records.where("seq % 3 = 0").select("id", "seq"))


_GRID = """g as (select l_orderkey as sheet, l_linenumber as col, l_returnflag, max(l_quantity) as num from lineitem group by all),
cells as (select sheet, col, max(num) as num, case when max(l_returnflag) = 'N' then '=B' || col || '*2' end as formula from g group by sheet, col)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a grid: a row an order, constants where the line was returned."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("col"))
    cells = lines.agg(F.max("l_quantity").alias("num"), F.max("l_returnflag").alias("flag"))
    return cells.select("sheet", F.lit(1).alias("row"), "col", "num", F.when(F.col("flag") == "N", F.concat(F.lit("=B"), "col", F.lit("*2"))).alias("formula"))


@query(f"""with {_GRID} select sheet, 1 as row, count(*) filter (where formula is null) as static, count(formula) as formulas,
min(col) filter (where formula is not null) as first, max(col) filter (where formula is not null) as last from cells group by sheet
having count(*) filter (where formula is null) > 0 and count(formula) > 0 and min(col) filter (where formula is not null) <= min(col) + 1""")
def mixed_date_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that mix formulas with constants."""
    return checks.mixed_rows(_grid(spark, sf_dir))


@query(f"""with {_GRID}, e as (select sheet, min(col) as a, max(col) as b from cells where formula is not null group by sheet)
select sheet, 1 as row, count(*) as static from cells join e using (sheet) where formula is null and col > a and col < b group by sheet having count(*) >= 2""")
def date_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with two or more constants between formulas."""
    return checks.gaps(_grid(spark, sf_dir))


@query("""with a as (select c_mktsegment as label, avg(c_acctbal) as before from customer where c_nationkey < 12 group by 1),
b as (select c_mktsegment as label, avg(c_acctbal) as after from customer where c_nationkey >= 12 group by 1)
select label, before, after, after - before as delta from a join b using (label)""")
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of each label, where both sides have it."""
    side = lambda c, name: table(spark, sf_dir, "customer").where(c).groupBy(F.col("c_mktsegment").alias("label")).agg(F.avg("c_acctbal").alias(name))
    both = side("c_nationkey < 12", "before").join(side("c_nationkey >= 12", "after"), "label")
    return both.withColumn("delta", F.col("after") - F.col("before"))


@query("""select o_orderkey, o_totalprice from orders o where o_totalprice > 1.5 * (select avg(o_totalprice) from orders i where i.o_custkey = o.o_custkey)""")
def correlated_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over registered tables: orders far above their customer's mean."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("quillgrid_orders")
    return spark.sql("select o_orderkey, o_totalprice from quillgrid_orders o where o_totalprice > 1.5 * (select avg(o_totalprice) from quillgrid_orders i where i.o_custkey = o.o_custkey)")


@query("""select event_type, true as users_near, true as median_near from events group by 1""")
def approximate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct users and median value of each type, held against the exact ones."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "value")
    got = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("a"), F.percentile_approx("value", 0.5, 10_000).alias("m"))
    users = e.select(F.col("event_type").alias("user_type"), "user_id").distinct().groupBy("user_type").agg(F.count("user_id").alias("n"))
    # the median's place by counting: no task holds or sorts a type's values
    low = F.broadcast(got.select(F.col("event_type").alias("type"), "m"))  # a row a type
    places = e.where("value is not null").select(F.col("event_type").alias("value_type"), "value").join(low, F.col("value_type").eqNullSafe(F.col("type"))).groupBy("value_type").agg(
        F.count_if(F.col("value") < F.col("m")).alias("below"), F.count_if(F.col("value") <= F.col("m")).alias("upto"), F.count("*").alias("of"),
    )
    near = (F.col("upto") >= 0.49 * F.col("of")) & (F.col("below") < 0.51 * F.col("of"))
    both = got.join(users, F.col("event_type").eqNullSafe(F.col("user_type")), "left").join(places, F.col("event_type").eqNullSafe(F.col("value_type")), "left")
    return both.select("event_type", (F.abs(F.col("a") - F.col("n")) <= 0.05 * F.col("n")).alias("users_near"), near.alias("median_near"))
