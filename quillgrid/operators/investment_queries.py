"""Queries of investment: a project a customer, its items the lines of its orders; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import investment
from quillgrid.registry import Registry, table

registry = Registry()
query = registry.query

_ITEMS = """p as (select c_custkey as project, 1993 + c_custkey % 2 as start_year, 1996 + c_custkey % 3 as end_year, 0.02::double * (c_custkey % 3) as escalation from customer),
i as (select o_custkey as project, year(l_shipdate) as year, o_custkey % 4 = 0 and l_returnflag = 'R' as own, l_extendedprice as amount from orders join lineitem on l_orderkey = o_orderkey)"""


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("c_custkey")
    projects = table(spark, sf_dir, "customer").select(key.alias("project"), (1993 + key % 2).cast("int").alias("start_year"), (1996 + key % 3).cast("int").alias("end_year"), (0.02 * (key % 3)).alias("escalation"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("project")), "l_orderkey")
    item = F.when((F.col("project") % 4 == 0) & (F.col("l_returnflag") == "R"), investment.CONTINGENCY).otherwise(F.col("l_returnflag"))
    return lines.select("project", F.year("l_shipdate").alias("year"), item.alias("item"), F.col("l_extendedprice").cast("double").alias("amount")), projects


@query(f"""with {_ITEMS}, y as (select project, year, sum(case when own then 0 else amount end) as s, sum(case when own then amount end) as c from i group by 1, 2),
v as (select y.project, y.year, s, case when bool_or(c is not null) over (partition by y.project) then coalesce(c, 0) when year > start_year then s * (power(1 + escalation, year - start_year + 1) - 1) else 0 end as k from y join p using (project))
select project, cast(year as int) as year, round(s, 4) as static_investment, round(k, 4) as price_contingency, round(s + k, 4) as construction_investment, round((s + k) / sum(s + k) over (partition by project), 8) as progress from v""")
def investment_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static investment, contingency and progress of all customers."""
    out = investment.by_year(*_items(spark, sf_dir))
    return out.select("project", "year", *(F.round(c, 4).alias(c) for c in ("static_investment", "price_contingency", "construction_investment")), F.round("progress", 8).alias("progress"))


@query(f"""with {_ITEMS}, y as (select distinct project, year from i), b as (select project, unnest(range(start_year, end_year + 1)) as year from p),
d as (select project, year, true as lacks from b anti join y using (project, year) union all select y.project, y.year, false from y join p using (project) where year not between start_year and end_year)
select project, coalesce(string_agg(year::varchar, ',' order by year) filter (where lacks), '') as missing, coalesce(string_agg(year::varchar, ',' order by year) filter (where not lacks), '') as extra from d group by 1""")
def investment_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose years of lines don't fit their construction."""
    out = investment.coverage(*_items(spark, sf_dir))
    return out.select("project", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("missing", "extra")))
