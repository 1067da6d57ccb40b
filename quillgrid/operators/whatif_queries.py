"""What-if queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.registry import Registry, table

registry = Registry()
query = registry.query

REVENUE = "sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))"


@query(f"""
with p as (select * from (values ('price'), ('discount'), ('tax')) p(param)),
     s as (select * from (values (-0.10), (-0.05), (0.05), (0.10)) s(perturbation)),
     base as (select {REVENUE} as base from lineitem),
     m as (select param, cast(perturbation as double) as perturbation,
                  sum(l_extendedprice * (1 + case when param = 'price' then perturbation else 0 end)
                      * (1 - l_discount * (1 + case when param = 'discount' then perturbation else 0 end))
                      * (1 + l_tax * (1 + case when param = 'tax' then perturbation else 0 end))) as metric
           from lineitem, p, s group by 1, 2),
     d as (select param, greatest(0.0, max(metric - base)) as up, least(0.0, min(metric - base)) as down
           from m, base group by 1)
select param, round(up, 2) as up, round(down, 2) as down, round(up - down, 2) as spread,
       cast(row_number() over (order by round(up - down, 2) desc, param) as int) as place
from d""")
def tornado_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tornado ranking: revenue under each perturbed parameter against the base, spread by parameter, ranked.

    The three sums that revenue is linear in are taken in one pass; scenarios multiply those, not the rows.
    """
    li = table(spark, sf_dir, "lineitem")
    e, d, t = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    sums = li.agg(F.sum(e).alias("e"), F.sum(e * d).alias("ed"), F.sum(e * t).alias("et"), F.sum(e * d * t).alias("edt"))
    scenarios = spark.sql(
        "select param, perturbation from values ('price'), ('discount'), ('tax') p(param), "
        "values (-0.10D), (-0.05D), (0.05D), (0.10D) s(perturbation)"
    )
    factor = lambda p: F.lit(1.0) + F.when(F.col("param") == p, F.col("perturbation")).otherwise(0.0)
    metric = factor("price") * (F.col("e") - F.col("ed") * factor("discount") + F.col("et") * factor("tax") - F.col("edt") * factor("discount") * factor("tax"))
    base = F.col("e") - F.col("ed") + F.col("et") - F.col("edt")
    rows = scenarios.join(F.broadcast(sums), how="cross").withColumn("delta", metric - base)
    out = rows.groupBy("param").agg(F.greatest(F.lit(0.0), F.max("delta")).alias("u"), F.least(F.lit(0.0), F.min("delta")).alias("d"))
    out = out.select("param", F.round("u", 2).alias("up"), F.round("d", 2).alias("down"), F.round(F.col("u") - F.col("d"), 2).alias("spread"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("spread"), "param")))
