"""Query of answers: customers ask what a nation's factor does to a project whose flows are made of suppliers' balances; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import answers
from quillgrid.registry import Registry, table

registry = Registry()
query = registry.query


@query("""with recursive s as (select s_suppkey as k, s_nationkey as n, s_suppkey % 5 as t, (abs(s_acctbal) + 1) * case when s_suppkey % 5 = 0 then -3 else 1 end as b from supplier),
q as (select c_custkey as question_id, n_nationkey as n, n_nationkey + 1.0::double as r, c_custkey % 6 as kind, 5 * (1 + c_custkey % 4) as amount from customer join nation on n_nationkey = c_nationkey),
w as (select question_id, n, r, case kind when 0 then r * (1 + amount / 100) when 1 then r * (1 + -amount / 100) when 2 then amount::double when 3 then r * 1.1 end as z, kind in (0, 3) as asks_irr, kind in (1, 2) as asks_npv from q where kind < 4),
e as (select distinct n, r, z from w), f as (select t, sum(b * (n + 1)) as v from s group by 1),
x as (select n, z, list(v + d order by t) as line from (select e.n, e.z, f.t, f.v, coalesce((select sum(b) from s where s.n = e.n and s.t = f.t), 0) * (e.z - e.r) as d from e, f) group by 1, 2 union all select null, null, list(v order by t) from f),
g(n, z, line, step, low, high) as (select n, z, line, 0, -0.5::double, 1.0::double from x
  union all select n, z, line, step + 1, case when same then mid else low end, case when same then high else mid end from (
    select *, (low + high) / 2 as mid, sign(list_sum(list_transform(line, lambda v, k: v / power(1 + (low + high) / 2, k - 1)))) = sign(list_sum(list_transform(line, lambda v, k: v / power(0.5, k - 1)))) as same from g where step < 60)),
m as (select n, z, case when sign(list_sum(list_transform(line, lambda v, k: v / power(0.5, k - 1)))) * sign(list_sum(list_transform(line, lambda v, k: v / power(2.0, k - 1)))) < 0 then (low + high) / 2 end as irr, list_sum(list_transform(line, lambda v, k: v / power(1.09, k - 1))) as npv, list_min(line) / 1000 as least, list_avg(line) / 1000 as mean from g where step = 60),
l as (select n, z, unnest(['irr_after_tax', 'npv_after_tax', 'cover_min', 'cover_avg']) as metric, unnest([irr, npv, least, mean]) as value, unnest([7, 4, 7, 7]) as digits from m)
select question_id, 'what_if' as tier, w.n as item_id, round(w.z, 6) as param_after, b.metric, (asks_irr and b.metric = 'irr_after_tax') or (asks_npv and b.metric = 'npv_after_tax') as asked, round(b.value, b.digits) as before, round(a.value, b.digits) as after, round(a.value - b.value, b.digits) as delta
from w join l a on a.n = w.n and a.z = w.z join l b on b.n is null and b.metric = a.metric and (b.value is not null or a.value is not null)
union all select question_id, case when kind = 4 and b.value is not null then 'metric' else 'open' end, null, null, case when kind = 4 and b.value is not null then b.metric end, kind = 4 and b.value is not null, case when kind = 4 then round(b.value, 7) end, null, null from q left join l b on b.n is null and b.metric = 'cover_min' where kind >= 4""")
def what_if_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of all customers; six kinds of them by key."""
    c, n, s = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    kind, amount = F.col("c_custkey") % 6, (5 * (1 + F.col("c_custkey") % 4)).cast("string")
    name, said = F.col("n_name"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    text = F.when(kind == 0, said("如果", name, "增加", amount, "%，IRR变成多少")).when(kind == 1, said("假设", name, "降低", amount, "%，NPV变化多大")).when(kind == 2, said("如果", name, "为", amount, "，NPV变成多少"))
    text = text.when(kind == 3, said("如果", name, "提很多%，内部收益率变成多少")).when(kind == 4, F.lit("DSCR最低是多少")).otherwise(F.lit("项目在哪里"))
    questions = c.join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").cast("long").alias("question_id"), text.alias("question"))
    params = n.select(F.col("n_nationkey").cast("long").alias("item_id"), F.concat(F.lit("r_"), "n_nationkey").alias("id"), name.alias("name"), (F.col("n_nationkey") + 1).cast("double").alias("num"), F.col("n_nationkey").alias("place"))
    t = F.col("s_suppkey") % 5
    sup = s.select("s_suppkey", t.alias("t"), F.col("s_nationkey").alias("n"), ((F.abs("s_acctbal") + 1) * F.when(t == 0, -3).otherwise(1)).cast("double").alias("b"))
    sup = sup.withColumn("v", F.col("b") * (F.col("n") + 1))
    null = F.lit(None).cast("string").alias("formula")
    flows = sup.groupBy("t").agg(F.sum("v").alias("num"), F.concat(F.lit("=SUM(V"), "t", F.lit("!A:A)")).alias("formula"))
    cells = params.select("id", "num", null).unionByName(sup.select(F.concat(F.lit("b_"), "s_suppkey").alias("id"), F.col("b").alias("num"), null))
    own = F.concat(F.lit("V"), "t", F.lit("!A"), (F.col("s_suppkey") + 1).cast("string"))
    cells = cells.unionByName(sup.select(own.alias("id"), F.col("v").alias("num"), F.concat(F.lit("=b_"), "s_suppkey", F.lit("*r_"), "n").alias("formula")))
    cells = cells.unionByName(flows.select(F.concat(F.lit("f_"), "t").alias("id"), "num", "formula")).unionByName(flows.select(F.concat(F.lit("d_"), "t").alias("id"), (F.col("num") / 1000).alias("num"), F.concat(F.lit("=f_"), "t", F.lit("/1000")).alias("formula")))
    point = lambda item, letter, num: flows.select(F.lit(item).cast("long").alias("item_id"), F.concat(F.lit(letter), "t").alias("id"), (F.col("t") + 5).alias("col"), num.alias("num"), (F.col("t") + 2024).cast("string").alias("period"))
    points = point(1, "f_", F.col("num")).unionByName(point(2, "d_", F.col("num") / 1000))
    items = spark.createDataFrame([(1, 1, "t6", 1, "资本金税后净现金流量", None, None), (2, 2, "t6", 2, "DSCR", None, None), (3, 3, "t1", 3, "折现率", 9.0, None)], "item_id long, place long, `table` string, row int, name string, total double, total_id string")
    out = answers.answer(questions, params, cells, items, points).where("metric is null or metric <> 'payback_period'")
    digits = lambda c: F.when(F.col("metric") == "npv_after_tax", F.round(c, 4)).otherwise(F.round(c, 7)).alias(c)
    return out.select("question_id", "tier", "item_id", F.round("param_after", 6).alias("param_after"), "metric", "asked", digits("before"), digits("after"), digits("delta"))
