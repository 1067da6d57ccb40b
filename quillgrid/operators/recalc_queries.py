"""Recalculation queries: lines are formula cells over constants, orders are sums of their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.operators import recalc
from quillgrid.registry import Registry, table

registry = Registry()
query = registry.query


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, l_orderkey, ...): one row a line, of repeated ones the least; dealt by order."""
    names = ["l_extendedprice", "l_discount", "l_tax", "l_returnflag"]
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *names).repartition("l_orderkey")
    li = li.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min(F.struct(*names)).alias("m"))
    return li.select(F.concat("l_orderkey", F.lit("_"), "l_linenumber", F.lit("_"), "l_partkey").alias("k"), "l_orderkey", "m.*")


def order_cells(li: DataFrame) -> DataFrame:
    """Prices, discounts, taxes and values of lines, made from one row each, and the orders' sums."""
    cell = lambda name, num, formula=F.lit(None).cast("string"): F.struct(name.alias("id"), num.alias("num"), formula.alias("formula"))
    k, value = F.col("k"), F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    line = F.concat(F.lit("=p"), k, F.lit("*(1-d"), k, F.lit(")*(1+t"), k, F.lit(")"))
    consts = [cell(F.concat(F.lit(p), k), F.col(c)) for p, c in (("p", "l_extendedprice"), ("d", "l_discount"), ("t", "l_tax"))]
    lines = li.select(F.inline(F.array(*consts, cell(F.concat(F.lit("v"), k), value, line))))
    orders = li.groupBy("l_orderkey").agg(F.sum(value).alias("num"), F.concat(F.lit("=SUM("), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("v"), k))), ","), F.lit(")")).alias("formula"))
    return lines.unionByName(orders.select(F.concat(F.lit("o"), "l_orderkey").alias("id"), "num", "formula"))


@query("""with li as (select distinct on (l_orderkey, l_linenumber, l_partkey) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, l_returnflag),
e as (select *, l_returnflag = 'R' as hit from li where l_orderkey in (select l_orderkey from li where l_returnflag = 'R')), s(scenario, f) as (values ('up', 1.1::double), ('down', 0.9::double))
select scenario, 'o' || l_orderkey as id, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 7) as old, round(sum(l_extendedprice * case when hit then f else 1 end * (1 - l_discount) * (1 + l_tax)), 7) as new from e, s group by 1, 2""")
def recalc_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of returned lines move by a tenth in two scenarios; orders downstream are recalculated."""
    li = order_lines(spark, sf_dir)
    cells = order_cells(li)
    hit = li.where("l_returnflag = 'R'").select(F.concat(F.lit("p"), "k").alias("id"), F.col("l_extendedprice").alias("num"))
    edits = hit.select(F.explode(F.create_map(F.lit("up"), F.col("num") * 1.1, F.lit("down"), F.col("num") * 0.9)).alias("scenario", "num"), "id")
    out = recalc.recalculate(cells, edits.select("scenario", "id", "num"))
    return out.where("id like 'o%'").select("scenario", "id", F.round("old", 7).alias("old"), F.round("new", 7).alias("new"))


def _cells(df: DataFrame, name: str, num: str | None = None, formula: str | None = None, txt: str | None = None) -> DataFrame:
    """Cells of each row: SQL expressions for id, number, formula and text."""
    return df.selectExpr(f"{name} as id", f"cast({num or 'null'} as double) as num", f"cast({formula or 'null'} as string) as formula", f"cast({txt or 'null'} as string) as txt")


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


@query("""with c as (select c_custkey as k, c_acctbal as b, c_mktsegment as g from customer), e as (select *, case when b < 0 then 0 else b + 100 end as n from c where b < 5000)
select 'v_' || k as id, case when g = 'BUILDING' then 'n' when n = 0 then 'e' else 't' end as kind, case when g = 'BUILDING' then round(n / 10, 6) end as new,
       case when g = 'BUILDING' then null when n = 0 then '#DIV/0!' else floor(n)::bigint || ' ' || g end as text from e
union all select 'w_' || k, case when g <> 'BUILDING' and n = 0 then 't' else 'b' end, case when g = 'BUILDING' then (n / 10 > 100)::int::double when n <> 0 then 1.0 end, case when g <> 'BUILDING' and n = 0 then 'none' end from e""")
def recalc_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances below 5000 move; a formula of each customer is a number, a text or an error by segment, another one compares it."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "c_acctbal as b", "c_mktsegment as g")
    value = """concat('=IF(g_', k, '="building",b_', k, '*10%,INT(b_', k, '/(b_', k, '<>0))&" "&g_', k, ')')"""
    cells = _all([_cells(c, "concat('b_', k)", "b"), _cells(c, "concat('g_', k)", txt="g"), _cells(c, "concat('v_', k)", "0", value), _cells(c, "concat('w_', k)", "0", """concat('=IFERROR(v_', k, '>100,"none")')""")])
    edits = c.where("b < 5000").selectExpr("'all' as scenario", "concat('b_', k) as id", "if(b < 0, 0D, b + 100) as num")
    out = recalc.recalculate(cells, edits).where("id like 'v%' or id like 'w%'")
    return out.select("id", "kind", F.round("new", 6).alias("new"), "text")


@query("""with s as (select s_suppkey as k, s_nationkey as n, s_acctbal as b from supplier),
now as (select 'moved' as scenario, k, (n + 1) % 25 as n, b, false as renamed from s union all select 'renamed', k, n, b, true from s where n = 5 union all select 'poorer', k, n, b - 500, false from s),
name as (select x.*, case when renamed and n_name is not null then 'NEW' else n_name end as said from now x left join nation on n_nationkey = x.n),
step as (select x.*, (select max(n_nationkey) from nation where n_nationkey * 400 - 1000 <= x.b) as place from name x)
select scenario, 'name_' || k as id, said as text, null::double as new from step where scenario <> 'poorer'
union all select scenario, 'rank_' || k, case when place is null then '#N/A' end, (place + 1)::double from step where scenario = 'poorer'""")
def recalc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers look their nation up by key (exactly) and their balance in a table of brackets (approximately).

    Keys change, the table changes, and balances change, each in a scenario of its own.
    """
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey as k", "n_name as s")
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "s_nationkey as n", "s_acctbal as b")
    cells = _all([
        _cells(n, "concat('N!A', k + 1)", "k"), _cells(n, "concat('N!B', k + 1)", txt="s"), _cells(n, "concat('N!C', k + 1)", "k * 400 - 1000"), _cells(n, "concat('N!D', k + 1)", "k + 1"),
        _cells(s, "concat('nation_', k)", "n"), _cells(s, "concat('bal_', k)", "b"),
        _cells(s, "concat('name_', k)", txt="''", formula="concat('=VLOOKUP(nation_', k, ',N!$A$1:$B$25,2,FALSE)')"), _cells(s, "concat('rank_', k)", "0", "concat('=VLOOKUP(bal_', k, ',N!$C$1:$D$25,2)')"),
    ])
    moved = s.selectExpr("'moved' as scenario", "concat('nation_', k) as id", "cast((n + 1) % 25 as double) as num", "cast(null as string) as txt")
    poorer = s.selectExpr("'poorer' as scenario", "concat('bal_', k) as id", "b - 500 as num", "cast(null as string) as txt")
    renamed = n.where("k = 5").selectExpr("'renamed' as scenario", "'N!B6' as id", "cast(null as double) as num", "'NEW' as txt")
    out = recalc.recalculate(cells, moved.unionByName(poorer).unionByName(renamed))
    # every lookup of the table is reached by a change of it; those whose value is another one are shown
    out = out.where("scenario = 'moved' and id like 'name%' or scenario = 'poorer' and id like 'rank%' or text = 'NEW' and id like 'name%'")
    return out.select("scenario", "id", "text", "new")


@query("""with c as (select c_custkey + 1 as k, case when c_acctbal < 0 then 0 else round(c_acctbal * 100) end as now, round(c_acctbal * 100) as was from customer)
select 'S!B' || k as id, sum(was) over (order by k) as old, sum(now) over (order by k) as new from c""")
def recalc_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of ``SUM(A$1:A_i)`` over all balances (in hundredths); negative ones become 0."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey + 1 as k", "round(c_acctbal * 100) as v")
    # what the sheet holds now: sums inside blocks of rows, on top of the blocks before
    c = c.withColumn("block", F.floor(F.col("k") / 1024))
    above = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = c.groupBy("block").agg(F.sum("v").alias("t")).select("block", F.coalesce(F.sum("t").over(above), F.lit(0.0)).alias("start"))
    sums = c.withColumn("part", F.sum("v").over(Window.partitionBy("block").orderBy("k"))).join(blocks, "block").select("k", (F.col("start") + F.col("part")).alias("v"))
    cells = _cells(c, "concat('S!A', k)", "v").unionByName(_cells(sums, "concat('S!B', k)", "v", "concat('=SUM(A$1:A', k, ')')"))
    edits = c.where("v < 0").selectExpr("'s' as scenario", "concat('S!A', k) as id", "0D as num").unionByName(c.where("k = 1").selectExpr("'s' as scenario", "'S!A1' as id", "greatest(v, 0D) as num")).dropDuplicates(["id"])
    return recalc.recalculate(cells, edits).where("id like 'S!B%'").select("id", "old", "new")


@query("""with c as (select c_custkey + 1 as k, c_mktsegment as g, case when c_acctbal < 0 then 0 else round(c_acctbal * 100) end as v from customer),
g as (select distinct g from c), t as (select g.g, sum(c.v) as total, count(*) as n from g join c using (g) group by 1),
b as (select cast(floor((k - 1) / 50) as int) as b, sum(v) as s, min(v) as lo, max(v) as hi, count(*) as n, count(*) filter (v >= 500000) as many from c group by 1)
select 'total_' || lower(g) as id, total::double as new from t union all select 'n_' || lower(g), n::double from t
union all select 'mean_' || b, round(s / n, 6) from b union all select 'span_' || b, (hi - lo)::double from b union all select 'many_' || b, many::double from b""")
def recalc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by segment over whole columns, and means, spans and counts over ranges of 50 rows, after negative balances become 0."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey + 1 as k", "c_mktsegment as g", "round(c_acctbal * 100) as v")
    g = c.select("g").distinct()
    b = c.selectExpr("cast(floor((k - 1) / 50) as int) as b").distinct().selectExpr("b", "concat('S!A', b * 50 + 1, ':A', b * 50 + 50) as r")
    by = lambda call, more, before="": f"""concat('={before}{call}(S!B:B,"', g, '"{more})')"""
    cells = _all([
        _cells(c, "concat('S!A', k)", "v"), _cells(c, "concat('S!B', k)", txt="g"), _cells(g, "concat('total_', lower(g))", "0", by("SUMIF", ",S!A:A")), _cells(g, "concat('n_', lower(g))", "0", by("COUNTIF", "", "S!A1*0+")),
        _cells(b, "concat('mean_', b)", "0", "concat('=AVERAGE(', r, ')')"), _cells(b, "concat('span_', b)", "0", "concat('=MAX(', r, ')-MIN(', r, ')')"), _cells(b, "concat('many_', b)", "0", """concat('=COUNTIF(', r, ',">="&500000)')"""),
    ])
    edits = c.selectExpr("'s' as scenario", "concat('S!A', k) as id", "greatest(v, 0D) as num")
    out = recalc.recalculate(cells, edits).where("not startswith(id, 'S!')")
    return out.select("id", F.round("new", 6).alias("new"))


@query("""with s as (select s_suppkey as k, s_nationkey as n, s_acctbal as b from supplier)
select 'rate_' || k as id, case when b < 0 then 'e' else 'n' end as kind, case when b < 0 then '#NUM!' end as text, case when b >= 0 then round(sqrt(b), 6) end as new from s
union all select 'bad_' || k, 'e', '#NAME?', null from s
union all select 'sum_' || n, case when min(b) < 0 then 'e' else 'n' end, case when min(b) < 0 then '#NUM!' end, case when min(b) >= 0 then round(sum(sqrt(b)), 6) end from (select k, n, case when b < 0 then -1 else b end as b from s) group by n
union all select 'safe_' || n, 'n', null, case when min(b) < 0 then -1.0 else round(sum(sqrt(b)), 6) end from (select k, n, case when b < 0 then -1 else b end as b from s) group by n""")
def recalc_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of suppliers' balances: errors where they are negative, which sums by nation pass on and IFERROR ends.

    A formula that can't be read is an error of its own.
    """
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k", "s_nationkey as n", "s_acctbal as b")
    n = s.groupBy("n").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("rate_"), "k"))), ",").alias("a"))
    cells = _all([_cells(s, "concat('bal_', k)", "0"), _cells(s, "concat('rate_', k)", "0", "concat('=SQRT(bal_', k, ')')"), _cells(s, "concat('bad_', k)", "1", "concat('=NOSUCH(bal_', k, ')')"), _cells(n, "concat('sum_', n)", "0", "concat('=SUM(', a, ')')"), _cells(n, "concat('safe_', n)", "0", "concat('=IFERROR(sum_', n, ',-1)')")])
    out = recalc.recalculate(cells, s.selectExpr("'s' as scenario", "concat('bal_', k) as id", "b as num")).where("id not like 'bal%'")
    return out.select("id", "kind", "text", F.round("new", 6).alias("new"))
