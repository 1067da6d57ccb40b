"""Structure, retrieval and quality queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.functions import cells
from quillgrid.operators import retrieval, structure
from quillgrid.registry import Registry, table

registry = Registry()
query = registry.query


@query("""with y as (select l_suppkey, year(l_shipdate) as year, count(*) as n from lineitem where l_shipdate < '1993-01-01' or l_shipdate >= '1995-01-01' group by 1, 2),
e as (select l_suppkey, min(year) as a, max(year) as b from y group by 1), s as (select l_suppkey, unnest(range(a, b + 1)) as year from e)
select l_suppkey, cast(year as int) as year, coalesce(n, 0) as n from s left join y using (l_suppkey, year)""")
def year_spine_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years without rows get 0."""
    li = table(spark, sf_dir, "lineitem").where("l_shipdate < '1993-01-01' or l_shipdate >= '1995-01-01'")
    rows = li.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))
    return structure.fill_years(rows, ["l_suppkey"], "year", ["n"])


@query("""with d as (select distinct o_custkey, cast(o_orderdate as date) as start from orders), i as (select o_custkey, start, lead(start) over (partition by o_custkey order by start) as finish from d)
select o_custkey, start, finish, date_diff('day', start, finish) as days, cast(round_even(date_diff('day', start, finish) / 30.0, 0) as bigint) as months from i where finish is not null""")
def timeline_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals between consecutive dates; months are days over 30, half to even."""
    d = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("start")).distinct()
    rows = d.withColumn("finish", F.lead("start").over(Window.partitionBy("o_custkey").orderBy("start"))).where("finish is not null")
    days = F.datediff("finish", "start").cast("long")
    return rows.select("o_custkey", "start", "finish", days.alias("days"), F.bround(days / 30, 0).cast("long").alias("months"))


@query("""with a as (select o_orderkey, cast(o_orderdate as date) as a, max(cast(l_shipdate as date)) as b from orders join lineitem on l_orderkey = o_orderkey group by 1, 2),
m as (select *, case when a <= b then (year(b) - year(a)) * 12 + month(b) - month(a) - (day(b) < day(a))::int end as m from a)
select o_orderkey, case when a <= b then date_diff('day', a, b) end as d, m, m // 12 as y, m % 12 as ym from m""")
def datedif_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DATEDIF between order and last shipment, in several units."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.to_date("l_shipdate")).alias("b"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a")).join(li, "o_orderkey")
    unit = lambda u: cells.datedif(F.col("a"), F.col("b"), u).cast("long").alias(u.lower())
    return rows.select("o_orderkey", unit("D"), unit("M"), unit("Y"), unit("YM"))


@query("""with n as (select (s_suppkey + 1)::int as number from supplier), a as (select *, (number - 1) // 26 as q1 from n), b as (select *, case when q1 > 0 then (q1 - 1) // 26 else 0 end as q2 from a), c as (select *, case when q2 > 0 then (q2 - 1) // 26 else 0 end as q3 from b)
select number, case when q3 > 0 then chr(cast(65 + (q3 - 1) % 26 as int)) else '' end || case when q2 > 0 then chr(cast(65 + (q2 - 1) % 26 as int)) else '' end || case when q1 > 0 then chr(cast(65 + (q1 - 1) % 26 as int)) else '' end || chr(cast(65 + (number - 1) % 26 as int)) as letters, number as back from c""")
def column_letter_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column numbers to letters and back."""
    n = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).cast("int").alias("number"))
    return n.withColumn("letters", cells.column_letters(F.col("number"))).withColumn("back", cells.column_number(F.col("letters")))


GRID = """g as (select o_orderpriority as sheet, o_custkey as row, 1 as col, null::double as num, o_orderstatus as txt from orders where o_orderkey % 3 = 0 union all select o_orderpriority, o_custkey, 2, o_totalprice, null from orders where o_custkey % 5 <> 0)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a sheet a priority: a row a customer, a text and a number column."""
    o = table(spark, sf_dir, "orders")
    null = lambda kind: F.lit(None).cast(kind)
    a = o.where("o_orderkey % 3 = 0").select(F.col("o_orderpriority").alias("sheet"), F.col("o_custkey").alias("row"), F.lit(1).alias("col"), null("double").alias("num"), F.col("o_orderstatus").alias("txt"))
    b = o.where("o_custkey % 5 <> 0").select(F.col("o_orderpriority").alias("sheet"), F.col("o_custkey").alias("row"), F.lit(2).alias("col"), F.col("o_totalprice").alias("num"), null("string").alias("txt"))
    return a.unionByName(b).withColumn("formula", null("string"))


@query(f"""with {GRID}, r as (select sheet, row, bool_and(txt is not null and num is null) as t, row_number() over (partition by sheet order by row) as place from g group by 1, 2)
select sheet, min(row) as row from r where t and place <= 50 group by 1""")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First all-text row among a sheet's first 50."""
    return structure.header_rows(_grid(spark, sf_dir), 50)


@query("""with s as (select 'orders' as sheet, o_orderkey as row, unnest(['序号', '项目名称', 'value', '类别']) as header, unnest([o_orderkey::double, null, o_totalprice, case when o_orderkey % 2 = 0 then 1.0 end]) as num, unnest([null, o_orderpriority, null, o_orderstatus]) as txt from orders),
p as (select *, row_number() over (partition by header order by row) as place from s),
t as (select header, avg((txt is not null and num is null)::int) as texts, avg((num is not null and num > 0 and num < 1000 and num = floor(num))::int) as seqs, avg((num is not null)::int) as numbers from p where place <= 10 group by 1)
select 'orders' as sheet, header as col, case when header = '序号' then 'sequence' when header = '项目名称' then 'name' when header = '类别' then 'category' when texts > 0.6 then 'name' when seqs > 0.5 then 'sequence' when numbers > 0.5 then 'total' else 'notes' end as role from t""")
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles by header word, else by ten rows of data."""
    o = table(spark, sf_dir, "orders")
    cell = lambda name, num, txt: F.struct(F.lit(name).alias("col"), num.cast("double").alias("num"), txt.cast("string").alias("txt"))
    null = F.lit(None)
    each = F.array(cell("序号", F.col("o_orderkey"), null), cell("项目名称", null, F.col("o_orderpriority")), cell("value", F.col("o_totalprice"), null), cell("类别", F.when(F.col("o_orderkey") % 2 == 0, 1.0), F.col("o_orderstatus")))
    rows = o.select(F.lit("orders").alias("sheet"), F.col("o_orderkey").alias("row"), F.explode(each).alias("c")).select("sheet", "row", "c.*").withColumn("header", F.col("col"))
    return structure.column_roles(rows)


@query(f"""with {GRID}, d as (select distinct sheet, row from g), m as (select *, coalesce(sum(coalesce((row - lag > 5)::int, 0)) over (partition by sheet order by row), 0) as island from (select *, lag(row) over (partition by sheet order by row) as lag from d))
select sheet, cast(island as bigint) as island, min(row) as first, max(row) as last, count(*) as n from m group by 1, 2""")
def column_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of used rows with gaps of five at most."""
    return structure.islands(_grid(spark, sf_dir).select("sheet", "row").distinct(), ["sheet"], "row", 5)


@query("""select o_custkey, o_orderkey, last_value(case when o_orderkey % 7 = 0 then o_orderpriority end ignore nulls) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and current row) as category from orders""")
def category_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories carried down to the rows under them."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).alias("category"))
    return structure.carry(o, ["o_custkey"], "o_orderkey", "category")


@query("""select l_suppkey, cast(year(l_shipdate) as varchar) as period, round(sum(l_extendedprice), 2) as value from lineitem group by 1, 2""")
def series_map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item's series as a map of periods, and back to rows."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").cast("string").alias("period")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    items = sums.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("period", "value"))).alias("series"))
    return items.select("l_suppkey", F.explode("series").alias("period", "value"))


@query("""with m as (select o_custkey, o_orderkey as row, o_orderdate as mark from orders where o_orderkey % 5 = 0)
select o.o_custkey, o.o_orderkey as row, max(case when o.o_orderkey - m.row <= 5000 then m.row end) as mark_at from orders o left join m on m.o_custkey = o.o_custkey and m.row < o.o_orderkey group by 1, 2""")
def asof_date_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest marked row above, at most 5000 rows away: one sort instead of a range join."""
    o = table(spark, sf_dir, "orders")
    marks = o.where("o_orderkey % 5 = 0").select("o_custkey", F.col("o_orderkey").alias("row"), F.col("o_orderdate").alias("mark"))
    return structure.nearest_above(o.select("o_custkey", F.col("o_orderkey").alias("row")), marks, ["o_custkey"], "row", 5000).select("o_custkey", "row", "mark_at")


@query("""select s_suppkey as range_id, count(l_orderkey) as n, round(sum(l_extendedprice), 2) as total from supplier join lineitem on l_orderkey between s_suppkey * 10 and s_suppkey * 10 + 3000 and l_linenumber between 1 and 3 group by 1""")
def range_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUM over a range a supplier: rows by order, columns by line; joined by blocks, with no cap on a range's length."""
    c = table(spark, sf_dir, "lineitem").select(F.lit("s").alias("sheet"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), "l_extendedprice")
    s = F.col("s_suppkey")
    ranges = table(spark, sf_dir, "supplier").select(F.lit("s").alias("sheet"), s.alias("range_id"), (s * 10).alias("r1"), (s * 10 + 3000).alias("r2"), F.lit(1).alias("c1"), F.lit(3).alias("c2"))
    return structure.in_ranges(c, ranges).groupBy("range_id").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""select n_name, round(coalesce(sum(o_totalprice) filter (where o_orderstatus = 'F'), 0), 2) as sumif, count(*) filter (where o_totalprice > 200000) as countif from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1""")
def sumif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUMIF and COUNTIF by nation, with a text and a number criterion."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), F.lit(0.0)).alias("s"), F.count_if(F.col("o_totalprice") > 200000).alias("n"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return o.join(c, "o_custkey").join(n, "n_nationkey").groupBy("n_name").agg(F.round(F.sum("s"), 2).alias("sumif"), F.sum("n").alias("countif"))


QUESTIONS = [(1, "what is the steel price"), (2, "brand#11 economy tin"), (3, "standard 收入")]
ASKED = "t(question_id, token) as (values (1::bigint, 'what'), (1, 'is'), (1, 'the'), (1, 'steel'), (1, 'price'), (2, 'brand#11'), (2, 'economy'), (2, 'tin'), (3, 'standard'), (3, '收入'))"
SCORED = f"{ASKED}, s as (select question_id, p_partkey as item_id, sum(case when lower(p_type) = token then 10.0 when contains(lower(p_type), token) then 5 + length(token) / length(p_type)::double when contains(lower(p_brand), token) then 2.0 else 0 end) as score from part, t group by 1, 2)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("name"), F.col("p_brand").alias("category"))
    return retrieval.score(items, spark.createDataFrame(QUESTIONS, "question_id long, question string"))


@query(f"with {SCORED} select question_id, item_id, round(score, 6) as score from s where score > 0")
def retrieval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of parts for three questions."""
    return _scored(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"with {SCORED} select * from (select question_id, item_id, round(score, 6) as score, cast(row_number() over (partition by question_id order by score desc, item_id) as int) as place from s where score > 0) where place <= 8")
def retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best eight for each question."""
    return retrieval.best(_scored(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("""with k(topic, keyword) as (values ('metal', 'steel'), ('metal', 'tin'), ('metal', 'copper'), ('size', 'small'), ('size', 'large'), ('grade', 'economy'), ('grade', 'standard'), ('grade', 'promo'))
select distinct p_partkey as question_id, topic from part join k on contains(lower(p_type), keyword)""")
def topic_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by keywords."""
    k = [("metal", "steel"), ("metal", "tin"), ("metal", "copper"), ("size", "small"), ("size", "large"), ("grade", "economy"), ("grade", "standard"), ("grade", "promo")]
    q = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("question"))
    return retrieval.topics(q, spark.createDataFrame(k, "topic string, keyword string"))


@query("""with a as (select o_orderpriority as sheet, count(*)::double as total, count(*) filter (where o_orderkey in (select l_orderkey from lineitem))::double as linked, count(*) filter (where o_orderstatus = 'F')::double as formulas, count(*) filter (where o_custkey % 3 <> 0)::double as tabled, count(*) filter (where o_orderkey % 100 = 0)::double as cyclic from orders group by 1)
select sheet, round(100 * (0.30 * linked / total + 0.25 * case when formulas / total between 0.2 and 0.8 then 1 when formulas / total < 0.2 then formulas / total / 0.2 else (1 - formulas / total) / 0.2 end + 0.25 * tabled / total + 0.20 * (1 - cyclic / total)), 6) as score from a""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted quality of each sheet in one aggregation."""
    linked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("linked", F.lit(True))
    o = table(spark, sf_dir, "orders").join(linked, "o_orderkey", "left")
    n = lambda c: F.count_if(c).cast("double")
    a = o.groupBy(F.col("o_orderpriority").alias("sheet")).agg(F.count("*").cast("double").alias("t"), n(F.col("linked")).alias("l"), n(F.col("o_orderstatus") == "F").alias("f"), n(F.col("o_custkey") % 3 != 0).alias("i"), n(F.col("o_orderkey") % 100 == 0).alias("c"))
    return a.select("sheet", F.round(structure.quality_score(*(F.col(x) for x in "tlfic")), 6).alias("score"))


@query("""select o_orderpriority as sheet, count(*) as n, min(o_orderkey) as first from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey) group by 1""")
def unlinked_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without a link, by sheet: orders without lines."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    linked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(linked, "o_orderkey", "left_anti").groupBy(F.col("o_orderpriority").alias("sheet")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("""select event_type, date_trunc('day', ts) as day, count(*) as n, round(sum(value), 4) as total, count(props) as with_props from events group by 1, 2""")
def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as daily series."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count("props").alias("with_props"))


@query("""select k.item as label, k.value as value, count(*) as n from (select unnest([struct_pack(item := 'returnflag', value := l_returnflag), struct_pack(item := 'linestatus', value := l_linestatus)]) as k from lineitem) group by 1, 2""")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of labels behind bar and pie charts."""
    each = F.array(F.struct(F.lit("returnflag").alias("label"), F.col("l_returnflag").alias("value")), F.struct(F.lit("linestatus").alias("label"), F.col("l_linestatus").alias("value")))
    return table(spark, sf_dir, "lineitem").select(F.explode(each).alias("k")).groupBy("k.label", "k.value").agg(F.count("*").alias("n"))


@query()
def param_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a letter missing, asked for among the distinct names and types of parts; no SQL: see tests/test_retrieval.py."""
    p = table(spark, sf_dir, "part")
    asked = p.select(F.col("p_partkey").alias("question_id"), F.concat(F.expr("substring(p_name, 1, cast(p_partkey % length(p_name) as int))"), F.expr("substring(p_name, cast(p_partkey % length(p_name) as int) + 2)")).alias("query"))
    words = p.select("p_name", "p_partkey", "p_retailprice").unionByName(p.select(F.col("p_type").alias("p_name"), (-F.col("p_partkey") - 1).alias("p_partkey"), "p_retailprice"))
    params = words.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("item_id"), F.max("p_retailprice").alias("num")).withColumn("place", F.col("item_id"))
    out = retrieval.param_of(asked, params)
    return out.select("question_id", "item_id", F.round("score", 8).alias("score"))
