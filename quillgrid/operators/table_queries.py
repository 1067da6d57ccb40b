"""Queries of table detection and line items over sheets made of order lines and orders, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.operators import retrieval, structure, tables
from quillgrid.registry import Registry, table

registry = Registry()
query = registry.query

_REGIONS = """cells as (select distinct l_suppkey as sheet, cast(date_diff('day', date '1992-01-01', cast(l_shipdate as date)) // 7 as int) as row, cast(l_linenumber as int) as col from lineitem),
k as (select *, row * 10 + col as k from cells),
e as (select a.sheet, a.k as x, b.k as y from k a join k b on b.sheet = a.sheet and b.row = a.row and b.col in (a.col - 1, a.col + 1) union all select a.sheet, a.k, b.k from k a join k b on b.sheet = a.sheet and b.col = a.col and b.row in (a.row - 1, a.row + 1)),
r(sheet, x, y) as (select sheet, k, k from k union select r.sheet, r.x, e.y from r join e on e.sheet = r.sheet and e.x = r.y),
g as (select sheet, x as k, min(y) as region from r group by 1, 2),
b as (select sheet, region, min(row) as top, max(row) as bottom, min(col) as left_, max(col) as right_, count(*) as n from g join k using (sheet, k) group by 1, 2 having max(row) > min(row))"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as cells: a sheet a supplier, a row a week, a column a line number."""
    week = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) / 7).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), week.alias("row"), F.col("l_linenumber").cast("int").alias("col"))


@query(f"with recursive {_REGIONS} select sheet, region // 10 as first_row, region % 10 as first_col, top, bottom, left_, right_, n from b")
def grid_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of connected cells."""
    found = tables.region_boxes(_cells(spark, sf_dir))
    return found.select("sheet", F.col("region.row").alias("first_row"), F.col("region.col").alias("first_col"), "top", "bottom", F.col("left").alias("left_"), F.col("right").alias("right_"), "n")


@query(f"""with recursive {_REGIONS},
q as (select a.sheet, a.region as x, c.region as y from b a join b c on c.sheet = a.sheet and a.top <= c.bottom and c.top <= a.bottom and c.left_ - a.right_ - 1 between 1 and 3),
t(sheet, x, y) as (select sheet, region, region from b union select t.sheet, t.x, w.y from t join (select * from q union all select sheet, y, x from q) w on w.sheet = t.sheet and w.x = t.y),
o as (select sheet, x as region, min(y) as tab from t group by 1, 2)
select sheet, tab // 10 as first_row, tab % 10 as first_col, count(*) as regions, min(top) as top, max(bottom) as bottom, min(left_) as left_, max(right_) as right_, cast(sum(n) as bigint) as n from o join b using (sheet, region) group by sheet, tab""")
def detect_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables: boxes merged with their neighbours."""
    found = tables.graph.cut(tables.region_boxes(_cells(spark, sf_dir)))
    both = found.join(tables.merged(found), "region").groupBy("sheet", "table").agg(
        F.count("*").alias("regions"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("left").alias("left_"), F.max("right").alias("right_"), F.sum("n").alias("n"),
    )
    return both.select("sheet", F.col("table.row").alias("first_row"), F.col("table.col").alias("first_col"), "regions", "top", "bottom", "left_", "right_", "n")


_ORDERS = "d as (select o_custkey as t, o_orderkey, o_orderpriority, o_orderstatus, 'Item ' || o_orderkey % 100 as item, o_totalprice, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as place from orders)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their place among their customer's."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table"), "o_orderkey", "o_orderpriority", "o_orderstatus", F.concat(F.lit("Item "), (F.col("o_orderkey") % 100).cast("string")).alias("item"), "o_totalprice", place.alias("place"))


def _cell(row: Column, col: int, text: Column | None = None, num: Column | None = None) -> Column:
    """A cell; null if it holds nothing."""
    text, num = F.lit(None).cast("string") if text is None else text, F.lit(None).cast("double") if num is None else num.cast("double")
    return F.when(text.isNotNull() | num.isNotNull(), F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), text.alias("text"), num.alias("num")))


def _grid(rows: DataFrame, cells: list[Column]) -> DataFrame:
    return rows.select("table", F.explode(F.array(*cells)).alias("c")).where("c is not null").select("table", "c.*")


@query(f"""with {_ORDERS}, cust as (select distinct t, 1 + t % 2 as h from d), cells as (
  select t, 1 as row, 1 as col, 'Orders of ' || t as text, null::double as num from cust where h = 2
  union all select t, h, c, case c when 1 then '序号' when 2 then '项目' else case when t % 3 = 0 then '类别' else 'kind' end end, null from cust, range(1, 4) r(c)
  union all select t, h + 1, c, null, 44927 + 365 * c from cust, range(1, 4) r(c) where t % 5 = 0
  union all select t, h + (t % 5 = 0)::int + place, c, case c when 2 then o_orderpriority when 3 then o_orderstatus end, case c when 1 then place when 4 then o_totalprice + 0.001 end from d join cust using (t), range(1, 5) r(c)),
rows as (select t, row, count(*) as n, count(text) as texts, count(case when num is not null and not (num between 36526 and 73050 and num = floor(num)) then 1 end) as nums, count(case when num between 36526 and 73050 and num = floor(num) then 1 end) as dates,
  count(case when regexp_matches(text, '序号|编号|序|项目|名称|参数|指标|科目|类别|分类|大类') then 1 end) as words, min_by(text, col) filter (where text is not null) as first from cells group by 1, 2),
p as (select *, row_number() over (partition by t order by row) as place, max(row) over (partition by t) as data_end, count(*) over (partition by t) as height from rows),
a as (select *, n <= 2 and texts >= 1 and nums = 0 and words = 0 and height >= 3 as titled from p where place = 1),
h as (select a.t, a.titled, a.first as start, a.data_end, x.row, x.words >= 3 or (x.n >= 5 and x.nums > 0) or (x.dates >= 3 and x.n >= 3) as proper,
  coalesce(y.row = x.row + 1 and ((y.words > x.words and y.words >= 2) or (y.dates >= 3 and y.dates > x.dates)), false) as better
  from a join p x on x.t = a.t and x.place = case when titled then 2 else 1 end left join p y on y.t = a.t and y.place = x.place + 1)
select t as sheet, case when titled or (proper and better) then start end as title, row + (proper and better)::int as header_row, row + (proper and better)::int + proper::int as data_start, data_end
from h where data_end - (row + (proper and better)::int + proper::int) >= 1""")
def table_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, header rows and data rows of sheets of orders, some with a title, some with a row of dates."""
    d = _orders(spark, sf_dir)
    t, h = F.col("table"), 1 + F.col("table") % 2
    dated = (t % 5 == 0).cast("int")
    kind = F.when(t % 3 == 0, F.lit("类别")).otherwise(F.lit("kind"))
    top = [_cell(F.lit(1), 1, F.when(h == 2, F.concat(F.lit("Orders of "), t.cast("string")))), *(_cell(h, i, c) for i, c in enumerate([F.lit("序号"), F.lit("项目"), kind], 1)), *(_cell(h + 1, c, num=F.when(dated == 1, F.lit(44927 + 365 * c))) for c in (1, 2, 3))]
    at = h + dated + F.col("place")
    data = [_cell(at, 1, num=F.col("place")), _cell(at, 2, F.col("o_orderpriority")), _cell(at, 3, F.col("o_orderstatus")), _cell(at, 4, num=F.col("o_totalprice") + 0.001)]
    out = tables.heads(_grid(d.select("table").distinct(), top).unionByName(_grid(d, data)))
    return out.withColumnRenamed("table", "sheet")


@query(f"""with {_ORDERS}, v as (select t, place, case when o_orderkey % 7 <> 0 then item end as own_name, case when o_orderkey % 3 = 0 then o_orderpriority end as own, case when o_orderkey % 2 = 0 then 'kWh' end as unit, case when o_orderkey % 5 <> 0 then o_totalprice end as total, o_totalprice * 0.5 as y1, case when o_orderstatus = 'F' then o_totalprice * 0.25 end as y2 from d),
n as (select *, coalesce(own_name, own, unit) as name from v), w as (select *, last_value(own ignore nulls) over (partition by t order by place rows unbounded preceding) as category from n where name is not null)
select 'IND_' || t || '_' || place || '_' || left(regexp_replace(coalesce(category, ''), '[^A-Za-z0-9_]', '_', 'g'), 15) || '_' || left(regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g'), 30) as item_id, t as sheet, place as row, name, category, unit,
  round(coalesce(total, y1), 5) as total, cast(1 + (y2 is not null)::int as int) as periods, round(y1 + coalesce(y2, 0), 5) as series_sum, cast((own_name is not null)::int + (own is not null)::int + (unit is not null)::int + (total is not null)::int + 1 + (y2 is not null)::int as int) as cells from w""")
def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item an order: name, carried category, unit, total and series."""
    d = _orders(spark, sf_dir)
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    values = [
        _cell(F.col("place"), 1, F.when(key % 7 != 0, F.col("item"))), _cell(F.col("place"), 2, F.when(key % 3 == 0, F.col("o_orderpriority"))), _cell(F.col("place"), 3, F.when(key % 2 == 0, F.lit("kWh"))),
        _cell(F.col("place"), 4, num=F.when(key % 5 != 0, price)), _cell(F.col("place"), 5, num=price * 0.5), _cell(F.col("place"), 6, num=F.when(F.col("o_orderstatus") == "F", price * 0.25)),
    ]
    cells = _grid(d, values).withColumn("sheet", F.col("table"))
    kinds = F.array(*(F.struct(F.lit(i).alias("col"), F.lit(r).alias("role"), F.lit(p).cast("string").alias("period")) for i, (r, p) in enumerate([("name", None), ("category", None), ("unit", None), ("total", None), ("period", "2024"), ("period", "2025")], 1)))
    roles = d.select("table").distinct().select("table", F.explode(kinds).alias("k")).select("table", "k.*")
    out = tables.line_items(cells, roles)
    return out.select("item_id", "sheet", "row", "name", "category", "unit", F.round("total", 5).alias("total"), F.size("series").alias("periods"), F.round(F.aggregate(F.map_values("series"), F.lit(0.0), lambda a, v: a + v), 5).alias("series_sum"), F.size("cells").alias("cells"))


_FOUND = """s as (select o_orderpriority as question_id, o_custkey as item_id, max(o_totalprice) as score from orders group by 1, 2),
best as (select * from (select *, row_number() over (partition by question_id order by score desc, item_id) as place from s) where place <= 8),
edges as (select distinct * from (select c_custkey as dependent, unnest([c_custkey // 2, c_custkey - 1, c_custkey - 3, c_custkey - 7]) as precedent from customer) where precedent > 0),
side as (select question_id, item_id, score, 'up' as side, precedent as neighbour from best join edges on dependent = item_id union all select question_id, item_id, score, 'down', dependent from best join edges on precedent = item_id),
near as (select *, row_number() over (partition by question_id, item_id, side order by neighbour) as n from side)"""


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The eight best customers of each priority, and customers that depend on others."""
    scored = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("question_id"), F.col("o_custkey").alias("item_id")).agg(F.max("o_totalprice").alias("score"))
    c = F.col("c_custkey")
    edges = table(spark, sf_dir, "customer").select(c.alias("dependent"), F.explode(F.array(F.floor(c / 2), c - 1, c - 3, c - 7)).alias("precedent")).where("precedent > 0").distinct()
    return retrieval.best(scored), edges


@query(f"with {_FOUND} select question_id, item_id, side, neighbour from near where n <= 5")
def retrieval_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five neighbours on each side of every item found."""
    return retrieval.neighbours(*_found(spark, sf_dir))


@query(f"""with {_FOUND}, more as (select question_id, neighbour as item_id, max(score) * 0.5 as score, 'dependency' as reason from near where n <= 3 group by 1, 2),
every as (select question_id, item_id, score, 'match' as reason from best union all select m.* from more m anti join best b on b.question_id = m.question_id and b.item_id = m.item_id)
select question_id, item_id, round(score, 4) as score, reason from (select *, row_number() over (partition by question_id order by score desc, item_id) as place from every) where place <= 16""")
def retrieval_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items found and their neighbours at half the score."""
    out = retrieval.expand(*_found(spark, sf_dir))
    return out.select("question_id", "item_id", F.round("score", 4).alias("score"), "reason")


@query("""select round(coalesce(avg(case when o_orderkey % 3 > 0 and o_orderkey % 10 <= 5 and o_orderkey in (select l_orderkey from lineitem) then 1.0 else 0 end), 0), 8) as confidence from orders""")
def header_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as headers; their lines as what depends on them."""
    key = F.col("o_orderkey")
    headers = table(spark, sf_dir, "orders").select(key.alias("id"), (key % 10).alias("row"), F.when(key % 3 > 0, "string").otherwise("number").alias("type"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("dependent"), F.col("l_orderkey").alias("precedent"))
    return structure.header_confidence(headers, edges).select(F.round("confidence", 8).alias("confidence"))
