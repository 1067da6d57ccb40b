"""Query of workbook metrics: a book a customer, an item an order named by its key, cells its lines; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import bundle
from quillgrid.registry import Registry, table

registry = Registry()
query = registry.query

NAMES = ["资本金税后净现金流量", "累计税后净现金流量", "税后净现金流量", "净现金流量", "税前现金流量", "经营现金流量", "偿债备付率", "资本金内部收益率(税后)", "资本金内部收益率（税前）", "投资回收期", "折现率", "静态总投资", "总投资", "贷款偿还期", "营业收入", "经营成本", "所得税", "装机容量", "DSCR", "全部投资现金流量", "利息", "年利用小时"]


def _has(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(name, '{w}')" for w in words) + ")"


_CASH = _has(["项目投资现金流量", "全部投资现金流量", "资本金现金流量", "净现金流量"])
_BEFORE = _has(["项目投资现金流量(税前)", "税前现金流量"])
_COVER = _has(["偿债备付率", "DSCR"])


@query(f"""with recursive i as (select o_custkey as book, o_orderkey as id, '表' || o_orderkey % 9 as tab, cast(o_orderkey % 50 as int) as row, [{", ".join(f"'{n}'" for n in NAMES)}][1 + (o_orderkey * 7 + o_custkey) % {len(NAMES)}] as name, case when o_orderkey % 7 > 0 then o_totalprice / 20000 end as total from orders),
c as (select l_orderkey as id, l_linenumber + 3 as col, case when l_linenumber % 3 = 2 then -l_extendedprice else l_extendedprice end as num, case when l_linenumber > 1 then case when l_partkey % 4 > 0 then year(l_shipdate) || '年' else 'P' || l_linenumber end end as period from lineitem),
x as (select i.*, c.col, c.num, c.period, try_cast(nullif(regexp_extract(period, '[0-9]{{4}}'), '') as int) as year from i join c using (id)),
r as (
  select *, 'flows' as field, 1 as rank, id as owner from x where contains(name, '资本金') and contains(name, '税后') and contains(name, '净现金流量') and not contains(name, '累计')
  union all select *, 'flows', 2, id from x where not contains(name, '资本金') and contains(name, '税后') and contains(name, '净现金流量') and not contains(name, '累计')
  union all select *, 'flows', 3, id from x where {_CASH} union all select *, 'flows', 4, -1 from x where {_CASH}
  union all select *, 'flows', 5, id from x where contains(name, '现金流量')
  union all select *, 'before', 1, id from x where {_BEFORE} union all select *, 'before', 2, -1 from x where {_BEFORE}
  union all select *, 'cover', 1, id from x where {_COVER} union all select *, 'cover', 2, -1 from x where {_COVER}),
p as (select book, field, rank, owner, period, year, arg_max(num, {{'a': id, 'b': col, 'n': num}}) as num from r where period is not null and (field = 'cover' or year is not null) group by all),
l as (select book, field, rank, owner, list(num order by year nulls last, num, period) as line, list({{'p': period, 'n': num}}) as labels from p group by all having count(*) >= case when field = 'cover' then 1 else 2 end),
b as (select book, max(case when field = 'flows' then line end) as flows, max(case when field = 'before' then line end) as before, max(case when field = 'cover' then line end) as cover from (select *, row_number() over (partition by book, field order by rank, owner) as n from l) where n = 1 group by 1),
d as (select *, row_number() over (partition by book, kind order by not (kind = 'payback' and contains(tab, '表6')), id, num desc) as n from (select *, case when {_has(["资本金内部收益率（税后）", "资本金内部收益率(税后)"])} then 'after' when {_has(["资本金内部收益率（税前）", "资本金内部收益率(税前)"])} then 'before' when contains(name, '投资回收期') then 'payback' end as kind from x where col = 4) where kind is not null),
t as (select *, row_number() over (partition by book, kind order by id) as n from (select *, case when {_has(["基准收益率", "折现率", "贴现率"])} then 'rate' when {_has(["静态总投资", "工程静态投资"])} then 'static' when {_has(["借款偿还期", "贷款偿还期", "还款期"])} then 'loan' end as kind from i union all select *, 'dynamic' from i where {_has(["动态总投资", "工程动态投资", "总投资"])}) where kind is not null),
s as (select book, nullif(sum(num) filter (where {_has(["营业收入", "总收入", "售电收入", "电费收入"])}), 0) as revenue, nullif(sum(num) filter (where {_has(["总成本", "经营成本", "综合购电成本"])}), 0) as cost, nullif(sum(num) filter (where {_has(["所得税", "税金总额", "税费合计"])}), 0) as tax, avg(num) filter (where {_has(["净现金流量", "净现金流", "累计盈余资金"])}) as net from x group by 1),
w as (select k.book, b.flows, b.before, b.cover, s.*exclude(book), coalesce(case when rt.total > 1 then rt.total / 100 else rt.total end, 0.08) as rate, st.total as static, dy.total as dynamic, lo.total as loan, a.num as after_read, a.tab || ' D' || a.row as after_source, e.num as before_read, pb.num as payback_read, pb.tab || ' D' || pb.row as payback_source
  from (select distinct book from i) k left join b using (book) left join s using (book) left join d a on a.book = k.book and a.kind = 'after' and a.n = 1 left join d e on e.book = k.book and e.kind = 'before' and e.n = 1 left join d pb on pb.book = k.book and pb.kind = 'payback' and pb.n = 1
  left join t rt on rt.book = k.book and rt.kind = 'rate' and rt.n = 1 left join t st on st.book = k.book and st.kind = 'static' and st.n = 1 left join t dy on dy.book = k.book and dy.kind = 'dynamic' and dy.n = 1 left join t lo on lo.book = k.book and lo.kind = 'loan' and lo.n = 1),
z as (select book, 'flows' as field, flows as line from w where flows is not null union all select book, 'before', before from w where before is not null),
g(book, field, line, step, low, high) as (select book, field, line, 0, -0.5::double, 1.0::double from z
  union all select book, field, line, step + 1, case when same then mid else low end, case when same then high else mid end from (
    select *, (low + high) / 2 as mid, sign(list_sum(list_transform(line, lambda v, k: v / power(1 + (low + high) / 2, k - 1)))) = sign(list_sum(list_transform(line, lambda v, k: v / power(0.5, k - 1)))) as same from g where step < 60)),
h as (select book, field, case when sign(list_sum(list_transform(line, lambda v, k: v / power(0.5, k - 1)))) * sign(list_sum(list_transform(line, lambda v, k: v / power(2.0, k - 1)))) < 0 and list_min(line) < 0 and list_max(line) > 0 then (low + high) / 2 end as irr from g where step = 60),
u as (select book, k, v, sum(v) over (partition by book order by k) as cum from (select book, unnest(flows) as v, generate_subscripts(flows, 1) as k from w)),
y as (select book, arg_min(k - 2 + (v - cum) / v, k) as payback from (select *, -(cum - v) as below from u) where cum - v < 0 and cum >= 0 and k > 1 group by 1)
select w.book, round(coalesce(after_read, ha.irr), 7) as irr_after_tax, round(coalesce(before_read, hb.irr), 7) as irr_before_tax, round(coalesce(payback_read, y.payback), 6) as payback_period,
  round(list_sum(list_transform(flows, lambda v, k: v / power(1 + rate, k - 1))), 4) as npv_after_tax, round(case when before_read is null then list_sum(list_transform(before, lambda v, k: v / power(1 + rate, k - 1))) end, 4) as npv_before_tax,
  cast(len(cover) as int) as cover_points, round(list_avg(cover), 6) as cover_avg, list_min(cover) as cover_min, static as total_investment_static, dynamic as total_investment_dynamic, loan as loan_repayment_period,
  round(revenue, 4) as total_revenue, round(cost, 4) as total_cost, round(tax, 4) as total_tax, round(net, 6) as annual_net_cashflow,
  case when after_read is not null then after_source when ha.irr is not null then 'computed' end as irr_source, case when payback_read is not null then payback_source when y.payback is not null then 'computed' end as payback_source
from w left join h ha on ha.book = w.book and ha.field = 'flows' left join h hb on hb.book = w.book and hb.field = 'before' left join y on y.book = w.book""")
def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every customer's book."""
    key, n = F.col("o_orderkey"), F.col("l_linenumber")
    name = F.element_at(F.array(*(F.lit(x) for x in NAMES)), (1 + (key * 7 + F.col("o_custkey")) % len(NAMES)).cast("int"))
    items = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("book"), key.alias("item_id"), key.alias("place"), F.concat(F.lit("表"), (key % 9).cast("string")).alias("table"), (key % 50).cast("int").alias("row"),
        name.alias("name"), F.when(key % 7 > 0, F.col("o_totalprice") / 20000).alias("total"),
    )
    period = F.when(n > 1, F.when(F.col("l_partkey") % 4 > 0, F.concat(F.year("l_shipdate").cast("string"), F.lit("年"))).otherwise(F.concat(F.lit("P"), n.cast("string"))))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), (n + 3).alias("col"), F.when(n % 3 == 2, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("num"), period.alias("period"))
    out = bundle.bundle(items, lines.join(items.select("item_id", "book"), "item_id"))
    places = {"irr_after_tax": 7, "irr_before_tax": 7, "payback_period": 6, "npv_after_tax": 4, "npv_before_tax": 4, "cover_avg": 6, "total_revenue": 4, "total_cost": 4, "total_tax": 4, "annual_net_cashflow": 6}
    plain = ["cover_min", "total_investment_static", "total_investment_dynamic", "loan_repayment_period"]
    points = F.when(F.col("cover_series").isNotNull(), F.size("cover_series"))
    return out.select("book", *(F.round(c, p).alias(c) for c, p in places.items()), *plain, points.alias("cover_points"), F.try_element_at("sources", F.lit("irr_after_tax")).alias("irr_source"), F.try_element_at("sources", F.lit("payback_period")).alias("payback_source"))
