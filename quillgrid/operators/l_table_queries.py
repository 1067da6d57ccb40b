"""Query of L-shaped tables over sheets made of order lines, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import l_tables
from quillgrid.registry import Registry, table

registry = Registry()
query = registry.query


@query("""with recursive l as (select l_suppkey as sheet, cast(date_diff('day', date '1992-01-01', cast(l_shipdate as date)) // 4 as int) as row, cast(case l_linenumber when 7 then 13 else l_linenumber end as int) as col,
  case when l_returnflag <> 'N' then '项目 ' || l_linestatus end as text, l_quantity as num, l_orderkey, l_partkey from lineitem),
cells as (select *, max(case when col - gone > 6 then gone end) over (partition by sheet, row order by col rows unbounded preceding) as before from (select *, lag(col) over (partition by sheet, row order by col) as gone from (select sheet, row, col, min(text) as text from l group by all))),
m as (select sheet, row as r1, col as c1, row + cast(l_orderkey % 5 as int) as r2, col + cast(l_partkey % 3 as int) as c2 from l where l_partkey % 5 = 0),
r as (select sheet, row, list(col) as cols, min(col) as least, max(col) as most, count(text) = count(*) and count(*) > 1 as header, count(*) = 1 and count(text) = 1 as note from cells group by 1, 2),
a0 as (select sheet, r1, c1, max(r2) as r2, max(c2) as c2 from m group by 1, 2, 3 having max(r2) - r1 >= 2 and max(c2) - c1 <= 1),
a1 as (select a.sheet, r1, c1, r2, c2, greatest(c2, max(most)) as edge from a0 a join r on r.sheet = a.sheet and r.row between r1 and r1 + 50 group by 1, 2, 3, 4, 5),
a as (select a1.*, r1 - (r.least - c1 <= 4 and len(list_filter(r.cols, lambda x: x between c1 and edge)) > 0)::int as top from a1 join r own on own.sheet = a1.sheet and own.row = r1 left join r on r.sheet = a1.sheet and r.row = r1 - 1),
a2 as (select sheet, r1, c1, r2, c2, edge, coalesce(top, r1) as top from a),
held as (select distinct r.sheet, r.row, k.c1 from r join (select distinct sheet, c1 from a2) k on k.sheet = r.sheet join m on m.sheet = r.sheet and r.row between m.r1 and m.r2 and k.c1 between m.c1 and m.c2),
last as (select sheet, max(row) as row from r group by 1),
scan(sheet, r1, c1, edge, row, empty, bottom, ended) as (select sheet, r1, c1, edge, r2, 0, r2, false from a2
  union all select sheet, r1, c1, edge, row, case when used then 0 else empty + 1 end, case when used and not (empty > 0 and fresh) then row else bottom end, (used and empty > 0 and fresh) or (not used and empty >= 2) from (
    select s.sheet, s.r1, s.c1, s.edge, s.row + 1 as row, s.empty, s.bottom, coalesce(len(list_filter(r.cols, lambda x: x between s.c1 and s.edge)) > 0, false) as used, coalesce(r.header or r.note or (r.most <= s.c1 + 3 and h.c1 is not null), false) as fresh
    from scan s join last on last.sheet = s.sheet and s.row < last.row left join r on r.sheet = s.sheet and r.row = s.row + 1 left join held h on h.sheet = s.sheet and h.row = s.row + 1 and h.c1 = s.c1 where not s.ended)),
e as (select a2.*, s.bottom, c.before, row_number() over (partition by a2.sheet order by r1, c1) as i from a2 join (select sheet, r1, c1, max(bottom) as bottom from scan group by 1, 2, 3) s using (sheet, r1, c1) join cells c on c.sheet = a2.sheet and c.row = r1 and c.col = c1),
fold(sheet, i, t) as (select distinct sheet, 0::bigint, []::struct(r1 int, c1 int, r2 int, c2 int, edge int, top int, bottom int)[] from e
  union all select f.sheet, e.i, case when len(list_filter(f.t, lambda x: e.r1 between x.top and x.bottom and e.c1 between x.c1 and x.edge and coalesce(e.before, 0) < x.c1)) > 0 then f.t else list_append(f.t, {'r1': e.r1, 'c1': e.c1, 'r2': e.r2, 'c2': e.c2, 'edge': e.edge, 'top': e.top, 'bottom': e.bottom}) end
  from fold f join e on e.sheet = f.sheet and e.i = f.i + 1),
t as (select sheet, unnest(t, recursive := true) from (select sheet, arg_max(t, i) as t from fold group by 1)),
own as (select c.sheet, c.row, c.col, min({'r': t.r1, 'c': t.c1}) as k from cells c join t on t.sheet = c.sheet and c.row between t.top and t.bottom and c.col between t.c1 and t.edge and coalesce(c.before, 0) < t.c1 group by 1, 2, 3)
select t.sheet, t.r1, t.c1, any_value(c.text) as title, least(min(o.row), t.r1) as top, greatest(max(o.row), any_value(t.r2)) as bottom, least(min(o.col), t.c1) as left_, greatest(max(o.col), any_value(t.c2)) as right_, count(*) as n
from t join own o on o.sheet = t.sheet and o.k.r = t.r1 and o.k.c = t.c1 join cells c on c.sheet = t.sheet and c.row = t.r1 and c.col = t.c1 group by 1, 2, 3""")
def detect_l_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as cells, a sheet a supplier, a row four days, a column a line number; some are merged with cells around."""
    row = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) / 4).cast("int")
    lines = table(spark, sf_dir, "lineitem").withColumns({"row": row, "col": F.when(F.col("l_linenumber") == 7, 13).otherwise(F.col("l_linenumber")).cast("int")})
    text = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("项目 "), F.col("l_linestatus")))
    cells = lines.select(F.col("l_suppkey").alias("sheet"), "row", "col", text.alias("text"), F.col("l_quantity").cast("double").alias("num"))
    merges = lines.where("l_partkey % 5 = 0").select(F.col("l_suppkey").alias("sheet"), F.col("row").alias("r1"), F.col("col").alias("c1"), (F.col("row") + F.col("l_orderkey") % 5).alias("r2"), (F.col("col") + F.col("l_partkey") % 3).alias("c2"))
    return l_tables.detect(cells, merges).withColumnsRenamed({"left": "left_", "right": "right_"})
