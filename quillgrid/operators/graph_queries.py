"""Graph and snapshot queries. Cells: orders ('o'), lines ('l') and parts ('p'); an order depends on its lines, a line on its part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.operators import graph, propagation, snapshot
from quillgrid.registry import Registry, table

registry = Registry()
query = registry.query


def cell_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    line = F.concat(F.lit("l"), "l_orderkey", F.lit("_"), "l_linenumber")
    a = li.select(F.concat(F.lit("o"), "l_orderkey").alias("dependent"), line.alias("precedent"))
    b = li.select(line.alias("dependent"), F.concat(F.lit("p"), "l_partkey").alias("precedent"))
    return a.unionByName(b)


EDGES = """e as (select 'o' || l_orderkey as dependent, 'l' || l_orderkey || '_' || l_linenumber as precedent from lineitem
  union all select 'l' || l_orderkey || '_' || l_linenumber, 'p' || l_partkey from lineitem)"""


@query(f"""with recursive {EDGES}, d(id, depth) as (select 'p' || p_partkey, 0 from part where p_brand = 'Brand#11' union select e.dependent, d.depth + 1 from d join e on e.precedent = d.id)
select id, cast(min(depth) as int) as depth from d group by 1""")
def graph_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that depends on a brand's parts, with its depth."""
    seeds = table(spark, sf_dir, "part").where("p_brand = 'Brand#11'").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return graph.downstream(cell_edges(spark, sf_dir), seeds)


@query(f"""with {EDGES} select id, cast(level as int) as level from (select 'p' || l_partkey as id, 0 as level from lineitem union select precedent, 1 from e where precedent like 'l%' union select dependent, 2 from e where dependent like 'o%')""")
def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topological levels, precedents first, by peeling."""
    return graph.levels(cell_edges(spark, sf_dir))[0]


REGION = """t as (select c_nationkey, s_nationkey, row_number() over (partition by c_nationkey order by round(sum(l_extendedprice), 2) desc, s_nationkey) as place from orders join customer on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey group by 1, 2),
g as (select 'c' || c_nationkey as src, 's' || s_nationkey as dst from t where place <= 4
  union select distinct 's' || s_nationkey, 'c' || ((s_nationkey * 7 + 3) % 25) from supplier)"""


def nation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each nation as a buyer to its four largest sellers, and sellers to buyers: a small cyclic graph."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"), "l_extendedprice")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    sums = o.join(c, "o_custkey").join(li, "o_orderkey").groupBy("c_nationkey", "s_suppkey").agg(F.sum("l_extendedprice").alias("v")).join(s, "s_suppkey")
    sums = sums.groupBy("c_nationkey", "s_nationkey").agg(F.round(F.sum("v"), 2).alias("v"))
    best = sums.withColumn("place", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("v"), "s_nationkey"))).where("place <= 4")
    a = best.select(F.concat(F.lit("c"), "c_nationkey").alias("src"), F.concat(F.lit("s"), "s_nationkey").alias("dst"))
    b = s.select(F.concat(F.lit("s"), "s_nationkey").alias("src"), F.concat(F.lit("c"), (F.col("s_nationkey") * 7 + 3) % 25).alias("dst"))
    return a.unionByName(b).distinct()


# a shortest path enters no node twice, so it has fewer steps than there are edges
@query(f"""with recursive {REGION}, d(id, depth) as (select 'c1', 0 union select g.dst, d.depth + 1 from d join g on g.src = d.id where d.depth < (select count(*) from g)),
m as (select id, min(depth) as depth from d group by 1),
p(id, depth, path) as (select 'c1', 0, ['c1'] union all select g.dst, p.depth + 1, list_append(p.path, g.dst) from p join g on g.src = p.id join m on m.id = g.dst and m.depth = p.depth + 1)
select cast(depth as int) as depth, array_to_string(path, '>') as path from p where id = (select id from m order by depth desc, id limit 1) order by path limit 1""")
def graph_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first shortest path from a nation to the one farthest from it."""
    links = graph.cut(nation_links(spark, sf_dir))  # every round reads them
    steps = graph.reach(links, spark.createDataFrame([("c1",)], "id string"))
    far = steps.orderBy(F.desc("depth"), "id").first()["id"]
    out = graph.shortest_path(links, "c1", far)
    return out.select("depth", F.array_join("path", ">").alias("path"))


@query(f"""with recursive {REGION}, u as (select src, dst from g union select dst, src from g), d(id, depth) as (select 'c1', 0 union select u.dst, d.depth + 1 from d join u on u.src = d.id where d.depth < 2)
select id, cast(min(depth) as int) as depth from d group by 1""")
def graph_neighbours_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbourhood of a node within two steps either way."""
    return graph.reach(nation_links(spark, sf_dir), spark.createDataFrame([("c1",)], "id string"), 2, both_ways=True)


@query(f"""with recursive {REGION}, r(a, b) as (select src, dst from g union select r.a, g.dst from r join g on g.src = r.b)
select a as id, least(a, min(x.b)) as component from (select r.a, r.b from r join r q on q.a = r.b and q.b = r.a) x group by 1""")
def graph_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components of the cyclic part."""
    return graph.strongly_connected(nation_links(spark, sf_dir).select(F.col("src").alias("dependent"), F.col("dst").alias("precedent")))


@query("""select distinct o_orderpriority as dependent_owner, p_brand as precedent_owner from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey""")
def derive_table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between line items from edges between cells."""
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("dependent"), F.concat(F.lit("p"), "l_partkey").alias("precedent"))
    owner = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("owner"))
    owner = owner.unionByName(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("owner")))
    return graph.lift_edges(edges, owner)


@query(f"""with {EDGES}, i as (select 'p' || p_partkey as id from part where p_brand = 'Brand#11' union select 'l' || l_orderkey || '_' || l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_brand = 'Brand#11'))
select id from (select precedent as id from e where dependent in (select id from i) union select dependent from e where precedent in (select id from i)) x where not exists (select 1 from i where i.id = x.id)""")
def ghost_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints outside of a brand's cells."""
    brand = table(spark, sf_dir, "part").where("p_brand = 'Brand#11'").select("p_partkey")
    li = table(spark, sf_dir, "lineitem").join(brand, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    inside = brand.select(F.concat(F.lit("p"), "p_partkey").alias("id")).unionByName(li.select(F.concat(F.lit("l"), "l_orderkey", F.lit("_"), "l_linenumber").alias("id")))
    return graph.ghosts(cell_edges(spark, sf_dir), inside)


VERSIONS = """a as (select o_orderkey as id, case when o_orderkey % 41 = 0 then null else o_totalprice end as num, case when o_orderkey % 41 = 0 then o_orderstatus end as txt, o_orderpriority as owner from orders where o_orderkey % 53 <> 0),
b as (select o_orderkey as id, case when o_orderkey % 41 = 0 then null when o_orderkey % 17 = 0 then o_totalprice * 1.1 when o_orderkey % 19 = 0 then o_totalprice * 0.9 when o_orderkey % 23 = 0 then o_totalprice + 1e-10 else o_totalprice end as num, case when o_orderkey % 82 = 0 then 'X' when o_orderkey % 41 = 0 then o_orderstatus end as txt from orders where o_orderkey % 59 <> 0),
j as (select coalesce(a.id, b.id) as id, a.num as an, b.num as bn, a.txt as atx, b.txt as btx from a full join b on a.id = b.id),
d as (select id, an as old_num, bn as new_num, atx as old_txt, btx as new_txt, coalesce(abs(bn - an), abs(an), abs(bn), 0) as magnitude,
  case when (an is null and atx is null) or (bn is null and btx is null) then 'increase' when an is null or bn is null then 'unchanged' when bn >= an then 'increase' else 'decrease' end as direction
  from j where not (case when an is not null and bn is not null then abs(an - bn) <= 1e-9 or abs(an - bn) <= 1e-9 * greatest(abs(an), abs(bn)) else an is null and bn is null and atx is not distinct from btx end))"""


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of orders: some edited, some with noise, texts, and rows on one side only."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text, price = k % 41 == 0, F.col("o_totalprice")
    old = o.where(k % 53 != 0).select(k.alias("id"), F.when(~text, price).alias("num"), F.when(text, F.col("o_orderstatus")).alias("txt"))
    edited = F.when(k % 17 == 0, price * 1.1).when(k % 19 == 0, price * 0.9).when(k % 23 == 0, price + 1e-10).otherwise(price)
    new = o.where(k % 59 != 0).select(k.alias("id"), F.when(~text, edited).alias("num"), F.when(k % 82 == 0, "X").when(text, F.col("o_orderstatus")).alias("txt"))
    return old, new


@query(f"with {VERSIONS} select id, round(old_num, 4) as old_num, round(new_num, 4) as new_num, old_txt, new_txt, round(magnitude, 3) as magnitude, direction from d")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that differ between two snapshots."""
    d = snapshot.diff(*_versions(spark, sf_dir))
    return d.select("id", F.round("old_num", 4).alias("old_num"), F.round("new_num", 4).alias("new_num"), "old_txt", "new_txt", F.round("magnitude", 3).alias("magnitude"), "direction")


@query(f"with {VERSIONS} select o_orderpriority as owner, count(*) as changed, round(sum(magnitude), 4) as total, count(*) filter (where direction = 'increase') as up, count(*) filter (where direction = 'decrease') as down from d join orders on o_orderkey = id group by 1")
def diff_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by line item."""
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("owner"))
    return snapshot.by_owner(snapshot.diff(*_versions(spark, sf_dir)), owner).withColumn("total", F.round("total", 4))


@query(f"with {VERSIONS} select count(*) as changed, round(sum(case when direction = 'increase' then magnitude else 0 end), 4) as increase, round(sum(case when direction = 'decrease' then magnitude else 0 end), 4) as decrease, arg_max(id, (magnitude, -id)) as largest from d")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about a comparison."""
    out = snapshot.summary(snapshot.diff(*_versions(spark, sf_dir)))
    return out.select("changed", F.round("increase", 4).alias("increase"), F.round("decrease", 4).alias("decrease"), "largest")


@query(f"""with {VERSIONS}, c as (select id, case when id % 7 = 0 then 'formula_changed' when new_num is null and new_txt is null and not (old_num is null and old_txt is null) then 'cache_loss' when exists (select 1 from lineitem where l_orderkey = id and l_partkey % 2 = 0) then 'propagation' else 'value_changed' end as cause from d)
select cause, count(*) as n from c group by 1""")
def diff_root_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causes of differences: formula edits, lost values, changed precedents, own values."""
    d = snapshot.diff(*_versions(spark, sf_dir))
    touched = table(spark, sf_dir, "lineitem").where("l_partkey % 2 = 0").select(F.col("l_orderkey").alias("id")).distinct().withColumn("touched", F.lit(True))
    none = lambda s: F.col(f"{s}_num").isNull() & F.col(f"{s}_txt").isNull()
    cause = snapshot.root_class(F.col("id") % 7 == 0, none("old"), none("new"), F.coalesce("touched", F.lit(False)))
    return d.join(touched, "id", "left").select(cause.alias("cause")).groupBy("cause").agg(F.count("*").alias("n"))


@query(f"with {VERSIONS} select o_orderstatus as sheet, o_orderpriority as item, count(*) as n, round(sum(magnitude), 4) as total from d join orders on o_orderkey = id group by rollup (1, 2)")
def rollup_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes rolled up: line item, sheet, all."""
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("sheet"), F.col("o_orderpriority").alias("item"))
    return snapshot.diff(*_versions(spark, sf_dir)).join(owner, "id").rollup("sheet", "item").agg(F.count("*").alias("n"), F.round(F.sum("magnitude"), 4).alias("total"))


_SPREAD = f"""{EDGES},
d(root, id, depth) as (select 'p' || p_partkey, 'p' || p_partkey, 0 from part where p_brand = 'Brand#11' union select d.root, e.dependent, d.depth + 1 from d join e on e.precedent = d.id),
m as (select root, id, min(depth) as depth from d group by 1, 2),
v as (select * from (select *, row_number() over (partition by root order by depth, id) as n, count(*) over (partition by root) > 40 as truncated from m) where n <= 40)"""


def _spread(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = graph.cut(cell_edges(spark, sf_dir))
    roots = table(spark, sf_dir, "part").where("p_brand = 'Brand#11'").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    changed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("l"), "l_orderkey", F.lit("_"), "l_linenumber").alias("id"))
    owner = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("owner"))
    return edges, propagation.propagation(edges, roots, changed, owner, max_nodes=40)


@query(f"""with recursive {_SPREAD},
r as (select distinct 'l' || l_orderkey || '_' || l_linenumber as id from lineitem where l_returnflag = 'R')
select root, v.id, case when depth = 0 then 'root' when r.id is not null then 'changed' else 'downstream' end as kind, cast(depth as int) as depth, truncated from v left join r using (id)
union all select root, 'c' || o_custkey, 'item', cast(min(depth) as int), truncated from v join orders on v.id = 'o' || o_orderkey group by 1, 2, truncated""")
def propagation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of a brand's parts reaches, the 40 nearest, and the customers behind the orders among it."""
    return _spread(spark, sf_dir)[1]


@query(f"with recursive {_SPREAD} select distinct a.root, e.dependent, e.precedent from e join v a on a.id = e.precedent join v b on b.root = a.root and b.id = e.dependent")
def propagation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges inside those views."""
    edges, nodes = _spread(spark, sf_dir)
    return propagation.links(nodes, edges)
