"""Graph queries over planted tables."""

import duckdb

from quillgrid.operators import graph
from quillgrid.queries import ORACLE_SQL, QUERIES


def test_the_farthest_nation_may_be_any_number_of_steps_away(spark, tmp_path):
    """Nations 1 to 5 each buy from one nation only, which leads to the next one: ten steps, and no shorter way."""
    seller = {n: (n - 2) * 18 % 25 for n in range(1, 6)}  # its suppliers lead to (7 * seller + 3) % 25 = n + 1
    tables = {
        "customer": ([(n, n) for n in seller], "c_custkey long, c_nationkey int"),
        "orders": ([(n, n) for n in seller], "o_orderkey long, o_custkey long"),
        "supplier": ([(s, s) for s in seller.values()], "s_suppkey long, s_nationkey int"),
        "lineitem": ([(n, s, 10.0) for n, s in seller.items()], "l_orderkey long, l_suppkey long, l_extendedprice double"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = ">".join(f"c{n}>s{s}" for n, s in seller.items()) + ">c6"
    got = [tuple(r) for r in QUERIES["graph_shortest_path"](spark, str(tmp_path)).collect()]
    assert got == con.execute(ORACLE_SQL["graph_shortest_path"]).fetchall() == [(10, want)]


def test_a_path_is_cut_by_the_caller_only(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    assert [r["depth"] for r in graph.shortest_path(edges, 0, 5).collect()] == [5]
    assert graph.shortest_path(edges, 0, 5, max_depth=4).isEmpty()
    assert graph.shortest_path(edges, 5, 0).isEmpty()
