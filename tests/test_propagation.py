"""Views of what a change reaches: cycles, caps and kinds."""

from quillgrid.operators.propagation import links, propagation


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_views(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "b"), ("d", "b"), ("e", "d"), ("x", None), (None, "a"), ("s", "s")], "dependent string, precedent string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    owner = spark.createDataFrame([("c", "I1"), ("d", "I1"), ("e", "I2"), ("z", "I3")], "id string, owner string")
    every = propagation(edges, ids("a", "s", "lone", None), ids("a", "c"), owner)
    assert _rows(every.select("root", "id", "kind", "depth", "truncated")) == [
        ("a", "I1", "item", 2, False), ("a", "I2", "item", 3, False), ("a", "a", "root", 0, False), ("a", "b", "downstream", 1, False), ("a", "c", "changed", 2, False), ("a", "d", "downstream", 2, False), ("a", "e", "downstream", 3, False),
        ("lone", "lone", "root", 0, False), ("s", "s", "root", 0, False),
    ]
    assert _rows(links(every, edges)) == [("a", "a", "c"), ("a", "b", "a"), ("a", "c", "b"), ("a", "d", "b"), ("a", "e", "d"), ("s", "s", "s")]
    few = propagation(edges, ids("a"), ids(), owner, max_nodes=3)
    assert _rows(few.where("kind <> 'item'").select("id", "truncated")) == [("a", True), ("b", True), ("c", True)]
    exact = propagation(edges, ids("a"), ids(), owner, max_nodes=5)
    assert not any(r.truncated for r in exact.collect())
    assert _rows(propagation(edges, ids("a"), ids(), owner, max_depth=1).where("kind <> 'item'").select("id")) == [("a",), ("b",)]
    assert _rows(propagation(edges.limit(0), ids(), ids(), owner)) == []


def test_doubled_edges_are_not_sought_among_all_edges(spark):
    """What is found is made distinct, not the edges, which are many more."""
    nodes = spark.createDataFrame([("a", "a", "root"), ("a", "b", "downstream")], "root string, id string, kind string")
    out = links(nodes, spark.createDataFrame([("b", "a"), ("b", "a"), ("c", "b")], "dependent string, precedent string"))
    assert _rows(out) == [("a", "b", "a")]
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
