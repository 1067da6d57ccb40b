"""Fuzzy names against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from quillgrid.operators import retrieval
from quillgrid.queries import QUERIES


def plain(query, name):
    if query in name:
        return 0.9 + 0.1 * len(query) / len(name)
    if name in query:
        return 0.8 + 0.1 * len(name) / len(query)
    return SequenceMatcher(None, query, name).ratio()


@pytest.mark.parametrize("least", [0.4, 0.6])
def test_fuzzy_matches_equal_all_pairs(spark, least):
    rng = random.Random(int(least * 10))
    text = lambda: "".join(rng.choice("abcd 电价Z") for _ in range(rng.randint(1, 12)))
    asked = [(i, text()) for i in range(60)] + [(90, None), (91, ""), (92, "A")]
    names = [(i, text()) for i in range(60)] + [(90, None), (91, ""), (92, "xxAxx")]
    got = {(r["question_id"], r["item_id"]): r["score"] for r in retrieval.fuzzy_matches(spark.createDataFrame(asked, "question_id long, query string"), spark.createDataFrame(names, "item_id long, name string"), least).collect()}
    want = {(i, j): plain(q.lower(), n.lower()) for i, q in asked for j, n in names if q and n}
    want = {k: v for k, v in want.items() if v >= least}
    assert got == pytest.approx(want)


def test_param_match_is_the_most_alike(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["question_id"]: (r["item_id"], r["score"]) for r in QUERIES["param_match"](spark, sf).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_type").collect()]
    names = {}
    for key, name, kind in rows:
        names[name.lower()] = min(key, names.get(name.lower(), key))
        names[kind.lower()] = min(-key - 1, names.get(kind.lower(), 0))
    for key, name, _ in rows:
        at = key % len(name)
        query = (name[:at] + name[at + 1 :]).lower()
        best = max(((plain(query, n), -i) for n, i in names.items()), default=None)
        assert got.get(key) == (pytest.approx((-best[1], best[0])) if best[0] >= 0.4 else None)


def test_copies_of_texts_are_compared_once(spark):
    asked = spark.range(2000).selectExpr("id as question_id", "if(id % 2 = 0, 'Grid price', 'grid price') as query")
    params = spark.range(2000).selectExpr("id as item_id", "if(id % 2 = 0, 'the grid prices', 'other') as name", "1D as num", "-id as place")
    compared = retrieval._alike(asked.selectExpr("lower(query) as text"), params.selectExpr("lower(name) as text"), 0.4)
    assert [(r["query"], r["name"]) for r in compared.collect()] == [("grid price", "the grid prices")]
    rows = retrieval.param_of(asked, params).collect()
    assert len(rows) == 2000 and {r["item_id"] for r in rows} == {1998}
    assert {round(r["score"], 9) for r in rows} == {round(0.9 + 1 / 15, 9)}
