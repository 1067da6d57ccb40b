"""Recalculation: typed values, formulas that can't be read, lookups, overlapping ranges."""

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import formulas
from quillgrid.operators import recalc
from quillgrid.operators.graph import cut

CELLS = "id string, num double, formula string, txt string"


def solve(spark, cells, edits, **kw):
    """{(scenario, id): value}: a number, a text, True or False, None for a blank, an error's name."""
    df = spark.createDataFrame([(*c, None)[:4] if len(c) == 3 else c for c in cells], CELLS)
    got = recalc.recalculate(df, spark.createDataFrame([e if len(e) == 4 else (*e, None) for e in edits], "scenario string, id string, num double, txt string"), **kw)
    of = {"n": lambda r: r["new"], "b": lambda r: bool(r["new"]), "t": lambda r: r["text"], "z": lambda r: None, "e": lambda r: r["text"]}
    rows = got.collect()
    out = {(r["scenario"], r["id"]): of[r["kind"]](r) for r in rows}
    assert len(out) == len(rows)
    return out


def one(spark, cells, edits, **kw):
    return {i: v for (_, i), v in solve(spark, cells, [("s", *e) for e in edits], **kw).items()}


def test_what_cannot_be_read_is_reached_and_is_an_error(spark):
    cells = [("S!A1", 1.0, None), ("S!B1", 5.0, "=A1*10%"), ("S!B2", 5.0, "=NOSUCH(A1,A1:B9,2)"), ("S!B3", 5.0, "=SUM(A:A)"), ("S!B4", 5.0, "=A1+*2"), ("S!B5", 5.0, "=IFERROR(B4,-1)"), ("S!B6", 5.0, "=B1+B4")]
    got = one(spark, cells, [("S!A1", 3.0)])
    assert got == {"S!A1": 3.0, "S!B1": pytest.approx(0.3), "S!B2": "#NAME?", "S!B3": 3.0, "S!B4": "#NAME?", "S!B5": -1.0, "S!B6": "#NAME?"}


def test_comparisons_keep_errors_and_texts(spark):
    cells = [("a", 1.0, None), ("b", None, None, "Yes"), ("c", 0.0, '=IF(b="yes",a,0)'), ("d", 0.0, "=IF(1/a>1,7,9)"), ("e", 0.0, "=1/a"), ("f", 0.0, "=e>1"), ("g", 0.0, '=a&"-"&b'), ("h", 0.0, "=a=blank"), ("i", 0.0, "=-a^2"), ("j", 0.0, '="x"+a'), ("k", 0.0, "=LEN(g)*50%"), ("l", 0.0, "=AND(a=0,NOT(b=\"no\"))"), ("m", 0.0, "=ISERROR(e)")]
    got = one(spark, cells, [("a", 0.0)])
    assert got == {"a": 0.0, "c": 0.0, "d": "#DIV/0!", "e": "#DIV/0!", "f": "#DIV/0!", "g": "0-Yes", "h": True, "i": 0.0, "j": "#VALUE!", "k": 2.5, "l": True, "m": True}
    assert one(spark, cells, [("a", 3.0)])["c"] == 3.0


def test_each_scenario_has_what_it_reaches(spark):
    cells = [("a", 1.0, None), ("b", 2.0, None), ("c", 3.0, "=a+b"), ("d", 6.0, "=c*2"), ("e", 4.0, "=b*2")]
    got = solve(spark, cells, [("s", "a", 5.0), ("t", "b", 7.0), ("u", "c", 1.0), ("u", "a", 9.0)])
    assert got == {("s", "a"): 5.0, ("s", "c"): 7.0, ("s", "d"): 14.0, ("t", "b"): 7.0, ("t", "c"): 8.0, ("t", "d"): 16.0, ("t", "e"): 14.0, ("u", "c"): 1.0, ("u", "a"): 9.0, ("u", "d"): 2.0}


def test_lookups_and_conditions(spark):
    keys = ["ant", "Bee", "cat", "bee", None]
    cells = [(f"S!A{i + 1}", None, None, k) for i, k in enumerate(keys)] + [(f"S!B{i}", float(i * 10), None) for i in range(1, 6)]
    cells += [(f"T!A{i}", float(i * i), None) for i in range(1, 5)] + [(f"T!B{i}", None, None, "wxyz"[i - 1]) for i in range(1, 5)]
    cells += [("S!C1", None, None, "bee"), ("S!C2", 5.0, None)]
    formulas_ = {
        "D1": "=VLOOKUP(C1,A1:B5,2,FALSE)", "D2": "=VLOOKUP(C2,T!$A$1:$B$4,2)", "D3": "=VLOOKUP(C2,T!A1:B4,2,0)", "D4": "=SUMIF(A1:A5,C1,B1:B5)", "D5": '=SUMIF(B1:B5,">"&C2*4)',
        "D6": '=COUNTIF(A1:A5,"<>"&C1)', "D7": "=MATCH(C2,T!A1:A4)", "D8": '=AVERAGEIF(B1:B5,"<=30")', "D9": '=IFERROR(VLOOKUP(C1&"s",A1:B5,2,FALSE),"none")', "D10": "=MATCH(0,T!A1:A4,1)", "D11": "=D1+1",
    }
    cells += [(f"S!{k}", 0.0, v) for k, v in formulas_.items()]
    got = solve(spark, cells, [("s", "S!C1", None, "BEE"), ("s", "S!C2", 9.0), ("t", "S!B2", 7.0), ("t", "S!A2", None, "ant"), ("t", "T!A1", 5.0), ("u", "S!C2", 0.5), ("u", "S!C1", None, "cow")])
    pick = lambda s: {k: got[s, f"S!{k}"] for k in formulas_ if (s, f"S!{k}") in got}
    assert pick("s") == {"D1": 20.0, "D2": "y", "D3": "y", "D4": 60.0, "D5": 90.0, "D6": 2.0, "D7": 3.0, "D9": "none", "D11": 21.0}
    assert pick("t") == {"D1": 40.0, "D2": "w", "D3": "w", "D4": 40.0, "D5": 120.0, "D6": 3.0, "D7": 1.0, "D8": pytest.approx((10 + 7 + 30) / 3), "D9": "none", "D10": "#N/A", "D11": 41.0}
    assert pick("u") == {"D1": "#N/A", "D2": "#N/A", "D3": "#N/A", "D4": 0.0, "D5": 150.0, "D6": 4.0, "D7": "#N/A", "D9": "none", "D11": "#N/A"}


def test_overlapping_ranges_have_few_edges(spark):
    n = 1000
    cells = spark.range(1, n + 1).select(F.concat(F.lit("S!A"), "id").alias("id"), F.col("id").cast("double").alias("num"), F.lit(None).cast("string").alias("formula"))
    sums = spark.range(1, n + 1).select(F.concat(F.lit("S!B"), "id").alias("id"), (F.col("id") * (F.col("id") + 1) / 2).alias("num"), F.concat(F.lit("=SUM(A$1:A"), "id", F.lit(")")).alias("formula"))
    cells = cut(cells.unionByName(sums))
    refs = recalc.references_of(cells)
    edges = recalc.range_edges(recalc.boxes_of(refs.select(F.col("precedent").alias("name"))), recalc.placed(cells.select("id"))).count()
    assert edges < 30 * n
    got = recalc.recalculate(cells, spark.createDataFrame([("s", "S!A500", 500.0 + 7), ("s", "S!A999", 0.0)], "scenario string, id string, num double")).collect()
    new = {r["id"]: r["new"] for r in got}
    assert len(new) == 2 + n - 499
    for i in (500, 700, 998):
        assert new[f"S!B{i}"] == i * (i + 1) / 2 + 7
    assert new["S!B1000"] == 1000 * 1001 / 2 + 7 - 999


def test_edges_of_overlapping_ranges_grow_with_the_rows(spark):
    """Also where they start below the first row, end together or slide; short ranges stay as they are."""
    size = lambda n, a, b: recalc.range_edges(recalc.boxes_of(spark.range(1, n + 1).select(F.expr(f"concat('\x01rS!A', {a}, ':A', {b})").alias("name"))), recalc.placed(spark.range(1, 2 * n).select(F.concat(F.lit("S!A"), "id").alias("id")))).count() / n
    for a, b in (("1", "id + 1"), ("2", "id + 1"), ("id", "4000"), ("id", "id + 999")):
        assert size(4000, a, b) < 28, (a, b)
    assert size(8000, "1", "id") < 1.05 * size(2000, "1", "id")


def test_long_ranges_of_several_columns(spark):
    n = 600
    cells = spark.range(1, n + 1).select(F.explode(F.array(F.struct(F.concat(F.lit("S!A"), "id").alias("id"), F.col("id").cast("double").alias("num")), F.struct(F.concat(F.lit("S!B"), "id").alias("id"), (-F.col("id")).cast("double").alias("num")))).alias("c")).select("c.*", F.lit(None).cast("string").alias("formula"))
    calls = [("S!D1", "=SUM(A3:B590)"), ("S!D2", "=MAX(A2:B500)"), ("S!D3", "=MIN(A17:B272)"), ("S!D4", "=COUNT(A5:B590)"), ("S!D5", "=SUM(A16:A271)+SUM(A17:A272)"), ("S!D6", "=SUM(A700:A1400)+A2")]
    cells = cells.unionByName(spark.createDataFrame([(i, 0.0, f) for i, f in calls], "id string, num double, formula string"))
    got = recalc.recalculate(cells, spark.createDataFrame([("s", "S!A300", 5000.0), ("s", "S!B100", 7.0), ("s", "S!A590", 0.0), ("s", "S!A20", 21.0), ("s", "S!A2", 3.0)], "scenario string, id string, num double"))
    new = {r["id"]: r["new"] for r in got.collect()}
    moved = sum(range(17, 273)) + 1
    assert {i: new[i] for i, _ in calls} == {"S!D1": 4700.0 + 107 - 590 + 1, "S!D2": 5000.0, "S!D3": -272.0, "S!D4": 1172.0, "S!D5": moved + moved + 16 - 272, "S!D6": 3.0}


def test_ranges_hold_errors_texts_and_new_cells(spark):
    cells = [("S!A1", 1.0, None), ("S!A2", 2.0, "=1/A1"), ("S!A3", None, None, "x"), ("S!B1", 0.0, "=SUM(A1:A40)"), ("S!B2", 0.0, "=COUNT(A1:A40)"), ("S!B3", 0.0, "=MAX(A1:C1,A4:A40)"), ("S!B4", 0.0, "=AVERAGE(A3:A9)"), ("S!B5", 0.0, "=SUM(A1:A60)-SUM(A20:A21)")]
    assert one(spark, cells, [("S!A1", 0.0)]) == {"S!A1": 0.0, "S!A2": "#DIV/0!", "S!B1": "#DIV/0!", "S!B2": 1.0, "S!B3": "#DIV/0!", "S!B5": "#DIV/0!"}
    assert one(spark, cells, [("S!A20", 8.0)]) == {"S!A20": 8.0, "S!B1": 11.0, "S!B2": 3.0, "S!B3": 11.0, "S!B5": 3.0}
    assert one(spark, cells, [("S!A4", None, "y"), ("S!A5", 6.0)])["S!B4"] == 6.0


def test_cycles_settle_or_are_errors(spark):
    cells = [("a", 1.0, None), ("x", 0.0, "=y*0.5+a"), ("y", 0.0, "=x*0.5"), ("z", 0.0, "=x+1"), ("p", 1.0, "=q+a"), ("q", 1.0, "=p+1")]
    got = one(spark, cells, [("a", 3.0)], max_rounds=20, tolerance=1e-4)
    assert got["x"] == pytest.approx(4.0, abs=1e-3) and got["z"] == pytest.approx(5.0, abs=1e-3)
    assert got["p"] == got["q"] == "#NUM!"


@pytest.mark.parametrize(("formula", "want"), [
    ("=2^3^2", 64.0), ("=-2^2", 4.0), ("=10%*5", 0.5), ("=1+2&3", "33"), ('="a""b"', 'a"b'), ("=IF(TRUE,,1)", None), ("=1<2=TRUE", True), ("=ROUND(-2.5,0)", -3.0), ("=ROUNDUP(1.21,1)", 1.3), ("=MOD(-3,2)", 1.0), ("=DATEDIF(45258,47483,\"d\")", 2225.0), ("=EDATE(DATE(2024,1,31),1)", 45351.0), ("=YEAR(\"2024-03-01\")", 2024.0), ("=MID(\"abcdef\",2,3)", "bcd"), ("=#N/A", "#N/A"), ("=SQRT(-1)", "#NUM!"), ("=EOMONTH(45351,0)", 45351.0), ("=MAX(-1,-2)", -1.0), ("=1E3+.5", 1000.5), ("=\"b\">\"A\"", True), ("=+-+3", -3.0),
])
def test_values(formula, want):
    kind, n, s = formulas.value(formulas.postfix(formula)[0], {})
    assert {"n": n, "b": bool(n), "t": s, "z": None, "e": s}[kind] == want


@pytest.mark.parametrize("formula", ["=", "=1+", "=(1", "=1)", "=1 2", "=SUM(1", "=A1:B2", "=()", "=%", "=*1", "=\"a", "=FOO(1)", "=VLOOKUP(1,A1:B2,C1)", "=MATCH(1,A1:A2,-1)", "=1,2"])
def test_not_readable(formula):
    with pytest.raises((ValueError, IndexError)):
        formulas.postfix(formula, "S")


def test_formulas_of_one_pattern_are_parsed_once():
    patterns = formulas.Patterns()
    for i in range(100):
        for text in (f"=p{i}_1*(1-A{i + 1})*(1e3+é{i}%)", f"=SUM(v{i},v{i + 1},-2)", f'=IF(b{i}>TRUE,NOT(c{i}),1)', f"=3e{i}x"):
            got = patterns(text, "S")
            try:
                want, _ = formulas.postfix(text, "S")
            except ValueError:
                assert got is None
                continue
            pattern, refs = got
            names = pattern.names[:]
            for at, name in zip(pattern.at, refs, strict=True):
                names[at] = name
            assert list(zip(pattern.kinds, names, pattern.values, pattern.sizes, strict=True)) == want
    assert len([p for p in patterns.known.values() if p]) == 3
    assert all(patterns(text, "S") is None for text in ("=SUM(A1:A9)", "=$A$1", "='My sheet'!A1", '="a"&b', "=SUMIF(a,b)", "=NOSUCH(a)", "=1+"))
