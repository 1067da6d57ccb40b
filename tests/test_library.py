import inspect
import io
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import graph, model, model_queries, recalc, retrieval, snapshot
from quillgrid.sources import stores, workbook
from quillgrid.streaming import edits as stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ran(spark):
    return model.run(model_queries.projects(spark, SF)).persist()


def test_balance_sheet_balances(ran):
    rows = model.balance(ran).toPandas()
    gap = rows["total_assets"] - rows["non_cash"] - rows["cash"]
    assert gap.abs().max() < 1e-6
    first = rows[rows["year"] == 2024]
    assert (first["cash"].abs() < 1e-6).all()  # nothing but construction in progress
    assert (rows["reserve"] <= 5000 + 1e-6).all()


def test_loan_is_paid_back(ran):
    for r in ran.select("loan", "principal", "owed").collect():
        assert sum(r["principal"]) == pytest.approx(r["loan"])
        assert r["owed"][-1] == pytest.approx(0, abs=1e-6)


def test_metrics_hold_their_definitions(ran):
    for r in ran.select("project", "cf_total").join(model.metrics(ran), "project").collect():
        assert sum(v / 1.08**t for t, v in enumerate(r["cf_total"])) == pytest.approx(r["npv_total"])
        if r["irr_total"] is not None:
            days = [(date(2024 + t, 12, 31) - date(2024, 12, 31)).days for t in range(len(r["cf_total"]))]
            assert sum(v / (1 + r["irr_total"]) ** (d / 365) for v, d in zip(r["cf_total"], days, strict=True)) == pytest.approx(0, abs=1e-2)


def test_sensitivity_is_the_same_plan_over_more_rows(spark):
    base = model_queries.projects(spark, SF)
    more = model.perturbed(base, ["capacity_price", "capex"], [-0.1, 0.1])
    got = {r["project"]: r["npv_total"] for r in model.metrics(model.run(more)).collect()}
    plain = {r["project"]: r["npv_total"] for r in model.metrics(model.run(base)).collect()}
    assert len(got) == 4 * len(plain)
    assert all(got[f"{p}|capacity_price|0.1"] > v > got[f"{p}|capex|0.1"] for p, v in plain.items())
    assert "Exchange hash" not in model.run(base)._jdf.queryExecution().executedPlan().toString()


def test_interest_by_irregular_periods(spark):
    p = [(date(2023, 2, 1), date(2023, 12, 31), 100.0), (date(2024, 1, 1), date(2024, 6, 30), 50.0), (date(2024, 7, 1), date(2024, 12, 31), 50.0)]
    df = spark.createDataFrame([(p,)], "p array<struct<start:date,end:date,invested:double>>")
    got = df.select(model.interest_by_periods(F.col("p"), 0.75, 0.04).alias("i")).first()["i"]
    days = [(b - a).days / 365 for a, b, _ in p]
    one = 75 * 0.04 * days[0] * 0.5
    assert got[0] == pytest.approx(one)
    for i in (1, 2):  # no compounding inside a year
        assert got[i] == pytest.approx((75 + one) * 0.04 * days[i] + 37.5 * 0.04 * days[i] * 0.5)


def test_chain_is_recalculated_precedents_first(spark):
    cells = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, "=a*2"), ("c", 3.0, "=b+1"), ("d", 6.0, "=SUM(a,b,c)"), ("e", 0.0, "=IF(d>10,d/0,-d)"), ("z", 9.0, "=9")], "id string, num double, formula string")
    got = {(r["scenario"], r["id"]): r["new"] for r in recalc.recalculate(cells, spark.createDataFrame([("s", "a", 2.0), ("t", "a", 5.0)], "scenario string, id string, num double")).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "s"} == {"a": 2.0, "b": 4.0, "c": 5.0, "d": 11.0, "e": None}
    assert got["t", "d"] == 26.0


def test_loop_settles(spark):
    cells = spark.createDataFrame([("s", 1.0, None), ("x", 0.0, "=0.5*y+s"), ("y", 0.0, "=0.5*x"), ("w", 0.0, "=x*2")], "id string, num double, formula string")
    got = {r["id"]: r["new"] for r in recalc.recalculate(cells, spark.createDataFrame([("a", "s", 3.0)], "scenario string, id string, num double"), tolerance=1e-6).collect()}
    assert got["x"] == pytest.approx(4.0, abs=1e-4) and got["w"] == pytest.approx(8.0, abs=1e-3)


def test_cycles_are_found(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "c")], "dependent string, precedent string")
    assert {(r["id"], r["component"]) for r in graph.strongly_connected(e).collect()} == {("a", "a"), ("b", "a"), ("d", "d")}


def test_roots_are_traced(spark):
    changes = spark.createDataFrame([("c",), ("b",), ("a",)], "id string")
    e = spark.createDataFrame([("c", "x", 0), ("c", "b", 1), ("b", "a", 0)], "dependent string, precedent string, operand_no int")
    assert {r["id"]: (r["root"], r["hops"]) for r in snapshot.trace_root(changes, e).collect()} == {"c": ("a", 2), "b": ("a", 1), "a": ("a", 0)}


def test_what_if_questions(spark):
    q = spark.createDataFrame([("电价 增加 10%",), ("price set to 5",), ("hello",)], "q string")
    got = [r["w"] for r in q.select(retrieval.what_if(F.col("q")).alias("w")).collect()]
    assert (got[0]["kind"], got[0]["amount"]) == ("up", 10.0) and (got[1]["kind"], got[1]["amount"]) == ("set", 5.0) and got[2] is None


def _workbook() -> bytes:
    ns, out = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="r"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.5</v></c><c r="C1"/></row><row r="2"><c r="AB2"><f>B1*2</f><v>5</v></c><c r="B2" t="e"><v>#N/A</v></c></row></sheetData><mergeCells><mergeCell ref="B1:B2"/></mergeCells></worksheet>')
    return out.getvalue()


def test_workbook_scan(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(_workbook())
    got = {(r["row"], r["col"]): (r["num"], r["txt"], r["tag"], r["formula"], r["merge_parent"]) for r in workbook.read_workbooks(spark, f"file://{tmp_path}/*.xlsx").collect()}
    assert got == {(1, 1): (None, "name", "string", None, None), (1, 2): (2.5, None, "number", None, None), (2, 28): (5.0, None, "formula", "=B1*2", None), (2, 2): (None, "#N/A", "error", None, "S_1_2")}


def test_graph_files_and_snapshots(spark, tmp_path):
    (tmp_path / "cells.json").write_text(json.dumps({"metadata": {}, "cells": [{"id": "S_1_A", "sheet": "S", "row": 1, "col": "A", "value": 2}], "dependencies": [{"from": "S_1_B", "to": "S_1_A"}]}))
    cells, edges = stores.read_graph(spark, f"file://{tmp_path}/cells.json")
    assert [(r["id"], r["num"]) for r in cells.collect()] == [("S_1_A", 2.0)] and edges.first()["precedent"] == "S_1_A"
    values = spark.createDataFrame([("a", 1.0, None)], "id string, num double, txt string")
    for name, df in (("one", values), ("two", values.limit(0)), ("one", values.withColumn("num", F.lit(3.0)))):
        stores.write_snapshot(df, f"file://{tmp_path}/snap", "t", name)
    assert stores.read_snapshot(spark, f"file://{tmp_path}/snap", "t", "one").collect()[0]["num"] == 3.0
    records = spark.createDataFrame([("t", 1, "x"), ("t", 2, "y"), ("u", 1, "z")], "task_id string, saved_at int, v string")
    assert {r["v"] for r in stores.latest(records, ["task_id"]).collect()} == {"y", "z"}
    assert [r["v"] for r in stores.newest(records, "t", 1).collect()] == ["y"]


def test_edits_as_a_stream(spark, tmp_path):
    spark.createDataFrame([("s", "a", 2.0, 1), ("s", "a", 4.0, 2)], "scenario string, id string, num double, t int").withColumn("ts", F.timestamp_seconds("t")).drop("t").write.parquet(f"{tmp_path}/in")
    cells = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, "=a*2")], "id string, num double, formula string")
    source = spark.readStream.schema("scenario string, id string, num double, ts timestamp").parquet(f"{tmp_path}/in")
    stream.recalculate_stream(source, cells, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination(120)
    assert {r["id"]: r["new"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a": 4.0, "b": 8.0}
    assert stream.edit_rates(source).isStreaming


def test_graph_rounds_that_run_out_are_an_error(spark):
    chain = spark.createDataFrame([(f"c{i + 1}", f"c{i}") for i in range(4)], "dependent string, precedent string")
    for f in (graph.levels, graph.cyclic_core):
        with pytest.raises(RuntimeError):
            f(chain, max_rounds=2)
    ids = spark.createDataFrame([(f"c{i}",) for i in range(5)], "id string")
    with pytest.raises(RuntimeError):
        graph._least_label(chain.selectExpr("precedent as src", "dependent as dst"), ids, max_rounds=2)
    with pytest.raises(RuntimeError):
        graph.strongly_connected(spark.createDataFrame([("a", "a"), ("b", "b"), ("b", "a")], "dependent string, precedent string"), max_rounds=1)
    for f in (graph.reach, graph.downstream):
        assert inspect.signature(f).parameters["max_depth"].default is None
    seed = spark.createDataFrame([("c0",)], "id string")
    assert graph.downstream(chain, seed).count() == 5 and graph.downstream(chain, seed, 2).count() == 3


def test_errors_reach_what_depends_on_them(spark):
    cells = spark.createDataFrame([("a", 1.0, None), ("e", 1.0, "=1/a"), ("f", 2.0, "=e+1"), ("g", 0.0, "=IFERROR(f,7)"), ("h", 0.0, "=IF(a=0,5,e)"), ("m", 0.0, "=MAX(e,3)")], "id string, num double, formula string")
    got = {r["id"]: r["new"] for r in recalc.recalculate(cells, spark.createDataFrame([("s", "a", 0.0)], "scenario string, id string, num double")).collect()}
    assert got == {"a": 0.0, "e": None, "f": None, "g": 7.0, "h": 5.0, "m": None}


def test_ranges_sheets_and_date_functions(spark):
    rows = [(f"S!A{i}", float(i), None, None) for i in range(1, 6)] + [(f"S!B{i}", None, None, "xy"[i % 2]) for i in range(1, 6)]
    formulas = {
        "S!C1": "=SUM(A1:$A$5)", "S!C2": "=AVERAGE(A1:A5)*2", "S!C3": "=MAX(A1:A5,9)-MIN(A1:A3)", "S!C4": '=SUMIF(B1:B5,"x",A1:A5)', "S!C5": '=COUNTIF(B1:B5,"y")',
        "My Sheet!A1": "=S!C1+'S'!$A$2", "My Sheet!A2": "=SUM(S!C1:C3)", "My Sheet!B1": '=DATEDIF(45258,47483,"d")+A1*0', "My Sheet!B2": "=YEAR(EDATE(DATE(2024,1,31),1))+S!A1*0",
        "My Sheet!B3": "=ROUNDUP(S!A1/3,1)", "My Sheet!B4": "=VLOOKUP(S!A1)",
    }
    cells = spark.createDataFrame([*rows, *((k, 0.0, v, None) for k, v in formulas.items())], "id string, num double, formula string, txt string")
    got = {r["id"]: r["new"] for r in recalc.recalculate(cells, spark.createDataFrame([("s", "S!A1", 11.0)], "scenario string, id string, num double")).collect()}
    want = {"S!A1": 11.0, "S!C1": 25.0, "S!C2": 10.0, "S!C3": 9.0, "S!C4": 6.0, "My Sheet!A1": 27.0, "My Sheet!A2": 44.0, "My Sheet!B1": 2225.0, "My Sheet!B2": 2024.0, "My Sheet!B3": 3.7, "My Sheet!B4": None}
    assert {k: v if v is None else round(v, 9) for k, v in got.items()} == want


def test_windows_of_a_stream(spark, tmp_path):
    rows = [("s", 0), ("s", 400), ("s", 3000), ("t", 100)]
    spark.createDataFrame(rows, "scenario string, t int").select("scenario", F.timestamp_seconds("t").alias("ts")).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("scenario string, ts timestamp").parquet(f"{tmp_path}/in")
    got = {}
    for name, df in (("sessions", stream.sessions(source)), ("sliding", stream.sliding_rates(source))):
        df.writeStream.format("memory").queryName(f"w_{name}").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
        got[name] = sorted((r["scenario"], int(r["start"].timestamp()), r["n"]) for r in spark.table(f"w_{name}").collect())
    assert got["sessions"] == [("s", 0, 2), ("s", 3000, 1), ("t", 100, 1)]
    assert ("s", 0, 2) in got["sliding"] and ("s", -300, 1) in got["sliding"]


def test_workspace_and_repairs(spark):
    from quillgrid.operators import checks, signatures, workspace

    cells = spark.createDataFrame([("S", 1, 1, 1.0, "=A2+$B$1"), ("S", 1, 2, 5.0, None), ("S", 1, 3, 1.0, "=C2+$B$1"), ("S", 1, 4, 2.0, None)], "sheet string, row int, col int, num double, formula string")
    assert [tuple(r) for r in signatures.repairs(cells).collect()] == [("S", 1, 2, "=B2+$B$1")]
    items = spark.createDataFrame([(2, "Net Price", 2), (1, "price of power", 1), (3, "other", 3)], "item_id int, name string, place int")
    assert [tuple(r) for r in workspace.by_keywords(items, ["PRICE", "none"]).collect()] == [("PRICE", 1)]
    text = spark.createDataFrame([("1,200.5",), ("true",), ("x",)], "t string")
    assert [r[0] for r in text.select(workspace.safe_number(F.col("t"))).collect()] == [1200.5, None, None]
    roles = spark.createDataFrame([("S", 1, "total", None), ("S", 2, "time_series", "2024"), ("S", 3, "time_series", "2025")], "sheet string, col int, role string, period string")
    got = workspace.synced(spark.createDataFrame([(7, "S", 1)], "item_id int, sheet string, row int"), cells.drop("formula"), roles).first()
    assert got["series"] == {"2024": 5.0, "2025": 1.0} and got["summary"] == 1.0
    blocks = spark.createDataFrame([("S", 9, "=SUMIF($C$1:$F$1,A9,$C$2:$F$2)", "H"), ("S", 8, "=SUMIF($C$1:$F$1,A9,$C$2:$F$2)", "F")], "sheet string, row int, formula string, data_end string")
    assert [r["row"] for r in checks.short_ranges(blocks).collect()] == [9]
    defects = spark.createDataFrame([("warning", "S", 1), ("critical", "S", 2)], "severity string, sheet string, row int")
    assert [r["row"] for r in checks.by_severity(defects).collect()] == [2, 1]
