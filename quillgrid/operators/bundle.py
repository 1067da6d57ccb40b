"""Metrics of a workbook from its line items: ranked rules say which item a metric is read from, and what is computed if none is.

A rule is a field, a rank, a way to read, words of which the item's name holds one (any), all or none, and a preferred table. An item
meets the rules inside its own row, so nothing is joined to find them; of the rules of a field the best that yields enough wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.finance import irr, npv
from quillgrid.operators.graph import cut

SUMMARY_COLUMN = 4  # the column that holds an item's result
DEFAULT_RATE = 0.08
NET = "净现金流量"

# Fixed values: (field, rank, way, any, all, none, preferred table).
RULES = [
    ("flows", 1, "series", [], ["资本金", "税后", NET], ["累计"], None),
    ("flows", 2, "series", [], ["税后", NET], ["累计", "资本金"], None),
    ("flows", 3, "series", ["项目投资现金流量", "全部投资现金流量", "资本金现金流量", NET], [], [], None),
    ("flows", 4, "cells", ["项目投资现金流量", "全部投资现金流量", "资本金现金流量", NET], [], [], None),
    ("flows", 5, "series", ["现金流量"], [], [], None),
    ("flows_before", 1, "series", ["项目投资现金流量(税前)", "税前现金流量"], [], [], None),
    ("flows_before", 2, "cells", ["项目投资现金流量(税前)", "税前现金流量"], [], [], None),
    ("cover", 1, "series", ["偿债备付率", "DSCR"], [], [], None),
    ("cover", 2, "cells", ["偿债备付率", "DSCR"], [], [], None),
    ("irr_after_tax", 1, "result", ["资本金内部收益率（税后）", "资本金内部收益率(税后)"], [], [], None),
    ("irr_before_tax", 1, "result", ["资本金内部收益率（税前）", "资本金内部收益率(税前)"], [], [], None),
    ("payback_period", 1, "result", ["投资回收期"], [], [], "表6"),
    ("rate", 1, "total", ["基准收益率", "折现率", "贴现率", "基准折现率"], [], [], None),
    ("total_investment_static", 1, "total", ["静态总投资", "工程静态投资"], [], [], None),
    ("total_investment_dynamic", 1, "total", ["动态总投资", "工程动态投资", "总投资"], [], [], None),
    ("loan_repayment_period", 1, "total", ["借款偿还期", "贷款偿还期", "还款期"], [], [], None),
    ("total_revenue", 1, "sum", ["营业收入", "总收入", "售电收入", "电费收入"], [], [], None),
    ("total_cost", 1, "sum", ["总成本", "经营成本", "综合购电成本"], [], [], None),
    ("total_tax", 1, "sum", ["所得税", "税金总额", "税费合计"], [], [], None),
    ("annual_net_cashflow", 1, "mean", [NET, "净现金流", "累计盈余资金"], [], [], None),
]
#: Points that a series of a field needs, and whether they must have a year.
LEAST = {"flows": 2, "flows_before": 2, "cover": 1}
FIELDS = ["irr_after_tax", "irr_before_tax", "payback_period", "total_investment_static", "total_investment_dynamic", "loan_repayment_period", "total_revenue", "total_cost", "total_tax", "annual_net_cashflow"]


def matching(name: Column, rules: list[tuple] = RULES) -> Column:
    """The rules (field, rank, way, preferred) that a name meets."""
    has = lambda words: [F.contains(name, F.lit(w)) for w in words]

    def one(rule: tuple) -> Column:
        field, rank, way, some, every, no, preferred = rule
        ok = F.lit(True)
        for c in has(every):
            ok &= c
        for c in has(no):
            ok &= ~c
        if some:
            either = F.lit(False)
            for c in has(some):
                either |= c
            ok &= either
        return F.when(ok, F.struct(F.lit(field).alias("field"), F.lit(rank).alias("rank"), F.lit(way).alias("way"), F.lit(preferred).cast("string").alias("preferred")))

    return F.filter(F.array(*(one(r) for r in rules)), lambda r: r.isNotNull())


def payback_of(flows: Column) -> Column:
    """Periods until the running sum first goes from below 0 to 0 or more, interpolated; null if it never does."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("t"), F.lit(None).cast("double").alias("found"))

    def step(s: Column, v: Column) -> Column:
        now = s["sum"] + v
        crosses = s["found"].isNull() & (s["sum"] < 0) & (now >= 0)
        return F.struct(now.alias("sum"), (s["t"] + 1).alias("t"), F.when(crosses, s["t"] - 1 + F.try_divide(-s["sum"], v)).otherwise(s["found"]).alias("found"))

    return F.aggregate(flows, start, step, lambda s: s["found"])


def bundle(items: DataFrame, cells: DataFrame, rules: list[tuple] = RULES) -> DataFrame:
    """One row a book with its metrics; null where nothing yields one.

    items: book, item_id, place (order in the book), table, row, name, total; cells: book, item_id, col, num, period (label of a
    time column, else null). A series is the first item's by place that has points enough, a period's last column counting; the
    way ``cells`` takes those of all matching items together, the last by place. Results are read from column D, of the preferred
    table if it has one. Of numbers at one place the greatest counts, in sums all. A sum of 0 is none. Rates over 1 are percent. What isn't read is computed from the flows; sources tell
    which. Items without a name and cells without a number or an item are left out; a book of such items has nulls.
    """
    least = F.create_map(*(F.lit(x) for pair in LEAST.items() for x in pair))
    hits = items.select("book", "item_id", "place", "table", "row", "total", F.explode(matching(F.col("name"), rules)).alias("rule")).select("book", "item_id", "place", "table", "row", "total", "rule.*")
    held = cut(hits.where("way <> 'total'").join(cells.where("num is not null").select("book", "item_id", "col", "num", "period"), ["book", "item_id"]))

    year = F.nullif(F.regexp_extract("period", r"([0-9]{4})", 1), F.lit("")).try_cast("int")
    dated = held.where("way in ('series', 'cells') and period is not null").withColumns({"year": year, "owner": F.when(F.col("way") == "series", F.col("place")).otherwise(-1)})
    dated = dated.where("field = 'cover' or year is not null")
    points = dated.groupBy("book", "field", "rank", "owner", "period", "year").agg(F.max_by("num", F.struct("place", "col", "num")).alias("num"))
    lines = points.groupBy("book", "field", "rank", "owner").agg(F.array_sort(F.collect_list(F.struct("year", "num", "period"))).alias("line")).where(F.size("line") >= least[F.col("field")])
    lines = lines.groupBy("book", "field").agg(F.min_by("line", F.struct("rank", "owner")).alias("line"))

    place = F.struct(F.coalesce(~F.contains("table", "preferred"), F.col("preferred").isNotNull()).alias("other"), "place", "row", (-F.col("num")).alias("least"))
    read = held.where((F.col("way") == "result") & (F.col("col") == SUMMARY_COLUMN)).groupBy("book", "field").agg(F.min_by(F.struct("num", F.concat("table", F.lit(" D"), F.col("row").cast("string")).alias("source")), place).alias("r")).select("book", "field", "r.num", "r.source")
    none = F.lit(None).cast("string").alias("source")
    totals = hits.where("way = 'total'").groupBy("book", "field").agg(F.min_by(F.struct("total"), F.struct("place", "row")).alias("r")).select("book", "field", F.col("r.total").alias("num"), none)
    sums = held.where("way in ('sum', 'mean')").groupBy("book", "field", "way").agg(F.sum("num").alias("sum"), F.avg("num").alias("mean"))
    sums = sums.select("book", "field", F.when(F.col("way") == "mean", F.col("mean")).otherwise(F.nullif("sum", F.lit(0.0))).alias("num"), none)

    values = read.unionByName(totals).unionByName(sums)
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    wide = values.groupBy("book").agg(*(pick(f, "num").alias(f) for f in [*FIELDS, "rate"]), *(pick(f, "source").alias(f"{f}_source") for f in FIELDS[:3]))
    series = lines.groupBy("book").agg(*(F.max(F.when(F.col("field") == f, F.col("line"))).alias(f) for f in LEAST))
    all_of = items.select("book").distinct().join(wide, "book", "left").join(series, "book", "left")

    rate = F.coalesce("rate", F.lit(DEFAULT_RATE))
    nums = lambda c: F.transform(c, lambda p: p["num"])
    cover = nums("cover")
    df = all_of.withColumns({"rate": F.when(rate > 1, rate / 100).otherwise(rate), "flows": nums("flows"), "before": nums("flows_before"), "asked": F.col("irr_before_tax").isNull()})
    computed = {"irr_after_tax": irr(F.col("flows")), "payback_period": payback_of(F.col("flows")), "irr_before_tax": irr(F.col("before"))}
    df = df.withColumns({f"{k}_own": v for k, v in computed.items()})
    source = {k: F.when(F.col(k).isNotNull(), F.col(f"{k}_source")).when(F.col(f"{k}_own").isNotNull(), F.lit("computed")) for k in computed}
    sources = F.map_filter(F.create_map(*(x for k, v in source.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    return df.select(
        "book", *(F.coalesce(k, f"{k}_own").alias(k) for k in computed),
        npv(F.col("flows"), F.col("rate")).alias("npv_after_tax"), F.when(F.col("asked"), npv(F.col("before"), F.col("rate"))).alias("npv_before_tax"),
        F.map_from_entries(F.transform("cover", lambda p: F.struct(p["period"], p["num"]))).alias("cover_series"),
        (F.aggregate(cover, F.lit(0.0), lambda a, v: a + v) / F.size(cover)).alias("cover_avg"), F.array_min(cover).alias("cover_min"),
        *FIELDS[3:], sources.alias("sources"),
    )
