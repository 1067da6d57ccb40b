"""Answers to a batch of questions over one model: every what-if is a scenario of one recalculation, the rest falls through tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.operators import bundle, retrieval
from quillgrid.operators.graph import cut
from quillgrid.operators.recalc import recalculate

# Questions of a change (way, pattern with parameter, amount and target).
QUESTIONS = [
    ("up", r"如果(.{1,30})[提升增涨加]加?(.{1,5})%(.{1,20})变[成化]多[少大]?"), ("up", r"假设(.{1,30})[提升增涨加]加?(.{1,5})%(.{1,20})变[成化]多[少大]?"), ("up", r"(.{1,30})[提升增涨加]加?(.{1,5})%后(.{1,20})变[成化]多[少大]?"),
    ("down", r"如果(.{1,30})[降减缩下]低?(.{1,5})%(.{1,20})变[成化]多[少大]?"), ("down", r"假设(.{1,30})[降减缩下]低?(.{1,5})%(.{1,20})变[成化]多[少大]?"), ("down", r"(.{1,30})[降减缩下]低?(.{1,5})%后(.{1,20})变[成化]多[少大]?"),
    ("set", r"如果(.{1,30})为(.{1,20})[，,则]?(.{1,20})变[成化]多[少大]?"), ("set", r"假设(.{1,30})为(.{1,20})[，,则]?(.{1,20})变[成化]多[少大]?"),
]
# Words of a question and the metric they ask for, the narrower before the wider.
ASKED = [
    ("irr.*税.*前", "irr_before_tax"), ("irr", "irr_after_tax"), ("内部收益率", "irr_after_tax"), ("净现值.*税.*前", "npv_before_tax"), ("净现值.*税.*后", "npv_after_tax"), ("回收期", "payback_period"),
    ("dscr.*最低", "cover_min"), ("dscr", "cover_avg"), ("npv", "npv_after_tax"),
]
METRICS = ["irr_after_tax", "irr_before_tax", "npv_after_tax", "npv_before_tax", "payback_period", "cover_avg", "cover_min"]
RETURNS = ["flows", "flows_before", "rate", "irr_after_tax", "irr_before_tax", "payback_period"]  # fields read together
DEFAULT_PERCENT = 10.0


def parsed(question: Column) -> Column:
    """(way, param, amount, target) of a what-if question; null if it is none. A change without a number is one of ten percent."""
    short = retrieval.what_if(question)
    out = F.when(short.isNotNull(), F.struct(short["kind"].alias("way"), short["param"].alias("param"), short["amount"].alias("amount"), F.lit("").alias("target")))
    for way, pattern in reversed(QUESTIONS):
        said = F.regexp_replace(F.regexp_extract(question, pattern, 2), ",", "")
        number = F.regexp_extract(said, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
        amount = number if way == "set" else F.coalesce(number, F.lit(DEFAULT_PERCENT))
        one = F.struct(F.lit(way).alias("way"), F.trim(F.regexp_extract(question, pattern, 1)).alias("param"), amount.alias("amount"), F.trim(F.regexp_extract(question, pattern, 3)).alias("target"))
        out = F.when(question.rlike(pattern) & one["amount"].isNotNull(), one).otherwise(out)
    return out


def metric_asked(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, key in reversed(ASKED):
        out = F.when(F.lower(text).rlike(pattern), F.lit(key)).otherwise(out)
    return out


def _long(metrics: DataFrame) -> DataFrame:
    """(book, metric, value) of the metrics that aren't null."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    return metrics.select("book", F.explode(pairs).alias("m")).select("book", "m.*").where("value is not null")


def metrics_after(items: DataFrame, points: DataFrame, changed: DataFrame) -> DataFrame:
    """(scenario, metric, before, after) of what a scenario's changes reach, and (null, metric, before, before) for the base.

    items: item_id, place, table, row, name, total, total_id; points: item_id, id, col, num, period; changed: scenario, id, new.
    Of a scenario only the groups of fields that hold a changed cell are computed; returns are one group.
    """
    hits = items.select("item_id", "total_id", F.explode(bundle.matching(F.col("name"))).alias("r"))
    field = F.col("r.field")
    grouped = cut(hits.select("item_id", "total_id", F.when(field.isin(RETURNS), F.lit("returns")).otherwise(field).alias("group")).distinct())
    inputs = points.select("item_id", "id").unionByName(items.where("total_id is not null").select("item_id", F.col("total_id").alias("id"))).distinct()
    touched = changed.select("scenario", "id").join(inputs, "id").join(grouped.select("item_id", "group"), "item_id").select("scenario", "group").distinct()
    own = cut(touched.join(grouped.select("item_id", "group"), "group").select("scenario", "item_id").distinct().join(items, "item_id"))
    new = changed.select("scenario", "id", F.col("new"), F.lit(True).alias("moved"))
    value = lambda old: F.when(F.col("moved"), F.col("new")).otherwise(F.col(old))
    own_items = own.join(new.withColumnRenamed("id", "total_id"), ["scenario", "total_id"], "left").select(F.col("scenario").alias("book"), "item_id", "place", "table", "row", "name", value("total").alias("total"))
    own_points = own.select("scenario", "item_id").join(points, "item_id").join(new, ["scenario", "id"], "left").select(F.col("scenario").alias("book"), "item_id", "col", value("num").alias("num"), "period")
    base = cut(_long(bundle.bundle(items.withColumn("book", F.lit("")), points.withColumn("book", F.lit("")))).select("metric", F.col("value").alias("before")))
    after = _long(bundle.bundle(own_items, own_points)).select(F.col("book").alias("scenario"), "metric", F.col("value").alias("after"))
    # a metric of a touched group that has no value any more has none after it, one of another group stays
    group = F.when(F.col("metric").isin("cover_avg", "cover_min"), F.lit("cover")).otherwise(F.lit("returns"))
    there = touched.join(base.withColumn("group", group), "group").select("scenario", "metric", "before")
    moved = there.join(after, ["scenario", "metric"], "full")
    return moved.unionByName(base.select(F.lit(None).cast("string").alias("scenario"), "metric", "before", F.col("before").alias("after")))


def answer(questions: DataFrame, params: DataFrame, cells: DataFrame, items: DataFrame, points: DataFrame) -> DataFrame:
    """(question_id, tier, item_id, param_before, param_after, metric, asked, before, after, delta, percent): answers, a row a metric.

    questions: question_id (long), question; params: item_id (long), id (cell), name, num, place; cells as recalculate takes them; items
    and points as ``metrics_after`` does. Tier what_if: the question changes a parameter that is found (likeness 0.4 or more);
    metrics that the change doesn't reach stay. Tier metric: it asks for a metric that the model has. Tier open: the rest, null
    questions among it, without a metric. What-ifs over a model without metrics are rows without a metric. Questions that make
    the same change share a scenario.
    """
    said = cut(questions.select("question_id", "question", parsed(F.col("question")).alias("p")).select("question_id", "question", "p.*"))
    found = retrieval.param_of(said.where("param is not null").select("question_id", F.col("param").alias("query")), params)
    known = params.select(F.col("item_id").cast("long").alias("item_id"), "id", F.col("num").alias("param_before"))
    change = F.when(F.col("way") == "set", F.col("amount")).otherwise(F.col("param_before") * (1 + F.when(F.col("way") == "up", F.col("amount")).otherwise(-F.col("amount")) / 100))
    asked = cut(said.join(found.select("question_id", "item_id"), "question_id").join(known, "item_id").withColumn("param_after", change).withColumn("scenario", F.concat_ws("=", "id", F.col("param_after").cast("string"))))
    edits = asked.select("scenario", "id", F.col("param_after").alias("num")).distinct()
    none = cells.limit(0).select(F.lit(None).cast("string").alias("scenario"), "id", F.col("num").alias("new"))
    changed = none if edits.isEmpty() else cut(recalculate(cells, edits).select("scenario", "id", "new"))
    metrics = cut(metrics_after(items, points, changed))
    base = metrics.where("scenario is null").select("metric", "before").withColumn("all", F.lit(1))
    # the metrics are seven at most, so every what-if has a row for each
    every = asked.withColumn("all", F.lit(1)).join(F.broadcast(base), "all", "left").select("question_id", "question", "target", "item_id", "param_before", "param_after", "scenario", "metric")
    fresh = asked.join(metrics.where("scenario is not null and before is null").select("scenario", "metric"), "scenario").select(*every.columns)
    each = every.unionByName(fresh).join(metrics.where("scenario is not null").withColumn("moved", F.lit(True)), ["scenario", "metric"], "left")
    each = each.join(F.broadcast(base.select("metric", F.col("before").alias("base"))), "metric", "left")
    wanted = F.coalesce(metric_asked(F.col("target")), metric_asked(F.col("question")))
    one = each.select("question_id", F.lit("what_if").alias("tier"), "item_id", "param_before", "param_after", "metric", F.coalesce(wanted == F.col("metric"), F.lit(False)).alias("asked"), F.col("base").alias("before"), F.when(F.col("moved"), F.col("after")).otherwise(F.col("base")).alias("after"))
    rest = questions.join(asked.select("question_id").distinct(), "question_id", "left_anti").withColumn("metric", metric_asked(F.col("question")))
    rest = rest.join(F.broadcast(base.drop("all")), "metric", "left")
    two = rest.select("question_id", F.when(F.col("before").isNotNull(), "metric").otherwise("open").alias("tier"), F.when(F.col("before").isNotNull(), F.col("metric")).alias("metric"), F.col("before").isNotNull().alias("asked"), "before")
    out = one.unionByName(two, allowMissingColumns=True)
    delta = F.col("after") - F.col("before")
    return out.withColumns({"delta": delta, "percent": F.try_divide(delta, F.abs("before")) * 100})
