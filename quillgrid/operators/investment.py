"""Investment by year from items and years: static part, price contingency, progress; and whether the years fit the construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

CONTINGENCY = "价差预备费"  # fixed value: the item that is the contingency itself


def by_year(items: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, year, static_investment, price_contingency, construction_investment, progress).

    items: project, year, item, amount; projects: project, start_year, end_year, escalation. A project with a contingency item has
    that one, 0 in years without it; another one has static * ((1 + escalation)^n - 1) in the n-th year, none in the first or
    before. Progress is a year's share of the project's total, 0 if that isn't above 0. Null amounts are 0, a null escalation is
    none, rows without a project or year and projects that aren't listed take no part; items in the same year are added up.
    """
    own = F.coalesce(F.col("item") == CONTINGENCY, F.lit(False))
    amount = F.coalesce("amount", F.lit(0.0))
    years = items.dropna(subset=["project", "year"]).groupBy("project", "year").agg(F.sum(F.when(own, 0.0).otherwise(amount)).alias("static_investment"), F.sum(F.when(own, amount)).alias("own"))
    whole = Window.partitionBy("project")  # a row a year
    n = F.col("year") - F.col("start_year") + 1
    rise = F.when(n > 1, F.pow(1 + F.coalesce("escalation", F.lit(0.0)), n) - 1).otherwise(0.0)
    given = F.max(F.col("own").isNotNull()).over(whole)
    df = years.withColumn("given", given).join(projects.select("project", "start_year", "escalation"), "project")
    df = df.withColumn("price_contingency", F.when(F.col("given"), F.coalesce("own", F.lit(0.0))).otherwise(F.col("static_investment") * rise))
    df = df.withColumn("construction_investment", F.col("static_investment") + F.col("price_contingency"))
    total = F.sum("construction_investment").over(whole)
    return df.select("project", "year", "static_investment", "price_contingency", "construction_investment", F.when(total > 0, F.col("construction_investment") / total).otherwise(0.0).alias("progress"))


def coverage(items: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, missing, extra): years of the construction without an item, and years of items outside it; sorted.

    Projects whose years all fit are left out; one without items lacks all its years. Projects without a start or end are left out.
    """
    known = items.where("year is not null").select("project", F.col("year").cast("int").alias("year")).distinct().groupBy("project").agg(F.sort_array(F.collect_list("year")).alias("years"))
    built = F.when(F.col("start_year") <= F.col("end_year"), F.sequence(F.col("start_year").cast("int"), F.col("end_year").cast("int"))).otherwise(F.array().cast("array<int>"))
    both = projects.where("start_year is not null and end_year is not null").select("project", built.alias("built")).join(known, "project", "left").withColumn("years", F.coalesce("years", F.array().cast("array<int>")))
    return both.select("project", F.array_except("built", "years").alias("missing"), F.array_except("years", "built").alias("extra")).where("size(missing) + size(extra) > 0")
