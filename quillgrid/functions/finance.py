"""Financial functions as Spark expressions: discounting, rates of return, payback, loans, depreciation, tax.

Series are arrays in time order. Nulls in a series count as 0; an empty or null series gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _series(flows: Column) -> Column:
    return F.transform(flows, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))


def npv(flows: Column, rate: Column | float) -> Column:
    """Net present value; the first flow isn't discounted."""
    rate = F.lit(rate) if isinstance(rate, (int, float)) else rate
    discounted = F.transform(flows, lambda v, t: F.coalesce(v.cast("double"), F.lit(0.0)) / F.pow(1 + rate, t))
    return F.when(F.size(flows) > 0, F.aggregate(discounted, F.lit(0.0), lambda a, v: a + v))


def xnpv(flows: Column, days: Column, rate: Column | float, basis: float = 365.0) -> Column:
    """Net present value with each flow's days since the first."""
    rate = F.lit(rate) if isinstance(rate, (int, float)) else rate
    discounted = F.zip_with(_series(flows), days, lambda v, d: v / F.pow(1 + rate, d / F.lit(basis)))
    return F.when(F.size(flows) > 0, F.aggregate(discounted, F.lit(0.0), lambda a, v: a + v))


def bisect(value, low: float, high: float, steps: int = 60) -> Column:
    """Root of value(rate) between low and high, which must have different signs there; null if they haven't."""
    start = F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), value(F.lit(low)).alias("at_low"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        same = F.signum(value(mid)) == F.signum(s["at_low"])
        return F.struct(F.when(same, mid).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(mid).alias("high"), s["at_low"].alias("at_low"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["low"] + s["high"]) / 2)
    return F.when(F.signum(value(F.lit(low))) * F.signum(value(F.lit(high))) < 0, found)


def irr(flows: Column, low: float = -0.5, high: float = 1.0, steps: int = 60) -> Column:
    """Periodic internal rate of return; null unless both signs occur and the bracket holds a root."""
    both = F.exists(flows, lambda v: v > 0) & F.exists(flows, lambda v: v < 0)
    return F.when(both, bisect(lambda r: npv(flows, r), low, high, steps))


def xirr(flows: Column, days: Column, low: float = -0.5, high: float = 1.0, steps: int = 60) -> Column:
    """Internal rate of return of dated flows, on days / 365."""
    both = F.exists(flows, lambda v: v > 0) & F.exists(flows, lambda v: v < 0)
    return F.when(both, bisect(lambda r: xnpv(flows, days, r), low, high, steps))


def payback(rows: DataFrame, keys: list[str], order: str, flow: str) -> DataFrame:
    """keys, payback: periods until the running sum first goes from below 0 to 0 or more, interpolated; 0 if it starts there."""
    w = Window.partitionBy(*keys).orderBy(order)
    running = rows.withColumn("cum", F.sum(flow).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumns(
        {"t": F.row_number().over(w) - 1, "before": F.col("cum") - F.col(flow)}
    )
    crossing = F.when((F.col("t") == 0) & (F.col("cum") >= 0), F.lit(0.0)).when(
        (F.col("t") > 0) & (F.col("before") < 0) & (F.col("cum") >= 0), F.col("t") - 1 + (-F.col("before")) / F.col(flow)
    )
    return running.withColumn("crossing", crossing).groupBy(*keys).agg(F.min("crossing").alias("payback"))


def equal_instalment(principal: Column, rate: Column, k: Column, n: Column) -> dict[str, Column]:
    """Payment, interest, principal part and balance after the k-th of n equal instalments, in closed form."""
    growth = lambda i: F.pow(1 + rate, i)
    payment = F.when(rate == 0, principal / n).otherwise(principal * rate / (1 - growth(-n)))
    balance = lambda i: F.when(rate == 0, principal * (1 - i / n)).otherwise(principal * growth(i) - payment * (growth(i) - 1) / rate)
    interest = balance(k - 1) * rate
    return {"payment": payment, "interest": interest, "principal_part": payment - interest, "balance": F.greatest(F.lit(0.0), balance(k))}


def equal_principal(principal: Column, rate: Column, k: Column, n: Column) -> dict[str, Column]:
    """The same for equal parts of principal."""
    interest = principal * (1 - (k - 1) / n) * rate
    return {"payment": principal / n + interest, "interest": interest, "principal_part": principal / n, "balance": F.greatest(F.lit(0.0), principal * (1 - k / n))}


def straight_line(original: Column, salvage: Column | float, life: Column, age: Column, cap_at_life: bool = False) -> Column:
    """Depreciation of one year; the age counts from 1. Without the cap it goes on past the life."""
    salvage = F.lit(salvage) if isinstance(salvage, (int, float)) else salvage
    yearly = original * (1 - salvage) / life
    return F.when(age <= life, yearly).otherwise(0.0) if cap_at_life else yearly


def loss_carry_forward(profits: Column, rate: float, years: int = 5) -> Column:
    """Array of (profit, used_loss, taxable, tax) for profits in year order: losses are used oldest first, for ``years`` years."""
    start = F.struct(
        F.array().cast("array<struct<age:int,left:double>>").alias("losses"),
        F.array().cast("array<struct<profit:double,used_loss:double,taxable:double,tax:double>>").alias("out"),
    )

    row = lambda profit, used, taxable: F.struct(profit.alias("profit"), used.alias("used_loss"), taxable.alias("taxable"), (taxable * rate).alias("tax"))
    # a value that is used more than once is bound by a walk over an array of it; else it is computed again at each use
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))

    def used_up(aged: Column, used: Column) -> Column:
        """Oldest first: each loss gives what the ones before it leave to use."""
        return F.aggregate(
            aged,
            F.struct(used.alias("need"), F.array().cast("array<struct<age:int,left:double>>").alias("kept")),
            lambda a, x: F.struct(
                (a["need"] - F.least(a["need"], x["left"])).alias("need"),
                F.array_append(a["kept"], F.struct(x["age"].alias("age"), (x["left"] - F.least(a["need"], x["left"])).alias("left"))).alias("kept"),
            ),
            lambda a: a["kept"],
        )

    def step(s: Column, profit: Column) -> Column:
        aged = F.filter(F.transform(s["losses"], lambda x: F.struct((x["age"] + 1).alias("age"), x["left"].alias("left"))), lambda x: (x["age"] <= years) & (x["left"] > 0))

        def settled(aged: Column, used: Column) -> Column:
            losses = F.when(profit < 0, F.array_append(aged, F.struct(F.lit(0).alias("age"), (-profit).alias("left")))).when(used > 0, used_up(aged, used)).otherwise(aged)
            return F.struct(losses.alias("losses"), F.array_append(s["out"], row(profit, used, F.greatest(F.lit(0.0), profit - used))).alias("out"))

        have = lambda aged: F.aggregate(aged, F.lit(0.0), lambda a, x: a + x["left"])
        used = lambda aged: F.when((profit > 0) & (F.size(aged) > 0), F.least(profit, have(aged))).otherwise(0.0)
        return bound(aged, lambda a: bound(used(a), lambda u: settled(a, u)))

    series = _series(profits)
    simple = F.transform(series, lambda v: row(v, F.lit(0.0), F.greatest(F.lit(0.0), v)))
    return F.when(F.exists(profits, lambda v: v < 0), F.aggregate(series, start, step, lambda s: s["out"])).when(profits.isNotNull(), simple)


def capped_running_sum(amounts: Column, cap: Column | float) -> Column:
    """Running sums that stop at the cap: what each step adds is cut to the room that is left."""
    cap = F.lit(float(cap)) if isinstance(cap, (int, float)) else cap
    start = F.array().cast("array<double>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0))
    return F.aggregate(_series(amounts), start, lambda a, v: F.array_append(a, F.least(cap, last(a) + F.greatest(v, F.lit(0.0)))))


def in_order(order: str, value: str) -> Column:
    """The values of a group as an array in the order of another column; an aggregate expression."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))), lambda s: s["v"])


def debt_ratio(liabilities: Column, assets: Column) -> Column:
    """Liabilities over assets; null without assets."""
    return F.when(assets > 0, liabilities / assets)


def return_on_equity(profit: Column, equity: Column) -> Column:
    """An aggregate over years: total profit over mean equity, by the number of years with a profit or loss."""
    years, mean = F.count(F.when(profit != 0, 1)), F.avg(equity)
    return F.when((mean > 0) & (years > 0), F.sum(profit) / mean / years)
