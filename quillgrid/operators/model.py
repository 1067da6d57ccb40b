"""The project model: parameters to yearly statements to return metrics.

One row is one project (or scenario); its years are arrays. So a whole model run is a chain of projections: nothing is
shuffled, however many scenarios there are, and sensitivities, simulations and comparisons are the same plan over more
rows. ``by_year`` turns statements into rows (project, year, ...).

Parameters of a row: project, start_year, build_years, op_years, capex (by construction year), equity_ratio,
construction_rate, loan_rate, loan_years, subsidy, working_capital, capacity_mw, hours, capacity_price, grid_price,
pump_price, aux_rate, vat_rate, surcharge_rate, input_vat, input_vat_years, assets (name, original, residual, life),
prepaid_amount, prepaid_cycle, prepaid_period, ratios (null: 0 while building, 1 after it).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.functions import finance

#: Parameters that ``schedule`` reads.
SCHEDULED = {
    "start_year", "build_years", "op_years", "capex", "equity_ratio", "construction_rate", "loan_rate", "loan_years", "subsidy", "working_capital",
    "input_vat", "input_vat_years", "assets", "prepaid_amount", "prepaid_cycle", "prepaid_period", "ratios",
}
ASSETS = "array<struct<name:string,original:double,residual:double,life:double>>"


@dataclass(frozen=True)
class Rules:
    """What holds for all projects of a run."""

    tax_rate: float = 0.25
    loss_years: int = 5
    material_per_mw: float = 0.02
    pump_efficiency: float = 0.75
    maintenance_rate: float = 0.0083
    labour: float = 2777.5
    residual_share: float = 0.05  # of the fixed assets, recovered in the last year
    overhauls: dict[int, float] = field(default_factory=dict)  # year: amount
    equal_principal: bool = False
    wc_equity_share: float = 0.3
    statutory: float = 0.1
    statutory_limit: float = 5000.0
    discretionary: float = 0.0
    dividends: float = 0.0


def _at(name: str, i: Column) -> Column:
    return F.coalesce(F.get(F.col(name), i.cast("int")), F.lit(0.0))


def _each(f) -> Column:
    """An array with a value for each year's index."""
    return F.transform(F.col("i"), lambda i: f(i).cast("double"))


def _zipped(f, *names: str) -> Column:
    """An array with a value for each year from the values of other arrays in that year."""
    return F.transform(F.arrays_zip(*names), lambda s: f(*(F.coalesce(s[n], F.lit(0.0)) for n in names)).cast("double"))


def _settled(df: DataFrame) -> DataFrame:
    """The same rows, as a step of their own.

    Spark puts an expression that is used once where it is used; inside a walk over the years it would be computed again for
    each year, and over several steps for each year of each year. It puts none through an explode.
    """
    return df.select("*", F.explode(F.array(F.lit(0))).alias("step")).drop("step")


def _total(name: str) -> Column:
    return F.aggregate(name, F.lit(0.0), lambda a, v: a + v)


def _running(name: str) -> Column:
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0))
    return F.aggregate(name, F.array().cast("array<double>"), lambda a, v: F.array_append(a, last(a) + v))


def construction_interest(capex: Column, debt_share: Column, rate: Column) -> Column:
    """Interest of each construction year: on what was owed before, and for half a year on the new debt; capitalised yearly."""
    start = F.struct(F.lit(0.0).alias("debt"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, invested: Column) -> Column:
        new = invested * debt_share
        interest = s["debt"] * rate + new * rate * 0.5
        return F.struct((s["debt"] + new + interest).alias("debt"), F.array_append(s["out"], interest).alias("out"))

    return F.aggregate(capex, start, step, lambda s: s["out"])


def interest_by_periods(periods: Column, debt_ratio: float, rate: float) -> Column:
    """Interest of each irregular period, for periods (start, end, invested) in order: days / 365, capitalised at year ends."""
    start = F.struct(F.lit(0.0).alias("debt"), F.lit(None).cast("int").alias("year"), F.lit(0.0).alias("open"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        turn = s["year"].isNotNull() & (F.year(p["end"]) != s["year"])
        debt = F.when(turn, s["debt"] + s["open"]).otherwise(s["debt"])
        share = F.datediff(p["end"], p["start"]) / 365
        new = p["invested"] * debt_ratio
        interest = debt * rate * share + new * rate * share * 0.5
        still = F.when(turn, 0.0).otherwise(s["open"]) + new + interest
        return F.struct(debt.alias("debt"), F.year(p["end"]).alias("year"), still.alias("open"), F.array_append(s["out"], interest).alias("out"))

    return F.aggregate(periods, start, step, lambda s: s["out"])


def financing_periods(injections: DataFrame, starts: DataFrame, yearly: DataFrame, rate: float, debt_ratio: float | None = None) -> DataFrame:
    """(project, number, period_start, period_end, months, invested, equity, debt, interest): construction cut at injections.

    injections: project, number, label (``2024-06``: a period ends with that month), amount; starts: project, start; yearly:
    project, year, amount. A period begins the day after the one before; months are days over 30, half to even. A year's
    investment is split by the months of the periods that end in it, unless injections say what a period invests (invested);
    debt is that share of it, or without a ratio what equity doesn't cover, never below 0. Interest is that of irregular
    periods, capitalised at year ends.
    """
    order = Window.partitionBy("project").orderBy("number")
    end = F.last_day(F.to_date(F.concat("label", F.lit("-01"))))
    each = injections.join(starts, "project").withColumn("period_end", end)
    each = each.withColumn("period_start", F.coalesce(F.date_add(F.lag("period_end").over(order), 1), F.col("start")))
    each = each.withColumns({"months": F.bround(F.datediff("period_end", "period_start") / 30, 0).cast("int"), "year": F.year("period_end")})
    each = each.withColumn("of_year", F.sum("months").over(Window.partitionBy("project", "year")))
    invested = F.when(F.col("of_year") > 0, F.coalesce("spent", F.lit(0.0)) * F.col("months") / F.col("of_year")).otherwise(0.0)
    if "invested" not in injections.columns:
        each = each.join(yearly.select("project", "year", F.col("amount").alias("spent")), ["project", "year"], "left").withColumn("invested", invested)
    short = F.greatest(F.lit(0.0), F.col("invested") - F.col("amount"))
    each = each.withColumn("debt", short if debt_ratio is None else F.col("invested") * debt_ratio)
    # a project's periods are few; they are folded in one array
    row = F.struct("number", F.col("period_start").alias("start"), F.col("period_end").alias("end"), F.col("debt").alias("invested"), "months", F.col("invested").alias("whole"), "amount")
    folded = each.groupBy("project").agg(F.array_sort(F.collect_list(row)).alias("p"))
    interest = interest_by_periods(F.col("p"), 1.0, rate)
    out = folded.select("project", F.explode(F.arrays_zip("p", interest.alias("interest"))).alias("x"))
    p = lambda c: F.col(f"x.p.{c}")
    return out.select("project", p("number").alias("number"), p("start").alias("period_start"), p("end").alias("period_end"), p("months").alias("months"), p("whole").alias("invested"), p("amount").alias("equity"), p("invested").alias("debt"), F.col("x.interest").alias("interest"))


def price_contingency(invested: Column, rate: float) -> Column:
    """What rising prices add to each year's investment; nothing in the first year."""
    return F.transform(invested, lambda v, i: F.when(i == 0, 0.0).otherwise(v * (F.pow(F.lit(1 + rate), i + 1) - 1)))


def timeline(params: DataFrame) -> DataFrame:
    """(project, period_start, period_end, months, end_year, phase). params: project, start, end, op_start, op_end, milestones.

    Endpoints are the dates given, milestones inside the construction, every 31 December between, and the end of the first
    operating month; months are days over 30, half to even.
    """
    year_ends = lambda a, b: F.filter(F.transform(F.sequence(F.year(a), F.year(b)), lambda y: F.make_date(y, F.lit(12), F.lit(31))), lambda d: (d > a) & (d < b))
    inside = F.filter(F.coalesce("milestones", F.array().cast("array<date>")), lambda m: (m > F.col("start")) & (m < F.col("end")))
    opened = F.last_day("op_start")
    every = F.concat(F.array("start", "end", opened, "op_end"), inside, year_ends(F.col("start"), F.col("end")), year_ends(opened, F.col("op_end")))
    ends = params.withColumn("ends", F.array_sort(F.array_distinct(every)))
    pairs = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.struct(F.element_at("ends", i).alias("period_start"), F.element_at("ends", i + 1).alias("period_end")))
    rows = ends.select("project", "op_start", F.explode(pairs).alias("p")).select("project", "op_start", "p.*")
    months = F.bround(F.datediff("period_end", "period_start") / 30, 0).cast("int")
    phase = F.when(F.col("period_end") >= F.col("op_start"), "operation").otherwise("construction")
    return rows.select("project", "period_start", "period_end", months.alias("months"), F.year("period_end").alias("end_year"), phase.alias("phase"))


def schedule(configs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The configs with all that follows from SCHEDULED: investment, loan, depreciation, deducted VAT.

    Runs of one project that differ in other parameters only are exploded after this, so that it is computed once for them.
    """
    rules = rules or Rules()
    df = _settled(configs).withColumn("i", F.sequence(F.lit(0), F.col("build_years") + F.col("op_years") - 1))
    build = F.col("build_years")
    given = lambda i: F.coalesce(F.get("ratios", i.cast("int")), F.try_element_at("ratios", F.lit(-1)))
    df = _settled(df).withColumns({
        "years": F.transform("i", lambda i: F.col("start_year") + i),
        "ratio": _each(lambda i: F.coalesce(given(i), F.when(i >= build, 1.0).otherwise(0.0))),
        "invested": _each(lambda i: F.when(i < build, _at("capex", i)).otherwise(0.0)),
        "capitalised": construction_interest(F.slice("capex", F.lit(1), build), 1 - F.col("equity_ratio"), F.col("construction_rate")),
        "fixed": F.aggregate(F.filter("assets", lambda a: a["name"] == "fixed"), F.lit(0.0), lambda t, a: t + a["original"]),
        "yearly_depreciation": F.aggregate("assets", F.lit(0.0), lambda t, a: t + a["original"] * (1 - a["residual"]) / a["life"]),
    })
    df = _settled(df).withColumn("first_op", F.coalesce(F.nullif(F.array_position(F.transform("i", lambda i: (i >= build) | (_at("ratio", i) > 0)), True), F.lit(0)) - 1, build))
    df = _settled(df).withColumns({
        "invested_total": _total("invested"),
        "financed": _each(lambda i: _at("invested", i) + _at("capitalised", i)),
    })
    df = _settled(df).withColumns({
        "equity_in": _each(lambda i: _at("financed", i) * F.col("equity_ratio")),
        "debt_in": _each(lambda i: _at("financed", i) * (1 - F.col("equity_ratio"))),
    })
    df = _settled(df).withColumn("loan", _total("debt_in"))

    def loan(part: str):
        def value(i: Column) -> Column:
            k = i - build  # repayment starts a year after operation does
            f = finance.equal_principal if rules.equal_principal else finance.equal_instalment
            return F.when((k >= 1) & (k <= F.col("loan_years")), f(F.col("loan"), F.col("loan_rate"), k, F.col("loan_years"))[part]).otherwise(0.0)

        return _each(value)

    on = lambda i: i >= F.col("first_op")
    per_year = F.col("input_vat") / F.least(F.col("input_vat_years"), F.col("op_years"))
    offset = lambda i: i - build
    last = lambda i: i == F.size("i") - 1
    df = _settled(df).withColumns({
        "interest": loan("interest"),
        "principal": loan("principal_part"),
        "owed": _each(lambda i: F.when(i < build, 0.0).when(i == build, F.col("loan")).when(i - build > F.col("loan_years"), 0.0).otherwise(finance.equal_principal(F.col("loan"), F.col("loan_rate"), i - build, F.col("loan_years"))["balance"] if rules.equal_principal else finance.equal_instalment(F.col("loan"), F.col("loan_rate"), i - build, F.col("loan_years"))["balance"])),
        "prepaid": _each(lambda i: F.when((offset(i) >= 0) & (F.coalesce("prepaid_amount", F.lit(0.0)) > 0) & (F.pmod(offset(i), F.col("prepaid_cycle")) < F.col("prepaid_period")), F.col("prepaid_amount") / F.col("prepaid_period")).otherwise(0.0)),
        "vat_deducted": _each(lambda i: F.when(on(i), F.greatest(F.lit(0.0), F.least(per_year, F.col("input_vat") - per_year * (i - F.col("first_op"))))).otherwise(0.0)),
        "recovered": _each(lambda i: F.when(last(i), F.col("fixed") * rules.residual_share + F.col("working_capital")).otherwise(0.0)),
        "started": _each(lambda i: F.when(i == build, F.col("working_capital")).otherwise(0.0)),
        "invested_own": _each(lambda i: _at("invested", i) - F.col("subsidy") * F.coalesce(F.try_divide(_at("invested", i), F.col("invested_total")), F.lit(0.0))),
    })
    return _settled(df).withColumn("depreciation", _each(lambda i: F.col("yearly_depreciation") * _at("ratio", i) + _at("prepaid", i)))


def operate(scheduled: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Every statement beside what ``schedule`` gives. What doesn't change with the year is computed before the walks over the years."""
    rules = rules or Rules()
    build = F.col("build_years")
    generation = F.col("capacity_mw") * F.col("hours")
    cost = F.col("capacity_mw") * rules.material_per_mw + generation / rules.pump_efficiency * F.col("pump_price") / 10
    df = _settled(scheduled).withColumns({
        "capacity_yearly": F.col("capacity_mw") * F.col("capacity_price") / 10 / (1 + F.col("vat_rate")),
        "energy_yearly": generation * (1 - F.col("aux_rate")) * F.col("grid_price") / 10 / (1 + F.col("vat_rate")),
        "cost_building": cost + 0.0 + rules.labour,
        "cost_operating": cost + F.col("invested_total") * rules.maintenance_rate + rules.labour,
    })
    df = _settled(df).withColumns({
        "capacity_revenue": _zipped(lambda r: F.col("capacity_yearly") * r, "ratio"),
        "energy_revenue": _zipped(lambda r: F.col("energy_yearly") * r, "ratio"),
        "revenue": _zipped(lambda r: F.col("capacity_yearly") * r + F.col("energy_yearly") * r, "ratio"),
        "production_cost": _zipped(lambda r, d, i: r * F.when(i >= build, F.col("cost_operating")).otherwise(F.col("cost_building")) + d, "ratio", "depreciation", "i"),
    })
    df = _settled(df).withColumns({
        "vat_output": _zipped(lambda r: r * F.col("vat_rate"), "revenue"),
        "surcharge": _zipped(lambda r, d: F.greatest(F.lit(0.0), r * F.col("vat_rate") - d) * F.col("surcharge_rate"), "revenue", "vat_deducted"),
    })
    df = _settled(df).withColumns({
        "profit_total": _zipped(lambda r, s, c: r - s - c, "revenue", "surcharge", "production_cost"),
        "profit_equity": _zipped(lambda r, s, c, i: r - s - c - i, "revenue", "surcharge", "production_cost", "interest"),
        "running": _zipped(lambda c, d, s: c - d + s, "production_cost", "depreciation", "surcharge"),
    })
    tax = lambda name: F.transform(finance.loss_carry_forward(F.col(name), rules.tax_rate, rules.loss_years), lambda t: t["tax"])
    df = _settled(df).withColumns({"tax_total": tax("profit_total"), "tax_equity": tax("profit_equity")})
    overhaul = F.create_map(*(F.lit(x) for y, v in rules.overhauls.items() for x in (y, float(v)))) if rules.overhauls else None
    upkeep = (lambda y: F.coalesce(F.try_element_at(overhaul, y.cast("int")), F.lit(0.0))) if overhaul is not None else (lambda y: F.lit(0.0))
    return _settled(df).withColumns({
        "net_profit": _zipped(lambda p, t: p - t, "profit_equity", "tax_equity"),
        "cf_total": _zipped(lambda r, e, v, s, c, y, t: r + e - v - s - c - upkeep(y) - t, "revenue", "recovered", "invested_own", "started", "running", "years", "tax_total"),
        "cf_equity": _zipped(lambda r, e, d, q, s, c, t, p, i: r + e + d - q - s - c - t - p - i, "revenue", "recovered", "debt_in", "equity_in", "started", "running", "tax_equity", "principal", "interest"),
        "cf_operating": _zipped(lambda r, c, t: r - c - t, "revenue", "running", "tax_equity"),
        "cf_investing": _zipped(lambda e, v, q, s: e - v - q - s, "recovered", "invested", "equity_in", "started"),
        "cf_financing": _zipped(lambda d, p, i: d - p - i, "debt_in", "principal", "interest"),
    })


def run(configs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Every statement of every project, as arrays by year, beside the parameters."""
    return operate(schedule(configs, rules), rules)


def balance(model: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(project, year, total_assets, non_cash, cash, liabilities, paid_in, reserve, retained): cash balances the sheet."""
    rules = rules or Rules()
    build = F.col("build_years")
    start = F.struct(F.lit(0.0).alias("reserve"), F.lit(0.0).alias("retained"), F.array().cast("array<struct<reserve:double,retained:double>>").alias("out"))

    def step(s: Column, profit: Column) -> Column:
        gain = profit > 0
        legal = F.when(s["reserve"] + profit * rules.statutory > rules.statutory_limit, F.greatest(F.lit(0.0), rules.statutory_limit - s["reserve"])).otherwise(profit * rules.statutory)
        put = F.when(gain, legal + profit * rules.discretionary).otherwise(0.0)
        kept = F.when(gain, profit - put - F.greatest(F.lit(0.0), profit - put) * rules.dividends).otherwise(profit)
        row = F.struct((s["reserve"] + put).alias("reserve"), (s["retained"] + kept).alias("retained"))
        return F.struct(row["reserve"].alias("reserve"), row["retained"].alias("retained"), F.array_append(s["out"], row).alias("out"))

    df = _settled(model).withColumns({"equity_sum": _running("equity_in"), "debt_sum": _running("debt_in"), "prepaid_sum": _running("prepaid"), "ratio_sum": _running("ratio")})
    df = _settled(df).withColumn("items", F.aggregate(F.slice("net_profit", build + 1, F.col("op_years")), start, step, lambda s: s["out"]))
    worn = lambda i: _at("ratio_sum", i) - F.when(build > 0, _at("ratio_sum", build - 1)).otherwise(0.0)

    def assets(i: Column) -> Column:
        left = lambda a: F.greatest(a["original"] - a["original"] * (1 - a["residual"]) / a["life"] * worn(i), F.when(a["name"] == "fixed", a["original"] * a["residual"]).otherwise(0.0))
        paid = F.greatest(F.lit(0.0), (F.floor((i - build) / F.col("prepaid_cycle")) + 1) * F.coalesce("prepaid_amount", F.lit(0.0)) - _at("prepaid_sum", i))
        return F.aggregate("assets", F.lit(0.0), lambda t, a: t + left(a)) + paid + F.col("working_capital")

    df = _settled(df).withColumns({
        "non_cash": _each(lambda i: F.when(i < build, _at("equity_sum", i) + _at("debt_sum", i)).otherwise(assets(i))),
        "liabilities": _each(lambda i: F.when(i < build, _at("debt_sum", i)).otherwise(_at("owed", i) + F.col("working_capital") * (1 - rules.wc_equity_share))),
        "paid_in": _each(lambda i: F.when(i < build, _at("equity_sum", i)).otherwise(_at("equity_sum", build - 1) + F.col("working_capital") * rules.wc_equity_share)),
        "reserve": _each(lambda i: F.coalesce(F.get("items", (i - build).cast("int"))["reserve"], F.lit(0.0))),
        "retained": _each(lambda i: F.coalesce(F.get("items", (i - build).cast("int"))["retained"], F.lit(0.0))),
    })
    rows = by_year(_settled(df), ["non_cash", "liabilities", "paid_in", "reserve", "retained"])
    total = F.col("liabilities") + F.col("paid_in") + F.col("reserve") + F.col("retained")
    return rows.withColumns({"total_assets": total, "cash": total - F.col("non_cash")})


def by_year(model: DataFrame, columns: list[str]) -> DataFrame:
    """(project, year, columns): statements as rows."""
    zipped = F.arrays_zip(F.col("years").alias("year"), *(F.col(c) for c in columns))
    return model.select("project", F.explode(zipped).alias("r")).select("project", F.col("r.year").alias("year"), *(F.col(f"r.{c}").alias(c) for c in columns))


def first_turn(flows: Column) -> Column:
    """Years until the running sum turns, interpolated, to 2 decimals; 0 if it starts at 0 or more; null if it never turns."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"), F.lit(0).alias("t"))

    def step(s: Column, v: Column) -> Column:
        now = s["sum"] + v
        hit = F.when(s["at"].isNotNull(), s["at"]).when((now >= 0) & (s["t"] == 0), 0.0).when((now >= 0) & (v > 0), s["t"] - 1 + F.abs(s["sum"]) / v)
        return F.struct(now.alias("sum"), hit.alias("at"), (s["t"] + 1).alias("t"))

    return F.aggregate(flows, start, step, lambda s: F.round(s["at"], 2))


def metrics(model: DataFrame, rate: float = 0.08) -> DataFrame:
    """A row a project: irr_total, irr_equity, npv_total, npv_equity, payback, payback_dynamic, dscr_min, dscr_avg, margin."""
    days = F.transform("years", lambda y: F.datediff(F.make_date(y, F.lit(12), F.lit(31)), F.make_date(F.col("start_year"), F.lit(12), F.lit(31))))
    ratios = F.filter(F.transform("i", lambda i: F.try_divide(_at("profit_equity", i) + _at("interest", i) + _at("depreciation", i), F.nullif(F.greatest(F.lit(0.0), _at("principal", i) + _at("interest", i)), F.lit(0.0)))), lambda x: x.isNotNull())
    df = _settled(_settled(model).withColumns({"days": days, "ratios_of_debt": ratios}))
    discounted = F.transform("cf_total", lambda v, t: v / F.pow(F.lit(1 + rate), t))
    return df.select(
        "project",
        F.coalesce(finance.xirr(F.col("cf_total"), F.col("days")), finance.irr(F.col("cf_total"))).alias("irr_total"),
        F.coalesce(finance.xirr(F.col("cf_equity"), F.col("days")), finance.irr(F.col("cf_equity"))).alias("irr_equity"),
        finance.npv(F.col("cf_total"), rate).alias("npv_total"),
        finance.npv(F.col("cf_equity"), rate).alias("npv_equity"),
        first_turn(F.col("cf_total")).alias("payback"),
        first_turn(discounted).alias("payback_dynamic"),
        F.round(F.array_min("ratios_of_debt"), 4).alias("dscr_min"),
        F.round(F.aggregate("ratios_of_debt", F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size("ratios_of_debt"), F.lit(0)), 4).alias("dscr_avg"),
        F.try_divide(_total("net_profit"), _total("revenue")).alias("margin"),
    )


def perturbed(configs: DataFrame, parameters: list[str], perturbations: list[float]) -> DataFrame:
    """The configs once for each parameter and perturbation: param, perturbation, and the parameter changed by that share.

    Arrays (capex) change as a whole. Scenarios are rows, so the model's plan doesn't change.
    """
    kinds = dict(configs.dtypes)
    grid = configs.sparkSession.createDataFrame([(p, float(x)) for p in parameters for x in perturbations], "param string, perturbation double")
    each = configs.join(F.broadcast(grid), how="cross")  # a fixed grid, not rows by rows
    factor = lambda p: 1 + F.when(F.col("param") == p, F.col("perturbation")).otherwise(0.0)

    def scaled(p: str) -> Column:
        f = factor(p)
        return F.transform(p, lambda v: v * f) if kinds[p].startswith("array") else F.col(p) * f

    changed = {p: scaled(p) for p in parameters}
    return each.withColumns(changed).withColumn("project", F.concat_ws("|", F.col("project").cast("string"), "param", F.col("perturbation").cast("string")))
