"""Formulas by what they say from where they stand: relative signatures, blocks of equal ones, repairs, readable formulas.

A formula is cut into references and all else by one pattern; a reference becomes an offset from the formula's own cell, so
copies of one formula have one signature wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillgrid.functions.cells import column_letters, column_number
from quillgrid.operators.structure import nearest_above

LETTERS = r"\p{L}\p{N}_."
REFERENCE = rf"(?<![{LETTERS}$])\$?[A-Za-z]{{1,3}}\$?[1-9][0-9]{{0,6}}(?![{LETTERS}(!])"
#: Text literals, quoted sheets, references, and single characters of the rest.
PART = rf"(\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'|{REFERENCE}|(?s).)"
WHOLE = r"^\$?[A-Za-z]{1,3}\$?[1-9][0-9]{0,6}$"
LAST_COLUMN, LAST_ROW = 16384, 1048576


def parts(formula: Column) -> Column:
    return F.regexp_extract_all(formula, F.lit(PART), F.lit(1))


def _over_references(formula: Column, change) -> Column:
    """The formula with each reference replaced by change(column, column is fixed, row, row is fixed)."""
    of = lambda p, g: F.regexp_extract(p, r"^(\$?)([A-Za-z]+)(\$?)([0-9]+)$", g)
    one = lambda p: F.when(p.rlike(WHOLE), change(column_number(of(p, 2)), of(p, 1) == "$", of(p, 4).try_cast("int"), of(p, 3) == "$")).otherwise(p)
    return F.array_join(F.transform(parts(formula), one), "")


def signature(formula: Column, row: Column, col: Column) -> Column:
    """``=A1*$B$2`` in C1 is ``=R[0]C[-2]*R2C2``: equal for every copy of a formula."""
    offset = lambda at, fixed, own: F.when(fixed, at.cast("string")).otherwise(F.concat(F.lit("["), (at - own).cast("string"), F.lit("]")))
    return _over_references(formula, lambda c, c_fixed, r, r_fixed: F.concat(F.lit("R"), offset(r, r_fixed, row), F.lit("C"), offset(c, c_fixed, col)))


def moved(formula: Column, rows: Column, cols: Column) -> Column:
    """A formula as its copy so many rows down and columns right says it; a reference that leaves the sheet is ``#REF!``."""

    def change(c, c_fixed, r, r_fixed):
        to_c, to_r = F.when(c_fixed, c).otherwise(c + cols), F.when(r_fixed, r).otherwise(r + rows)
        inside = (to_c >= 1) & (to_c <= LAST_COLUMN) & (to_r >= 1) & (to_r <= LAST_ROW)
        said = F.concat(F.when(c_fixed, "$").otherwise(""), column_letters(to_c), F.when(r_fixed, "$").otherwise(""), to_r.cast("string"))
        return F.when(inside, said).otherwise("#REF!")

    return _over_references(formula, change)


def runs(cells: DataFrame) -> DataFrame:
    """(sheet, row, first, last, n, signature, formula): formulas of one signature side by side in a row, formula of the first.

    cells: sheet, row, col, formula.
    """
    order = Window.partitionBy("sheet", "row").orderBy("col")
    some = cells.where("formula is not null").withColumn("signature", signature(F.col("formula"), F.col("row"), F.col("col")))
    new = (F.col("col") - F.lag("col").over(order) != 1) | (F.col("signature") != F.lag("signature").over(order))
    some = some.withColumn("run", F.sum(F.coalesce(new.cast("int"), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return some.groupBy("sheet", "row", "run").agg(F.min("col").alias("first"), F.max("col").alias("last"), F.count("*").alias("n"), F.first("signature").alias("signature"), F.min_by("formula", "col").alias("formula")).drop("run")


def blocks(cells: DataFrame, dates: DataFrame, call: str = "SUMIF", least: int = 3, reach: int = 14) -> DataFrame:
    """Runs of at least so many formulas that call a function, with the nearest row of dates above.

    dates: sheet, row, mark (whatever names the row of dates).
    """
    some = runs(cells.where(F.upper("formula").contains(call + "("))).where(F.col("n") >= least)
    marked = nearest_above(some, dates, ["sheet"], "row", reach)
    return marked.where("mark is not null").select("sheet", "row", "first", "last", "n", "signature", F.col("mark_at").alias("date_row"), "mark")


def repairs(cells: DataFrame) -> DataFrame:
    """(sheet, row, col, formula): for a constant right of a formula and left of another, the nearest formula on its left, moved.

    cells: sheet, row, col, num, formula.
    """
    row = Window.partitionBy("sheet", "row")
    before = row.orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    is_formula = F.col("formula").isNotNull()
    near = F.last(F.when(is_formula, F.struct("col", "formula")), ignorenulls=True).over(before)
    some = cells.withColumns({"near": near, "end": F.max(F.when(is_formula, F.col("col"))).over(row)})
    some = some.where(F.col("formula").isNull() & F.col("num").isNotNull() & F.col("near").isNotNull() & (F.col("col") < F.col("end")))
    return some.select("sheet", "row", "col", moved(F.col("near.formula"), F.lit(0), F.col("col") - F.col("near.col")).alias("formula"))


def readable(formulas: DataFrame, names: DataFrame) -> DataFrame:
    """(id, text): formulas with the names of line items in place of the cells that hold them.

    formulas: id (``Sheet!B2``), formula; names: id, name. Tokens are exploded with their place, names joined by cell, and the
    text is put together in order; a reference without a name stays as it is written.
    """
    token = rf"(\"(?:[^\"]|\"\")*\"|(?:'(?:[^']|'')+'!|(?<![{LETTERS}])[\p{{L}}_][{LETTERS}]*!)?{REFERENCE.replace('$]', '$]', 1)}|'(?:[^']|'')*'|(?s).)"
    each = formulas.select("id", F.regexp_extract("id", r"^(.*)![^!]*$", 1).alias("own"), F.posexplode(F.regexp_extract_all("formula", F.lit(token), F.lit(1))).alias("at", "token"))
    is_ref = F.col("token").rlike(r"^(?:.*!)?\$?[A-Za-z]{1,3}\$?[1-9][0-9]{0,6}$")
    sheet = F.when(F.col("token").contains("!"), F.replace(F.regexp_replace(F.regexp_extract("token", r"^(.*)!", 1), "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(F.col("own"))
    address = F.upper(F.replace(F.regexp_extract("token", r"([^!]+)$", 1), F.lit("$"), F.lit("")))
    each = each.withColumn("cell", F.when(is_ref, F.concat(sheet, F.lit("!"), address)))
    said = each.join(names.select(F.col("id").alias("cell"), "name"), "cell", "left")
    text = F.array_sort(F.collect_list(F.struct("at", F.coalesce("name", "token").alias("said"))))
    return said.groupBy("id").agg(F.array_join(F.transform(text, lambda x: x["said"]), "").alias("text"))
