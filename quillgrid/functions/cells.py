"""Cell-level functions as Spark expressions: dates, labels, column letters, DATEDIF, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header words of column roles in their order of priority.
ROLES = [
    ("category", "类别|分类|大类"),
    ("sequence", "序号|编号|序"),
    ("name", "项目|名称|参数|指标|科目"),
    ("total", "合计|小计|汇总|总计|总额"),
    ("unit", "单位|万元|元|亿元|%|MW|kW|h|年|月|个"),
    ("notes", "备注|说明|注|取值说明|参数释义"),
]


def serial_date(serial: Column) -> Column:
    """A spreadsheet's day number as a date; day 0 is 1899-12-30."""
    return F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))


def is_date_serial(v: Column) -> Column:
    return (v >= 36526) & (v <= 73050) & (v == F.floor(v))


def column_number(letters: Column) -> Column:
    """A = 1, Z = 26, AA = 27."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * 26 + F.ascii(c) - 64).cast("int"))


def column_letters(number: Column) -> Column:
    """The reverse, for up to four letters."""
    out, n = F.lit(""), number.cast("int")
    for _ in range(4):
        letter = F.char(F.lit(65) + F.pmod(n - 1, F.lit(26)))
        out = F.when(n > 0, F.concat(letter, out)).otherwise(out)
        n = F.floor((n - 1) / 26).cast("int")
    return out


def datedif(a: Column, b: Column, unit: str) -> Column:
    """Whole days, months or years between dates, or days after whole months or years; null if a is after b."""
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")
    years = F.floor(months / 12).cast("int")
    kinds = {
        "D": F.datediff(b, a),
        "M": months,
        "Y": years,
        "MD": F.datediff(b, F.add_months(a, months)),
        "YM": F.pmod(months, F.lit(12)),
        "YD": F.datediff(b, F.add_months(a, years * 12)),
    }
    return F.when(a <= b, kinds[unit.upper()].cast("int"))


def year_label(label: Column) -> Column:
    """The year in a label: a date serial, four digits, or two digits with pivot 70 before a year sign; else null."""
    number = label.try_cast("double")
    four = F.regexp_extract(label, r"((?:19|20)\d{2})", 1)
    two = F.regexp_extract(label, r"(?<!\d)(\d{2})\s*[年'y]", 1).try_cast("int")
    return (
        F.when(is_date_serial(number), F.year(serial_date(number)))
        .when(four != "", four.try_cast("int"))
        .when(two.isNotNull(), F.when(two < 70, 2000 + two).otherwise(1900 + two))
    )


def role_of(label: Column, roles: list[tuple[str, str]] = ROLES) -> Column:
    """Role of a column by its header; null if no word fits. Units are held as they are written."""
    out = F.lit(None).cast("string")
    for role, pattern in reversed(roles):
        out = F.when(label.rlike(pattern), F.lit(role)).otherwise(out)
    return out


def references(formula: Column) -> Column:
    """Distinct cell and range references of a formula, without text literals and dollar signs."""
    bare = F.regexp_replace(F.regexp_replace(formula, r'"[^"]*"', ""), r"\$", "")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"((?:'[^']+'!|[A-Za-z0-9_\p{L}]+!)?[A-Z]{1,3}[0-9]{1,7}(?::[A-Z]{1,3}[0-9]{1,7})?)(?![A-Za-z0-9_(])"), F.lit(1)))
