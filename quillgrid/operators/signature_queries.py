"""Signatures, blocks, repairs and readable formulas over a grid of suppliers by months, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.cells import column_letters
from quillgrid.operators import signatures
from quillgrid.registry import Registry, table

registry = Registry()
query = registry.query

FIRST, LAST = 3, 44  # columns C to AR
_LETTERS = "case when {c} <= 26 then chr((64 + {c})::int) else chr((64 + ({c} - 1) // 26)::int) || chr((65 + ({c} - 1) % 26)::int) end"
#: kind 0: a constant, 1: another formula, else SUMIF. Rows start at 6; each tenth one is a row of dates.
GRID = f"""g as (select 's' || s_nationkey as sheet, cast(s_suppkey + 6 as int) as row, c::int as col, cast((s_suppkey * 7 + c) % 11 as int) as kind, {_LETTERS.format(c="c")} as col_name, {_LETTERS.format(c="(c - 1)")} as before from supplier, range({FIRST}, {LAST + 1}) r(c) where s_suppkey % 10 <> 0),
d as (select 's' || s_nationkey as sheet, cast(s_suppkey + 6 as int) as row, s_name as mark from supplier where s_suppkey % 10 = 0)"""


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_nationkey").alias("sheet"), (F.col("s_suppkey") + 6).cast("int").alias("row"), "s_suppkey", "s_name")
    is_date = F.col("s_suppkey") % 10 == 0
    cells = s.where(~is_date).withColumn("col", F.explode(F.sequence(F.lit(FIRST), F.lit(LAST)))).withColumn("kind", (F.col("s_suppkey") * 7 + F.col("col")) % 11)
    name, before, row = column_letters(F.col("col")), column_letters(F.col("col") - 1), F.col("row").cast("string")
    sumif = F.concat(F.lit("=SUMIF($B$1:$AZ$1,"), name, F.lit("$2,$B"), row, F.lit(":$AZ"), row, F.lit(')+LEN("A1")'))
    other = F.concat(F.lit("=$B"), row, F.lit("*LOG10("), before, row, F.lit(")-s1!"), name, F.lit("$4"))
    cells = cells.select("sheet", "row", "col", F.when(F.col("kind") == 0, F.col("col").cast("double")).alias("num"), F.when(F.col("kind") == 1, other).when(F.col("kind") > 1, sumif).alias("formula"))
    return cells, s.where(is_date).select("sheet", "row", F.col("s_name").alias("mark"))


@query(f"""with {GRID}, f as (select *, col - row_number() over (partition by sheet, row order by col) as run from g where kind > 1),
b as (select sheet, row, min(col) as first, max(col) as last, count(*) as n from f group by sheet, row, run having count(*) >= 3),
m as (select b.*, (select max(d.row) from d where d.sheet = b.sheet and d.row <= b.row) as date_row from b)
select m.*, d.mark, '=SUMIF(R1C2:R1C52,R2C[0],R[0]C2:R[0]C52)+LEN("A1")' as signature from m join d on d.sheet = m.sheet and d.row = m.date_row where m.row - m.date_row <= 14""")
def sumif_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of SUMIF formulas side by side, beyond column Z, each with the nearest row of dates above."""
    cells, dates = _grid(spark, sf_dir)
    return signatures.blocks(cells, dates)


@query(f"""with {GRID}, r as (select sheet, row, max(col) filter (kind > 0) as fin from g group by all),
n as (select g.*, fin, max(col) filter (kind > 0) over (partition by sheet, row order by col rows between unbounded preceding and 1 preceding) as near from g join r using (sheet, row)),
k as (select n.*, o.kind as near_kind from n join g o on o.sheet = n.sheet and o.row = n.row and o.col = n.near where n.kind = 0 and n.col < fin)
select sheet, row, col, case when near_kind = 1 then '=$B' || row || '*LOG10(' || before || row || ')-s1!' || col_name || '$4' else '=SUMIF($B$1:$AZ$1,' || col_name || '$2,$B' || row || ':$AZ' || row || ')+LEN("A1")' end as formula from k""")
def repair_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants inside rows of formulas get the formula on their left, moved to their column."""
    return signatures.repairs(_grid(spark, sf_dir)[0])


@query("""select 'S!D' || (s_suppkey + 1) as id, '=' || s_name || '*' || n_name || '-LOG10(A' || (s_suppkey + 1) || ')&"B1"+' || s_name || '/E$1' as text from supplier join nation on n_nationkey = s_nationkey""")
def formula_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of suppliers with the names of suppliers and nations in place of their cells."""
    s = table(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey + 1 as string) as k", "cast(s_nationkey + 1 as string) as n", "s_name")
    n = table(spark, sf_dir, "nation").selectExpr("concat('Na tion!C', n_nationkey + 1) as id", "n_name as name")
    formulas = s.selectExpr("concat('S!D', k) as id", """concat('=B', k, "*'Na tion'!$C", n, '-LOG10(A', k, ')&"B1"+S!$B', k, '/E$1') as formula""")
    return signatures.readable(formulas, s.selectExpr("concat('S!B', k) as id", "s_name as name").unionByName(n))
