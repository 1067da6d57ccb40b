"""Benchmark decontamination by template windows and slot consistency; DataFrame functions only.

Canonical form: lower-case words without punctuation, in which numbers, units after a number, and names (capitalised
words, several in a row are one; not the ``STARTERS`` that open sentences) are typed placeholders. Windows of ``WINDOW`` canonical words are
hashed. Windows of the benchmark that hold enough literal words are joined by hash with all windows of all documents. A
document matches an item on a diagonal (its position minus the item's) where it holds a good part of the item's windows:
so re-parameterised passages are found. In a re-parameterised one each slot value of
the item must stand for one value of the document wherever it occurs; a diagonal whose slots disagree is no match.

Verbatim: windows of the plain words, nothing replaced, are joined in the same way, so that items of numbers and names are
found too. A document holds an item verbatim where it holds a good part of these windows, or ``RUN`` words on one diagonal.

The benchmark's window tables are broadcast while they have at most ``BROADCAST_ROWS`` rows. Beyond that, windows of the
documents are first held against a bounded, broadcast bit map of the benchmark's hashes, and what is left is joined by
shuffle. Texts are read again, for slots, only from documents whose id falls in a used slot of a bounded table of ids.

Defined cases: null and empty texts match nothing; items with fewer than ``LEAST`` words take no part, other items
shorter than a window are one window; items with one text are compared once; rows with one id are judged together; null ids match nothing;
an empty benchmark or table matches nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import Scratch, only_ids, table

WINDOW = 8
LEAST = 4  # words of an item, and literal words of a window
RUN = 50  # words on a diagonal, whatever their share of the item
COVER = 0.25  # of the item's windows
AGREE = 0.8  # of the slot values that the item repeats
BROADCAST_ROWS = 200_000
MAP_WORDS = 1 << 18  # of 64 bits: 16.8 million slots

# Units that follow a number.
UNITS = (
    "km kilometers kilometres kilometer kilometre m meters metres meter metre cm mm miles mile feet foot ft inches inch "
    "yards yard kg kilograms kilogram g grams gram mg tons ton tonnes lb lbs pounds pound ounces ounce oz l liters litres "
    "liter litre ml gallons gallon hours hour h hrs minutes minute min seconds second s days day weeks week months month "
    "years year dollars dollar cents cent euros euro percent degrees degree kmh mph points point"
).split()
# Capitalised words that open a sentence and are no names.
STARTERS = (
    "A About After All Although An And Another Any As At Because Before Below But By Calculate Can Choose Complete Compute "
    "Consider Could Describe Determine Do Does During Each Either Estimate Evaluate Every Explain Express Find First For "
    "From Given Has Have He Her His How However I If In Into Is It Its Let Many Most Name Now Of On Once One Or Our Please "
    "Prove She Should Show Simplify Since So Solve Some State Suppose Ten That The Their Then There These They This Those "
    "Three Thus To Today Two Under Until Use Using We What When Where Whether Which While Who Whose Why Will With Within "
    "Without Would Write You Your"
).split()
NUMBER, UNIT, NAME = "0n", "0u", "0c"
PLACEHOLDERS = [NUMBER, UNIT, NAME]
# groups that repeat are possessive: others are matched recursively, and a long run of them overflows a task's stack
_NUMBER = r"(?<![\p{L}\p{N}])[+-]?[$€£]?\p{Nd}++(?:[.,:/]\p{Nd}++)*+"
_UNIT = rf"(?<= {NUMBER} )\s*(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])|(?<= {NUMBER} )\s*[%°]"
_BY_LETTER = {c: "|".join(w[1:] for w in STARTERS if w[0] == c) for c in {w[0] for w in STARTERS}}
_STARTER = "|".join(f"{c}(?:{rest})" for c, rest in sorted(_BY_LETTER.items()))
_WORD = rf"(?!(?:{_STARTER})(?![\p{{L}}'’-]))\p{{Lu}}[\p{{L}}'’-]*+"
# the first look ahead lets most places fail at once
_NAME = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}'’-]){_WORD}(?:\s{_WORD})*+"


def canonical(text: Column) -> Column:
    """The canonical words of a text. Placeholders start with a digit, which no word does once numbers are replaced."""
    text = F.coalesce(text, F.lit(""))
    numbers = F.regexp_replace(F.regexp_replace(text, _NUMBER, f" {NUMBER} "), _UNIT, f" {UNIT} ")
    text = F.when(text.rlike(r"\p{Nd}"), numbers).otherwise(text)
    text = F.lower(F.regexp_replace(text, _NAME, f" {NAME} "))
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def plain(text: Column) -> Column:
    """The words of a text in lower case, nothing replaced."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def slot_values(text: Column) -> list[Column]:
    """The replaced values in order: numbers, units, names, as canonical() meets them."""
    text = F.coalesce(text, F.lit(""))
    numbers = F.regexp_replace(text, _NUMBER, f" {NUMBER} ")
    units = F.regexp_replace(numbers, _UNIT, f" {UNIT} ")
    found = [F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), F.regexp_extract_all(numbers, F.lit(_UNIT), F.lit(0)), F.regexp_extract_all(units, F.lit(_NAME), F.lit(0))]
    return [F.transform(a, lambda v: F.trim(F.lower(v))) for a in found]


def _windows(words: Column, size: int) -> Column:
    """(position, hash) of each window; words are hashed once."""
    n = F.size(words) - F.lit(size - 1)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    # fields of one struct, so that the array of hashed words is made once a row
    both = F.struct(hashed.alias("h"), at.alias("at"))
    return F.transform(F.array(both), lambda b: F.transform(b["at"], lambda i: F.xxhash64(F.slice(b["h"], i, size))))[0]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) for each document that holds an item, verbatim or with other parameters."""
    scratch = Scratch(docs.sparkSession)
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    items = scratch.keep(named.groupBy("text").agg(F.collect_set("item_id").alias("item_ids")).withColumn("item", F.monotonically_increasing_id()))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    found = _texts(scratch, docs, items.select("item", "text"))
    ids = items.select("item", F.explode("item_ids").alias("item_id"))
    return scratch.keep(found.join(ids, "item").select("doc_id", "item_id").distinct())


def _texts(scratch: Scratch, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item) of what matches; items: item, text."""
    verbatim, raw = None, _hits(scratch, docs, items, plain, typed=False)
    if raw is not None:
        whole = raw.groupBy("doc_id", "item", "of", "least").agg(F.count_distinct("item_at").alias("windows")).where(F.col("windows") >= _enough())
        runs = raw.groupBy("doc_id", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.count_distinct("item_at").alias("windows"))
        runs = runs.where(F.col("windows") > RUN - WINDOW)
        verbatim = scratch.keep(whole.select("doc_id", "item").unionByName(runs.select("doc_id", "item")).distinct())
    hits = _hits(scratch, docs, items, canonical, typed=True)
    if hits is None:
        return verbatim if verbatim is not None else docs.sparkSession.createDataFrame([], "doc_id long, item long")
    lines = hits.groupBy("doc_id", "item", "of", "least", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(
        F.count_distinct("item_at").alias("windows"), F.sum("slots").alias("slots"), F.min("item_at").alias("first"), F.max(F.col("item_at") + F.col("wide")).alias("end")
    )
    # a word more or less shifts the diagonal, so windows without slots count together; slots are held to one diagonal
    fixed = hits.where("slots = 0").groupBy("doc_id", "item", "of", "least").agg(F.count_distinct("item_at").alias("windows")).where(F.col("windows") >= _enough())
    fixed = fixed.select("doc_id", "item")
    sure = fixed if verbatim is None else verbatim.unionByName(fixed).distinct()
    slotted = scratch.keep(lines.where((F.col("windows") >= _enough()) & (F.col("slots") > 0)).join(sure, ["doc_id", "item"], "left_anti"))
    return sure.unionByName(_consistent(docs, items, slotted)).distinct()


def _enough() -> Column:
    """The windows that a match needs: a share of those that take part, and two where the item has two or more."""
    return F.greatest(F.col("least"), F.ceil(F.col("of") * COVER))


def _hits(scratch: Scratch, docs: DataFrame, items: DataFrame, words_of, typed: bool) -> DataFrame | None:
    """(doc_id, item, wide, of, least, item_at, at, slots) of equal windows; typed: windows need literal words. None without items."""
    items = items.withColumn("words", words_of(F.col("text"))).where(F.size("words") >= LEAST)
    items = scratch.keep(items.withColumn("wide", F.least(F.size("words"), F.lit(WINDOW))))
    sizes = sorted(r["wide"] for r in items.select("wide").distinct().collect())  # at most WINDOW values
    if not sizes:
        return None
    windows = None
    for size in sizes:
        own = items.where(F.col("wide") == size)
        own = own.select("item", "words", F.least(F.size("words") - (size - 1), F.lit(2)).alias("least"), F.lit(size).alias("wide"), F.posexplode(_windows(F.col("words"), size)).alias("item_at", "hash"))
        own = own.withColumn("slots", F.lit(0))
        if typed:
            literal = F.filter(F.slice("words", F.col("item_at") + 1, size), lambda w: ~w.isin(PLACEHOLDERS))
            own = own.withColumn("slots", F.lit(size) - F.size(literal)).where(F.size(literal) >= min(size, LEAST))
        own = own.drop("words")
        windows = own if windows is None else windows.unionByName(own)
    windows = windows.join(windows.groupBy("item").agg(F.count("*").alias("of")), "item")
    windows = scratch.keep(windows)
    small = windows.count() <= BROADCAST_ROWS
    # several items can hold one window: what a hash stands for is unpacked after the join
    each = F.struct("item", "of", "least", "item_at", "slots")
    keyed = scratch.keep(windows.groupBy("wide", "hash").agg(F.collect_list(each).alias("held")))
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    found = None
    for s in sizes:
        e = rows.select("doc_id", F.lit(s).alias("wide"), F.posexplode(_windows(F.col("words"), s)).alias("at", "hash"))
        if not small:
            e = _maybe_in(e, keyed.where(F.col("wide") == s))
        hit = e.join(F.broadcast(keyed) if small else keyed, ["wide", "hash"])
        found = hit if found is None else found.unionByName(hit)
    return scratch.keep(found.select("doc_id", "wide", "at", F.inline("held")))


def _maybe_in(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """The rows whose hash can be in keyed: a bit map of slots, ``MAP_WORDS`` broadcast rows of 64 bits at most."""
    slot = lambda: F.pmod(F.xxhash64("hash"), F.lit(MAP_WORDS * 64))
    bit = lambda: F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = keyed.select(slot().alias("slot")).distinct().groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit()).alias("bits"))
    rows = rows.withColumn("slot", slot()).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(words), "word")
    return rows.where(F.col("bits").bitwiseAND(bit()) != 0).drop("slot", "word", "bits")


def _consistent(docs: DataFrame, items: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, item) of the diagonals on which each slot value of the item stands for one value of the document."""
    texts = only_ids(docs, lines.select("doc_id").distinct())
    side = lambda prefix, df, key: df.select(key, *(c.alias(f"{prefix}{n}") for n, c in zip(["words", *PLACEHOLDERS], [canonical(F.col("text")), *slot_values(F.col("text"))], strict=True)))
    both = lines.join(side("d_", texts, "doc_id"), "doc_id").join(side("i_", items.select("item", "text"), "item"), "item")
    each = both.withColumn("at", F.explode(F.sequence(F.col("first"), F.col("end") - 1)))
    each = each.withColumns({"kind": F.get("i_words", F.col("at")), "doc_at": F.col("at") + F.col("diagonal")})
    each = each.where(F.col("kind").isin(PLACEHOLDERS) & (F.get("d_words", F.col("doc_at")) == F.col("kind")))

    def value(prefix: str, at: str) -> Column:
        ordinal = F.size(F.filter(F.slice(f"{prefix}words", F.lit(1), F.col(at) + 1), lambda w: w == F.col("kind"))) - 1
        out = F.lit(None).cast("string")
        for p in PLACEHOLDERS:
            out = F.when(F.col("kind") == p, F.get(f"{prefix}{p}", ordinal)).otherwise(out)
        return out

    key = ["doc_id", "item", "diagonal"]
    pairs = each.select(*key, "kind", value("i_", "at").alias("of_item"), value("d_", "doc_at").alias("of_doc"))
    values = pairs.groupBy(*key, "kind", "of_item").agg(F.count_distinct("of_doc").alias("kinds"), F.count("*").alias("n"))
    # only a value that the item repeats can disagree
    good = values.groupBy(*key).agg(F.coalesce(F.avg(F.when(F.col("n") > 1, (F.col("kinds") == 1).cast("double"))), F.lit(1.0)).alias("agree")).where(F.col("agree") >= AGREE)
    return good.select("doc_id", "item")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds."""
    docs = table(spark, sf_dir, "documents")
    found = matches(docs, table(spark, sf_dir, "benchmark"))
    items = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = docs.select("doc_id").join(items, "doc_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<bigint>")))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").alias("n_items"), F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("item_ids"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE_SQL: dict[str, str] = {}
