"""Repair of conversation structure: which turns stay, so that roles read ``(s?(ua)+)?`` at the least cost.

Edits: Keep a turn (0), Rerole it to user or assistant (1), Delete it (2; a must for blank and repeated turns), Insert an empty
user or assistant turn anywhere (5). A truncated turn that stays costs 5 more. Of the cheapest repairs the one whose audit
(initials of its edits in order) is least in ASCII counts.

Method: a dynamic program over the turns that stay. The cost of the turns deleted between two of them is a difference of prefix
sums, so a running minimum for each state (role of the last turn that stays) prices every gap at once; the pair of roles around
a gap says which turns must be inserted into it; audits break ties. No audit of a whole prefix is the beginning of another
one of equal cost, so the least stays the least whatever follows.

Long conversations: rows are sorted by range of (conversation, turn), not dealt by conversation, and cut into blocks of ``BLOCK``
rows. A block's costs from each state to each state are 16 numbers and their ranks; these slim rows are folded in order, which
tells every block where it starts and ends; then each block writes its own part. Only the parts of one conversation are hashed
in order, as a stream. Equal rows are one row with a count before anything is sorted.

Defined cases: a null role or text is one space (so a null text is blank), as is a null conversation or turn in the key of
``damage``; a null conversation is one like others; null turns come first; rows of one turn are ordered by role, then text;
repeated rows count each and all but the first are duplicates; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import Scratch, small_batches, table

BLOCK = 512  # rows of a block at most
BLOCK_CHARS = 1 << 20  # and characters, unless one row has more
WHITE = " \t\n\x0b\x0c\r"
STATES = "0sua"  # role of the last turn that stays; 0: none has stayed yet
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Turns that must stand between a state and the next turn that stays (None: it can't follow), and at the end.
BETWEEN = {
    "0": {"s": "", "u": "", "a": "u", "end": ""},
    "s": {"s": None, "u": "", "a": "u", "end": "ua"},
    "u": {"s": None, "u": "a", "a": "", "end": "a"},
    "a": {"s": None, "u": "", "a": "u", "end": ""},
}
ROLES = {"u": "user", "a": "assistant"}


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows damaged by crc32 of ``conv_id:turn`` modulo 20, equal ones counted.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    rows = rows.withColumn("hit", F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("hit") == 3, 2).otherwise(1).alias("n"))
    return counted(rows)


def counted(rows: DataFrame) -> DataFrame:
    """Equal rows of (conv_id, turn, role, text, n) as one."""
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n"))


def marked(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Counted rows with fault: blank, duplicate (as said in an earlier turn), truncated or null."""
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    rows = scratch.keep(rows.withColumn("said", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    # the first turn of each saying; its rows are met again by a key of their own, so a saying that is everywhere is no hot key
    first = rows.groupBy("conv_id", "said").agg(F.min(place).alias("p")).select("conv_id", "said", F.col("p.turn").alias("turn"), F.lit(True).alias("first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv_id", "turn", "said")]
    rows = rows.alias("r").join(first.alias("f"), same, "left").select("r.conv_id", "r.turn", "r.role", "r.text", "r.n", F.coalesce("f.first", F.lit(False)).alias("first"))
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    fault = F.when(last == "", "blank").when(~F.col("first"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def steps(rows: list[tuple], entry: str) -> dict[str, tuple[int, str]]:
    """Cheapest (cost, audit) from a state before the rows to each state after them.

    rows: (role, n, fault). Turns to be inserted into a gap are written before the turn that ends it.
    """
    gone = done = 0  # prefix sums: cost of deleting all rows so far, and their number
    best = {entry: (0, "", 0)}  # state: cost less the deletion sum, audit up to its last row, number of rows up to it
    for role, n, fault in rows:
        if fault not in ("blank", "duplicate"):
            after = {}
            for state, (value, audit, at) in best.items():
                audit += "D" * (done - at)
                for to in "sua":
                    between = BETWEEN[state][to]
                    if between is None or (to == "s" and role[:1] != "s"):
                        continue
                    keep = role[:1] == to
                    cost = value + gone + INSERT * len(between) + (0 if keep else REROLE) + (TRUNCATED if fault == "truncated" else 0)
                    found = (cost, audit + "I" * len(between) + ("K" if keep else "R"))
                    if to not in after or found < after[to]:
                        after[to] = found
            first = {to: (cost - gone - DELETE, audit, done + 1) for to, (cost, audit) in after.items()}
            for to, found in first.items():
                old = best.get(to)
                if old is None or (found[0], found[1]) < (old[0], old[1] + "D" * (done + 1 - old[2])):
                    best[to] = found
        gone += DELETE * n
        done += n
    return {state: (value + gone, audit + "D" * (done - at)) for state, (value, audit, at) in best.items()}


def written(rows: list[tuple], entry: str, audit: str, tail: str) -> Iterator[str]:
    """The turns ``role:text`` that an audit leaves of the rows (role, text, n); tail: roles inserted after the last row."""
    state, at = entry, 0
    for role, text, n in rows:
        for _ in range(n):
            added = ""
            while audit[at] == "I":
                added += "I"
                at += 1
            if audit[at] != "D":
                to = next(t for t in "sua" if BETWEEN[state][t] is not None and len(BETWEEN[state][t]) == len(added) and (audit[at] == "R" and t != "s" or audit[at] == "K" and role[:1] == t))
                yield from (ROLES[x] + ":" for x in BETWEEN[state][to])
                yield f"{role if audit[at] == 'K' else ROLES[to]}:{text}"
                state = to
            at += 1
    yield from (ROLES[x] + ":" for x in tail)


PART = pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())])
TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64())])
BLOCKS = {"conv_id": pa.int64(), "seq": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "first": pa.string(), "last": pa.string(), "low": pa.int64(), "high": pa.int64(), "turns": pa.int64(), "parts": pa.list_(PART), "rows": pa.list_(TURN)}
BLOCK_DDL = "conv_id long, seq long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, parts array<struct<entry:string,exit:string,cost:bigint,rank:int,audit:string>>, rows array<struct<role:string,text:string,n:bigint>>"
LEGAL = ("su", "ua", "au")


def _block(conv, seq: int, rows: list[tuple]) -> tuple:
    """One row for a block; rows: (turn, role, text, n, fault)."""
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, _, n, fault in rows:
        if fault in ("blank", "duplicate"):
            count[fault] += n
        else:
            count["duplicate"] += n - 1
            count["truncated"] += fault == "truncated"
    illegal = sum((n - 1) * (r[:1] * 2 not in LEGAL) for _, r, _, n, _ in rows) + sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    turns = [t for t, *_ in rows if t is not None]
    priced = [(r, n, fault) for _, r, _, n, fault in rows]
    parts = [{"entry": e, "exit": x, "cost": c, "audit": audit} for e in STATES for x, (c, audit) in steps(priced, e).items()]
    order = {a: i for i, a in enumerate(sorted({p["audit"] for p in parts}))}
    for p in parts:
        p["rank"] = order[p["audit"]]
    kept = [{"role": r, "text": t, "n": n} for _, r, t, n, _ in rows]
    return (conv, seq, *count.values(), illegal, rows[0][1][:1], rows[-1][1][:1], min(turns, default=None), max(turns, default=None), len(set(turns)), parts, kept)


def _emit(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], list(types))


def _blocks(most: int):
    """Sorted rows to blocks of at most so many, numbered by partition and place; a block holds rows of one conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 40
        conv, held, chars = None, [], 0
        for batch in batches:
            out = []
            for c, *row in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "n", "fault")), strict=True):
                size = len(row[1]) + len(row[2])
                if held and (c != conv or len(held) >= most or chars + size > BLOCK_CHARS):
                    out.append(_block(conv, seq, held))
                    seq, held, chars = seq + 1, [], 0
                conv, chars = c, chars + size
                held.append(tuple(row))
            if out:
                yield _emit(out, BLOCKS)
        if held:
            yield _emit([_block(conv, seq, held)], BLOCKS)

    return run


PATHS = {"conv_id": pa.int64(), "seq": pa.int64(), "entry": pa.string(), "exit": pa.string(), "tail": pa.string(), "ends": pa.bool_(), "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64()}
PATH_DDL = "conv_id long, seq long, entry string, exit string, tail string, ends boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


class _Fold:
    """The blocks of one conversation in order: costs of the states, their audits' order, and where each came from."""

    def __init__(self, conv):
        self.conv, self.cost, self.rank, self.back, self.seqs = conv, {"0": 0}, {"0": 0}, [], []
        self.sums, self.illegal, self.last, self.low, self.high, self.turns = [0, 0, 0], 0, None, None, None, 0

    def add(self, b: dict) -> None:
        found: dict[str, tuple] = {}
        for p in b["parts"]:
            if p["entry"] in self.cost:
                option = (self.cost[p["entry"]] + p["cost"], self.rank[p["entry"]], p["rank"], p["entry"])
                if p["exit"] not in found or option < found[p["exit"]]:
                    found[p["exit"]] = option
        audits = sorted({o[1:3] for o in found.values()})
        self.cost = {x: o[0] for x, o in found.items()}
        self.rank = {x: audits.index(o[1:3]) for x, o in found.items()}
        self.back.append({x: o[3] for x, o in found.items()})
        self.seqs.append(b["seq"])
        self.sums = [a + b[k] for a, k in zip(self.sums, ("blank", "duplicate", "truncated"), strict=True)]
        self.illegal += b["illegal"] + (self.last is not None and self.last + b["first"] not in LEGAL)
        self.last = b["last"]
        if b["low"] is not None:
            self.turns += b["turns"] - (b["low"] == self.high)  # rows are sorted by turn: only the next block can share one
            self.low, self.high = b["low"] if self.low is None else self.low, b["high"]

    def rows(self) -> Iterator[tuple]:
        """A row for each block, last first; the inserts at the end come last in an audit, so ranks decide ties before them."""
        tails = {x: BETWEEN[x]["end"] for x in self.cost}
        state = min(self.cost, key=lambda x: (self.cost[x] + INSERT * len(tails[x]), self.rank[x]))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        stats = (gaps, *self.sums, self.illegal, self.cost[state] + INSERT * len(tails[state]))
        tail = tails[state]
        for seq, back in zip(reversed(self.seqs), reversed(self.back), strict=True):
            yield (self.conv, seq, back[state], state, tail, seq == self.seqs[-1], *(stats if seq == self.seqs[-1] else (None,) * 6))
            state, tail = back[state], ""


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold = None
    for batch in batches:
        out = []
        for b in batch.to_pylist():
            if fold is not None and fold.conv != b["conv_id"]:
                out += fold.rows()
                fold = None
            fold = fold or _Fold(b["conv_id"])
            fold.add(b)
        if out:
            yield _emit(out, PATHS)
    if fold is not None:
        yield _emit(list(fold.rows()), PATHS)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's part of the audit and of the repaired conversation."""
    types = {k: PATHS[k] for k in ("conv_id", "seq", "ends", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": pa.string(), "turns": pa.list_(pa.string())}
    for batch in batches:
        out = []
        for b in batch.to_pylist():
            audit = next(p["audit"] for p in b["parts"] if (p["entry"], p["exit"]) == (b["entry"], b["exit"]))
            turns = list(written([(r["role"], r["text"], r["n"]) for r in b["rows"]], b["entry"], audit, b["tail"]))
            out.append((*(b[k] for k in list(types)[:-2]), audit + "I" * len(b["tail"]), turns))
        yield _emit(out, types)


def _joined(with_turns: bool):
    """Parts in order to one row a conversation: the digest is taken as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, digest, turns, started = [], hashlib.sha256(), [], False
        types = {k: PATHS[k] for k in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": pa.string(), "repaired_sha256": pa.string()}
        if with_turns:
            types["turns"] = pa.list_(pa.string())
        for batch in batches:
            out = []
            for b in batch.to_pylist():
                audit.append(b["audit"])
                for turn in b["turns"]:
                    digest.update((("\n" if started else "") + turn).encode())
                    started = True
                if with_turns:
                    turns += b["turns"]
                if b["ends"]:
                    out.append((*(b[k] for k in list(types)[:7]), "".join(audit), digest.hexdigest(), *([turns] if with_turns else [])))
                    audit, digest, turns, started = [], hashlib.sha256(), [], False
            if out:
                yield _emit(out, types)

    return run


def repair(rows: DataFrame, with_turns: bool = False, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of rows.

    rows: conv_id, turn, role, text, n (how often the row stands), none equal to another. ``with_turns`` adds the repaired turns
    as ``role:text``.
    """
    spark = rows.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    known = scratch.keep(marked(scratch, rows))
    order = ["conv_id", "turn", "role", "text"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = known.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks(block), BLOCK_DDL)
    blocks = scratch.keep(blocks)
    slim = blocks.drop("rows").withColumn("parts", F.transform("parts", lambda p: p.dropFields("audit")))
    paths = slim.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_paths, PATH_DDL)
    paths = scratch.keep(paths).withColumnRenamed("conv_id", "of")
    done = blocks.select("conv_id", "seq", "parts", "rows").join(paths.drop("of"), "seq")
    ddl = "conv_id long, seq long, ends boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<string>"
    done = done.mapInArrow(_parts, ddl).repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    out = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return done.mapInArrow(_joined(with_turns), out + (", turns array<string>" if with_turns else ""))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired; one that lost all its rows has zeros and the digest of no text."""
    said = table(spark, sf_dir, "conversations")
    done = repair(damage(said)).withColumnRenamed("conv_id", "of")
    every = said.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLE_SQL: dict[str, str] = {}
