"""Conversation repair against a search over single edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from quillgrid.llm import repair

NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(hit, 1)
    return out


def plain_repair(rows):
    """The rows of one conversation, after damage: what repair() says, by the cheapest path over single edits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best, heap, result = set(), [(0, "", 0, "0", ())], None
    while heap:
        cost, audit, i, state, said = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best.add((i, state))
        if i == len(rows) and state in "0a":
            result = (cost, audit, said)
            break
        for to in "ua":
            if (state, to) in NEXT:
                heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*said, f"{repair.ROLES[to]}:")))
        if i < len(rows):
            role, text = rows[i][2:]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, said))
            if faults[i] in ("", "truncated"):
                for to in "sua":
                    if (state, to) in NEXT:
                        more = 5 * (faults[i] == "truncated")
                        if role[:1] == to:
                            heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*said, f"{role}:{text}")))
                        if to != "s":
                            heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, to, (*said, f"{repair.ROLES[to]}:{text}")))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(result[2]).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, result[0], result[1], digest)


def plain(rows):
    damaged = plain_damage(rows)
    return {c: plain_repair([r for r in damaged if r[0] == c]) for c in {r[0] for r in rows}}


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def run(spark, tmp_path, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        df = df.selectExpr("*", f"1 as {name}")
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op13_conversation_repair(spark, str(tmp_path)).collect()
    out = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in got}
    assert len(out) == len(got)
    return out


def test_random_conversations_equal_the_search(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(0, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys"])
            text = rng.choice(["ok.", "so", "why?", " \t\n", "", None, "x" * 50 + "!", "é。", "end. \v"]) if rng.random() < 0.6 else f"text {rng.random()}."
            rows.append((None if conv == 7 else conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
            if rng.random() < 0.1:
                rows += [rows[-1]] * rng.randint(1, 3)
    got, want = run(spark, tmp_path, rows), plain(rows)
    assert got == want
    assert all(any(x in w[6] for w in want.values()) for x in "DKR")


@pytest.mark.parametrize("block", [1, 3, 7])
def test_blocks_of_a_long_conversation_fold_to_the_same(spark, block):
    rng = random.Random(block)
    rows = [(c, t, rng.choice(["user", "user", "assistant", "system"]), rng.choice(["a.", "b", ""]) if rng.random() < 0.4 else f"{t}{rng.choice('.,')}") for c in (1, 2) for t in range(60)]
    counted = repair.damage(spark.createDataFrame(rows, SCHEMA))
    got = {r["conv_id"]: r for r in repair.repair(counted, with_turns=True, block=block).collect()}
    for conv, want in plain(rows).items():
        assert tuple(got[conv][f] for f in FIELDS) == want
        assert hashlib.sha256("\n".join(got[conv]["turns"]).encode()).hexdigest() == want[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in got[conv]["turns"]))


def test_empty_lost_long_and_clashing_columns(spark, tmp_path):
    lost = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "hi."), (500, 0, "user", "w " * 200_000 + "."), (500, 1, "assistant", "\n" * 200_000)]
    got = run(spark, tmp_path, rows, extra=("n", "said", "fault", "hit", "seq"))
    assert got == plain(rows)
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark, tmp_path, []) == {}


def test_many_equal_rows_are_one_with_a_count(spark):
    rows = [(1, None, "user", "same.")] * 5000 + [(1, 3, "assistant", "same.")]
    got = repair.repair(repair.counted(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", n int"))).collect()[0]
    assert (got["duplicate"], got["illegal"], got["cost"], got["audit"]) == (4999, 4999, 9998, "K" + "D" * 4999 + "K")


def test_whole_table_equals_the_search(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in repair.op13_conversation_repair(spark, sf).collect()}
    assert got == plain(rows)
