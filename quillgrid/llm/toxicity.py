"""Toxic passages by maximum-scoring segments of token log-odds.

Fit: the log-odds of a word between toxic and other documents under a Dirichlet prior that its prefixes give (all
words, five letters, seven letters, the word itself); unseen words so have the odds of their longest known prefix. A
token scores its log-odds less ``MARGIN``, so ordinary prose drifts down. One linear scan finds all maximal scoring
segments of a text. Their scores are judged by the extreme-value law of the best segment of that many clean tokens,
with its two constants taken from clean training documents; a segment whose expected number is below
``SIGNIFICANT`` is a toxic passage. A logistic curve over the best segment's normalised score and the sum over
significant passages gives the document's probability; it is fitted across two folds, each scored by the odds of the other.

The fit reads a bounded sample of labelled documents (``max_docs``, by a hash of the id), so that the model, of every token
and prefix that two of them hold, is bounded by it. Scores, and the sample's own in the fit, read whole texts.

Defined cases: null and empty texts have no passage and get the curve's value for that; rows with a null label take no
part in the fit; of one id's labels the largest counts; without both labels the score is the share of toxic rows (0 with none); repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import bounded_sample, doc_hash_mod, small_batches, table

WORD = re.compile(r"\w+")
PREFIXES = (5, 7)
PRIOR = 2.0  # weight of the prefix's odds, in documents
MARGIN = 0.7
LIMITS = (-2.0, 6.0)  # of a token's log-odds
SIGNIFICANT = 0.05
THRESHOLD = 0.3
MAX_DOCS = 30_000
BIN = 0.001  # of token scores, for the law's rate
FLUSH = 100_000
REMEMBERED = 100_000


def tokens_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def steps_of(token: str) -> list[str]:
    """From the shortest prefix to the token itself; prefixes carry a mark that no token has."""
    return [f"{token[:n]}*" for n in PREFIXES if len(token) >= n] + [token]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive; linear time.

    Each positive score opens a segment. A segment is joined with the nearest earlier one that starts from a lower
    running sum, if it also ends on a higher one; else it stands.
    """
    found: list[list] = []  # start, end, sum before it, sum at its end, index of the nearest earlier one that starts lower
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        now = [i, i + 1, total, total + s, -1]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = found[j][4]
            now[4] = j
            if j < 0 or found[j][3] >= now[3]:
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3], -1]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, fold, toxic, documents) for tokens and their prefixes, once a document."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(seen)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())],
            ["token", "fold", "toxic", "documents"],
        )
        seen.clear()
        return batch

    for batch in batches:
        for text, fold, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "toxic")), strict=True):
            words = set(tokens_of(text))
            seen.update((s, fold, toxic) for s in {x for w in words for x in steps_of(w)})
            if len(seen) > FLUSH:
                yield out()
    yield out()


def _log_odds(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Posterior log-odds of each token, shortest steps first, each with the prior of the step before."""
    out: dict[str, float] = {}
    ratio = n_toxic / max(1, n_clean)
    for token in sorted(counts, key=lambda t: (len(t) if t.endswith("*") else 1_000_000, t)):
        toxic, clean = counts[token]
        prior = 1.0
        for s in steps_of(token.removesuffix("*"))[:-1]:
            if s in out and s != token:
                prior = math.exp(out[s])
        odds = (toxic + PRIOR * ratio * prior) / ((clean + PRIOR) * ratio)
        out[token] = min(LIMITS[1], max(LIMITS[0], math.log(max(odds, 1e-9))))
    return out


class _Tokens(dict):
    """Token scores, with unseen tokens remembered."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, token: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        lo = 0.0
        for s in steps_of(token):
            lo = self.odds.get(s, lo)
        if len(token) < 64:
            self[token] = lo - MARGIN
        return lo - MARGIN


def scan(text: str | None, scores: _Tokens) -> tuple[int, list[float], list[tuple[int, int, float]]]:
    """Number of tokens, their scores, and the segments."""
    s = list(map(scores.__getitem__, tokens_of(text)))
    return len(s), s, segments(s) if s and max(s) > 0 else []


def _evidence(n: int, found: list[tuple[int, int, float]], law: tuple[float, float]) -> tuple[float, float, float]:
    """The best segment's score beyond what chance gives in n tokens, the same summed over significant ones, their number."""
    rate, log_k = law
    if not found:
        return 0.0, 0.0, 0.0
    beyond = [rate * s - log_k - math.log(max(n, 10)) for *_, s in found]
    some = [x for x in beyond if x > -math.log(SIGNIFICANT)]
    return min(20.0, max(0.0, max(beyond))), math.log1p(sum(some)), math.log1p(len(some))


def _law(values: np.ndarray, often: np.ndarray, best: list[tuple[int, float, int]]) -> tuple[float, float]:
    """Rate and log K from clean texts: their token scores and how often each occurs, and (tokens, best, texts): E(best of n) = K n exp(-rate best)."""
    if not often.sum():
        values, often = np.array([-MARGIN]), np.array([1])
    low, high = 1e-3, 20.0
    for _ in range(60):  # the positive root of mean(exp(rate s)) = 1
        mid = (low + high) / 2
        low, high = (mid, high) if np.average(np.exp(np.minimum(mid * values, 50)), weights=often) < 1 else (low, mid)
    rate = min(low, 3.0)
    some = [(rate * b - math.log(max(n, 10)), k) for n, b, k in best if n and b > 0]
    return rate, float(np.average([x for x, _ in some], weights=[k for _, k in some]) - 0.5772) if some else 0.0


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Weights with the intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([*[decay * len(x) / 100] * (x.shape[1] - 1), 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame) -> dict:
    """The model from rows (doc_id, text, toxic); see ``train_rows``."""
    small_batches(labelled.sparkSession)
    rows = labelled.select("text", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int").alias("fold"), F.col("toxic").cast("int").alias("toxic")).persist()
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n = {t: sum(v for (_, x), v in sizes.items() if x == t) for t in (0, 1)}
    if not n[0] or not n[1]:
        rows.unpersist()
        return {"constant": float(n[1] > 0)}
    counts = rows.mapInArrow(_count, "token string, fold int, toxic int, documents long").groupBy("token").agg(
        *(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("documents")).otherwise(0)).alias(f"c{f}{t}") for f in (0, 1) for t in (0, 1))
    )
    toxic, clean = F.col("c01") + F.col("c11"), F.col("c00") + F.col("c10")
    # of a token that one document holds, the prefixes give the odds
    kept = counts.where(toxic + clean > 1).select("token", "c00", "c01", "c10", "c11").toArrow().to_pydict()

    def odds(folds: tuple[int, ...]) -> dict[str, float]:
        sums = [np.sum([kept[f"c{f}{t}"] for f in folds], axis=0).tolist() for t in (1, 0)]
        got = dict(zip(kept["token"], zip(*sums, strict=True), strict=True))
        return _log_odds({k: v for k, v in got.items() if sum(v)}, sum(sizes.get((f, 1), 0) for f in folds), sum(sizes.get((f, 0), 0) for f in folds))

    both = all(sizes.get((f, t), 0) >= 5 for f in (0, 1) for t in (0, 1))
    whole = odds((0, 1))
    cross = {0: odds((1,)), 1: odds((0,))} if both else {0: whole, 1: whole}
    shared = rows.sparkSession.sparkContext.broadcast(cross)

    def clean_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each clean text its tokens and best segment, and the counts of all token scores by bin."""
        tables = {f: _Tokens(o) for f, o in shared.value.items()}
        names, bins = ["bin", "n", "best", "count"], Counter()

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names)

        for batch in batches:
            out = []
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                size, scores, found = scan(text, tables[fold])
                kinds, times = np.unique(np.rint(np.array(scores) / BIN).astype(int), return_counts=True)
                bins.update(dict(zip(kinds.tolist(), times.tolist(), strict=True)))
                out.append((None, size, max((s for *_, s in found), default=0.0), 1))
            yield rows_of(out)
        yield rows_of([(k, 0, 0.0, v) for k, v in bins.items()])

    got = rows.where("toxic = 0").mapInArrow(clean_scores, "bin int, n long, best double, count long")
    got = got.groupBy("bin", "n", "best").agg(F.sum("count").alias("count")).toArrow().to_pylist()
    binned = [(r["bin"], r["count"]) for r in got if r["bin"] is not None]
    law = _law(np.array([b for b, _ in binned], float) * BIN, np.array([c for _, c in binned], float), [(r["n"], r["best"], r["count"]) for r in got if r["bin"] is None])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The evidence of each text, from all its segments."""
        tables = {f: _Tokens(o) for f, o in shared.value.items()}
        for batch in batches:
            x = []
            for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                size, _, found = scan(text, tables[fold])
                x.append(_evidence(size, found, law))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    got = rows.mapInArrow(measure, "toxic int, x array<double>").toArrow().to_pydict()
    rows.unpersist()
    x = np.array(got["x"])
    return {"odds": whole, "law": law, "curve": _logistic(x, np.array(got["toxic"], float)).tolist()}


def train_rows(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """A bounded sample of labelled documents; it's drawn before the join and broadcast, so that no text moves."""
    labels = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = bounded_sample(labels, "doc_id", max_docs)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def passages(text: str | None, model: dict) -> list[tuple[int, int, float]]:
    """The significant toxic passages of one text: first token, end token, expected number by chance."""
    n, _, found = scan(text, _Tokens(model["odds"]))
    rate, log_k = model["law"]
    expected = [(a, b, math.exp(log_k + math.log(max(n, 10)) - rate * s)) for a, b, s in found]
    return [x for x in expected if x[2] < SIGNIFICANT]


def judge(text: str | None, model: dict, tokens: _Tokens) -> tuple[float, int, float | None]:
    """Probability that the text is toxic, its number of significant passages, the least expected number of one."""
    if "constant" in model:
        return model["constant"], 0, None
    n, _, found = scan(text, tokens)
    rate, log_k = model["law"]
    e = _evidence(n, found, model["law"])
    z = sum(a * b for a, b in zip(model["curve"], [*e, 1.0], strict=True))
    worst = math.exp(-max(rate * s - log_k - math.log(max(n, 10)) for *_, s in found)) if found else None
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), round(math.expm1(e[2])), worst


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns; each task filters its own, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(shared.value.get("odds", {}))
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py(), shared.value, tokens)[0] < THRESHOLD for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, n_passages, worst (the least expected number of a segment by chance)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tokens = _Tokens(m.get("odds", {}))
        for batch in batches:
            p, n_found, worst = [], [], []
            for text in batch.column("text"):
                chance, some, least = judge(text.as_py(), m, tokens)
                p.append(chance)
                n_found.append(some)
                worst.append(least)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(p, pa.float64()), pa.array(n_found, pa.int64()), pa.array(worst, pa.float64())],
                ["doc_id", "score", "n_passages", "worst"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_passages long, worst double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; rows whose crc32 leaves 2 by 4 are held out of the fit."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(train_rows(docs, labels.where(doc_hash_mod("doc_id", 4) != 2), MAX_DOCS))
    out = score(docs, model)
    return out.select("doc_id", (doc_hash_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
