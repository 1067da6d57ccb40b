"""Quality by co-training two views of a document: its text, and its page metadata.

The text view sees what the words are like (symbols, repetition, word lengths, common words); the metadata view sees
language, source, size and layout (lines and their lengths). Each view has a logistic classifier. In each round each
labels the unlabelled rows of which it is surest, in the proportion of the labels, and hands them to the other as training
rows. At the end each view's score is calibrated on labelled rows that it was not fitted on, and a logistic curve over
both calibrated scores gives the document's probability of being good.

Both views of every document, a fixed number of features, are written once. The pool is every unlabelled document: in each
round Spark scores it by both views and counts the scores by bins, which give the cuts beyond which a view is surest.
The classifiers themselves are fitted in the driver on bounded samples of labelled rows, by a hash of the id: at most
``max_docs`` with labels, and of the rows that a round labels at most ``SHARE * max_docs`` for each view.

Defined cases: a null text is an empty text; null language or source is the empty name; rows with a null label take no
part in the fit; of one id's labels the largest counts; without both labels every document has the share of good ones as its score (1 with none: nothing is
rejected unseen); repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import Scratch, bounded_sample, doc_hash_mod, only_ids, small_batches, table

THRESHOLD = 0.35  # of the probability of being good; below it a document is rejected
MAX_DOCS = 12_000
ROUNDS = 4
SHARE = 0.05  # of the unlabelled rows that a view labels in a round
BIN = 0.001  # of scores of the pool, where the cuts are looked for
SURE = 1.0  # least log-odds of a row that a view labels
KINDS = 8  # hashed languages; sources get four times as many
TEXT, META = 14, 8 + KINDS + 4 * KINDS

SYMBOLS = re.compile(r"[^\w\s.,;:!?'\"()-]")
DIGITS = re.compile(r"\d+")
MARKS = re.compile(r"[.,;:!?'\"()-]")


def text_view(text: str) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    size = max(1, len(text))
    counts = Counter(words)
    top = counts.most_common(3)
    symbols = SYMBOLS.findall(text)
    letters = sum(map(len, words))
    runs = sum(map(str.__eq__, words, words[1:]))
    return [
        len(symbols) / size * 20,
        min(3.0, len(symbols) / n * 3),
        len(MARKS.findall(text)) / n,
        len(counts) / n,
        (top[0][1] if top else 0) / n,
        sum(c for _, c in top) / n,
        letters / n / 10,
        runs / n,
        text.count("|") / n * 3,
        sum(map(len, DIGITS.findall(text))) / size * 10,
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
        sum(c for w, c in counts.items() if len(w) >= 12) / n,
        sum(c for w, c in counts.items() if w[:1].isupper()) / n,
        min(3.0, np.log10(1 + n) / 2),
    ]


def meta_view(text: str, lang: str | None, source: str | None) -> list[float]:
    lines = text.split("\n")
    sizes = [len(x) for x in lines]
    size = len(text)
    out = [
        np.log10(1 + size) / 2,
        np.log10(1 + len(lines)),
        np.log10(1 + size / len(lines)) / 2,
        np.log10(1 + max(sizes)) / 2,
        sum(s < 40 for s in sizes) / len(lines),
        sum(s == 0 for s in sizes) / len(lines),
        len(set(lines)) / len(lines),
        len(text.encode()) / max(1, size) - 1,
    ]
    for name, kinds in ((lang, KINDS), (source, 4 * KINDS)):
        hot = [0.0] * kinds
        hot[zlib.crc32((name or "").encode()) % kinds] = 1.0
        out += hot
    return out


def _views(rows: pa.RecordBatch) -> np.ndarray:
    x = [text_view(t or "") + meta_view(t or "", a, b) for t, a, b in zip(*(rows.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True)]
    return np.array(x, np.float32).astype(float).reshape(-1, TEXT + META)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = batch.slice(at, 500)
            x = pa.array(_views(rows).astype(np.float32).ravel(), pa.float32())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.FixedSizeListArray.from_arrays(x, TEXT + META).cast(pa.list_(pa.float32()))], ["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row of docs: both views, the text's first."""
    small_batches(docs.sparkSession)
    return Scratch(docs.sparkSession).keep(docs.select("doc_id", "text", "lang", "source").mapInArrow(_features, "doc_id long, x array<float>"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, TEXT + META))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, decay: float = 1.0) -> np.ndarray:
    """Weights with the intercept last; Newton's method with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    w, ridge = np.zeros(x.shape[1]), np.diag([*[decay] * (x.shape[1] - 1), 1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _scaled(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / spread, -6, 6)


VIEWS = (slice(0, TEXT), slice(TEXT, TEXT + META))


def _pool_scores(model: dict):
    """(view, bin, n): how many unlabelled rows each view's log-odds put into each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            x = _scaled(_matrix(batch.column("x")), model["centre"], model["spread"])
            for me, (v, w) in enumerate(zip(VIEWS, model["weights"], strict=True)):
                kinds, times = np.unique(np.floor(predict(x[:, v], w) / BIN).astype(int), return_counts=True)
                seen.update({(me, k): n for k, n in zip(kinds.tolist(), times.tolist(), strict=True)})
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array(seen.values(), pa.int64())], ["view", "bin", "n"])

    return run


def _sure_rows(model: dict, cuts: list[tuple[float, float]], most: list[tuple[float, float]]):
    """(doc_id, view, y, x): rows that a view is surest about, thinned by a hash of the id to the shares in ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _matrix(batch.column("x"))
            x = _scaled(raw, model["centre"], model["spread"])
            draw = np.array(batch.column("draw"), float)
            for me, (v, w) in enumerate(zip(VIEWS, model["weights"], strict=True)):
                z = np.floor(predict(x[:, v], w) / BIN)
                for y, sure in ((0.0, z <= cuts[me][0]), (1.0, z >= cuts[me][1])):
                    at = np.flatnonzero(sure & (draw < most[me][int(y)]))
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.full(len(at), me), pa.int32()), pa.array(np.full(len(at), y), pa.float64()), part.column("x")], ["doc_id", "view", "y", "x"])

    return run


def _cuts(bins: dict[int, int], n_bad: int, n_good: int) -> tuple[float, float, int, int]:
    """The bins up to and from which about n_bad and n_good rows lie, and how many do; no row that isn't sure."""
    low, high, below, above = -np.inf, np.inf, 0, 0
    for b in sorted(bins):
        if below >= n_bad or (b + 1) * BIN > -SURE:
            break
        low, below = b, below + bins[b]
    for b in sorted(bins, reverse=True):
        if above >= n_good or b * BIN < SURE:
            break
        high, above = b, above + bins[b]
    return low, high, below, above


def co_train(x: np.ndarray, y: np.ndarray, pool: DataFrame, max_docs: int = MAX_DOCS) -> dict:
    """The model from labelled rows (x, y), whose order must not depend on the run, and the pool (doc_id, draw, x)."""
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 1.0}
    size = pool.count()
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = _scaled(x, centre, spread)
    train = np.arange(len(y)) % 4 != 3  # the rest calibrates
    if len(set(y[train].tolist())) < 2 or len(set(y[~train].tolist())) < 2:
        train = np.ones(len(y), bool)
    given: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((0, x.shape[1])), np.zeros(0))] * 2  # what each view has got from the other
    good = y[train].mean()

    def fit_views() -> list[np.ndarray]:
        out = []
        for v, (gx, gy) in zip(VIEWS, given, strict=True):
            xs, ys = np.concatenate([x[train][:, v], gx[:, v]]), np.concatenate([y[train], gy])
            out.append(logistic(xs, ys, np.concatenate([np.ones(int(train.sum())), np.full(len(gy), 0.3)])))
        return out

    model = {"centre": centre, "spread": spread, "weights": fit_views()}
    for turn in range(1, ROUNDS + 1):
        n = int(turn * SHARE * size)  # a view's labels of the rounds before are given anew, by what it has learnt since
        if not n:
            break
        n_bad = max(1, int(round(n * (1 - good))))
        bins: list[dict[int, int]] = [{}, {}]
        counted = pool.select("x").mapInArrow(_pool_scores(model), "view int, bin int, n long")
        for r in counted.groupBy("view", "bin").agg(F.sum("n").alias("n")).collect():  # at most 60 / BIN rows a view
            bins[r["view"]][r["bin"]] = r["n"]
        found = [_cuts(b, n_bad, n - n_bad) for b in bins]
        most = [tuple(min(1.0, SHARE * max_docs * turn / 2 / max(1, k)) for k in f[2:]) for f in found]
        rows = pool.mapInArrow(_sure_rows(model, [f[:2] for f in found], most), "doc_id long, view int, y double, x array<float>").toArrow().sort_by([("view", "ascending"), ("doc_id", "ascending")])
        gx, gy, me = _scaled(_matrix(rows.column("x").combine_chunks()), centre, spread), np.array(rows.column("y")), np.array(rows.column("view"))
        given = [(gx[me == 1 - v], gy[me == 1 - v]) for v in (0, 1)]
        model["weights"] = fit_views()
    held = ~train if not train.all() else train
    z = [predict(x[held][:, v], w) for v, w in zip(VIEWS, model["weights"], strict=True)]
    curves = [logistic(a[:, None], y[held], decay=1e-3) for a in z]
    both = np.column_stack([predict(a[:, None], c) for a, c in zip(z, curves, strict=True)])
    return model | {"curves": curves, "both": logistic(both, y[held], decay=0.1)}


def scores(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probabilities of being good: by text, by metadata, by both."""
    x = _scaled(x, model["centre"], model["spread"])
    z = [predict(predict(x[:, v], w)[:, None], c) for v, w, c in zip(VIEWS, model["weights"], model["curves"], strict=True)]
    return *(1 / (1 + np.exp(-a)) for a in z), 1 / (1 + np.exp(-predict(np.column_stack(z), model["both"])))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, views: DataFrame | None = None) -> dict:
    """labels: doc_id, quality; rows of docs without one are the pool. views: features(docs), where they are made already."""
    views = features(docs) if views is None else views
    labels = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    picked = bounded_sample(labels, "doc_id", max_docs)
    rows = views.join(F.broadcast(picked), "doc_id").toArrow()
    x = _matrix(rows.column("x").combine_chunks())
    ids = np.array([zlib.crc32(str(i).encode()) for i in rows.column("doc_id").to_pylist()], np.int64)
    order = np.lexsort((x[:, 0], ids)) if len(ids) else ids
    y = np.array(rows.column("quality").to_pylist(), float)[order]
    draw = F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1_000_000)) / F.lit(1_000_000)
    pool = only_ids(views, labels.select("doc_id"), inside=False).where("doc_id is not null").select("doc_id", draw.alias("draw"), "x")
    return co_train(x[order], y, Scratch(docs.sparkSession).keep(pool), max_docs)


def _scored(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.full(len(x), model["constant"]),) * 3 if "constant" in model else scores(model, x)


def score(docs: DataFrame, model: dict, views: DataFrame | None = None) -> DataFrame:
    """doc_id, text_score, meta_score, score: probabilities of being good. views: features(docs), where they are made already."""
    views = features(docs) if views is None else views
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            p = _scored(_matrix(rows.column("x")), shared.value)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(v, pa.float64()) for v in p)], ["doc_id", "text_score", "meta_score", "score"])

    return views.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs that are good enough, with all their columns; each task filters its own, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                yield rows.filter(pa.array(_scored(_views(rows), shared.value)[2] >= THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; labels whose crc32 leaves 2 by 4 are held out of the fit."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    views = features(docs)
    model = fit(docs, labels.where(doc_hash_mod("doc_id", 4) != 2), views=views)
    out = score(docs, model, views)
    return out.select("doc_id", (doc_hash_mod("doc_id", 4) == 2).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
ORACLE_SQL: dict[str, str] = {}
