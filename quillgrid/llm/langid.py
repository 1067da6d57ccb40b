"""Language identification by words first, with back-off to character n-grams.

A word that training has seen scores by its log frequency in each language. An unseen word backs off to its longest
known character n-grams, and to shorter ones where those are unknown. A document's language has the largest sum.

The fit reads a bounded sample of the training rows (``max_docs``, by a hash of the id), so that the model that each task
holds is bounded by the sample. Words that the sample holds once in a language are left to their n-grams, as a single
sight says less than these. Prediction reads every whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no training rows every text is
``und``; ties go to the alphabetically first language; rows without a language take no part in the fit; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.common import Scratch, bounded_sample, doc_hash_mod, small_batches, table

UNDETERMINED = "und"
LONGEST = 5  # characters of the longest n-grams
FLUSH = 300_000  # distinct features that a task counts before it hands them on
REMEMBERED = 1_600_000  # scores of words that a worker remembers, over all languages
RUNS = re.compile(r"[^\W\d_]+")
PIECE = 100_000  # n-grams of a word that are made at once


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case. What counts as numeric without being a digit (fractions, superscripts) is no letter."""
    words = RUNS.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word with its borders marked."""
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def pieces_of(word: str, n: int) -> Iterator[list[str]]:
    """The n-grams in lists of bounded length: a single word can have millions."""
    if len(word) < PIECE:
        yield grams_of(word, n)
        return
    marked = f"<{word}>"
    for at in range(0, len(marked) - n + 1, PIECE):
        yield [marked[i : i + n] for i in range(at, min(at + PIECE, len(marked) - n + 1))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, feature, count): n is 0 for words, else the n-gram's length."""
    seen: dict[str, Counter] = defaultdict(Counter)

    def rows(lang: str, n: int, counts: dict[str, int]) -> pa.RecordBatch:
        lengths = pa.array(np.full(len(counts), n, np.int32))
        columns = [pa.array([lang] * len(counts), pa.string()), lengths, pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "n", "feature", "count"])

    def out() -> Iterator[pa.RecordBatch]:
        for lang, words in seen.items():
            yield rows(lang, 0, words)
            for n in range(1, LONGEST + 1):
                grams: dict[str, int] = {}
                for w, c in words.items():
                    for piece in pieces_of(w, n):
                        for g in piece:
                            grams[g] = grams.get(g, 0) + c
                yield rows(lang, n, grams)
        seen.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen[lang].update(words_of(text))
            if sum(map(len, seen.values())) > FLUSH:
                yield from out()
    yield from out()


def fit(train: DataFrame, max_docs: int = 20_000) -> dict:
    """The model: languages, and log frequencies of words and n-grams. train: doc_id, text, lang."""
    small_batches(train.sparkSession)
    train = bounded_sample(train.where("lang is not null"), "doc_id", max_docs).where("text is not null")
    counts = train.select("lang", "text").mapInArrow(_count, "lang string, n int, feature string, count long")
    counts = Scratch(train.sparkSession).keep(counts.groupBy("lang", "n", "feature").agg(F.sum("count").alias("count")))
    totals = {(r["lang"], r["n"]): (r["total"], r["kinds"]) for r in counts.groupBy("lang", "n").agg(F.sum("count").alias("total"), F.count("*").alias("kinds")).collect()}
    kept = counts.where("n > 0 or count > 1").select("lang", "n", "feature", "count").toArrow()
    langs = sorted({lang for lang, _ in totals})
    index = {lang: i for i, lang in enumerate(langs)}
    # an n-gram or word that a language lacks gets half a count
    floors = np.array([[math.log(0.5 / (totals.get((x, n), (0, 0))[0] + 1)) for x in langs] for n in range(LONGEST + 1)], np.float32)
    places: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    rows: list[list[np.ndarray]] = [[] for _ in range(LONGEST + 1)]
    for lang, n, feature, count in zip(*(kept.column(i).to_pylist() for i in range(4)), strict=True):
        place = places[n].setdefault(feature, len(rows[n]))
        if place == len(rows[n]):
            rows[n].append(floors[n].copy())
        rows[n][place][index[lang]] = math.log(count / totals[lang, n][0])
    # centred, so that a word tells only how the languages differ
    tables = [np.array(r, np.float32).reshape(len(r), len(langs)) for r in rows]
    tables = [t - t.mean(axis=1, keepdims=True) if t.size else t for t in tables]
    return {"langs": langs, "places": places, "tables": tables}


def word_scores(model: dict, words: list[str]) -> np.ndarray:
    """A row of log frequencies by language for each word; n-grams of an unseen word share one vote, from the longest
    length that is known."""
    places, tables = model["places"], model["tables"]
    out = np.zeros((len(words), len(model["langs"])), np.float32)
    seen = [(at, i) for at, w in enumerate(words) if (i := places[0].get(w)) is not None]
    if seen:
        at, i = zip(*seen, strict=True)
        out[list(at)] = tables[0][list(i)]
    left = [at for at, w in enumerate(words) if w not in places[0]]
    for n in range(LONGEST, 0, -1):
        known: list[int] = []  # places of n-grams, word by word
        owners: list[int] = []  # words that have any
        starts: list[int] = []  # where their n-grams begin
        votes: dict[int, int] = defaultdict(int)

        def add(n=n, known=known, owners=owners, starts=starts):
            if known:
                np.add.at(out, owners, np.add.reduceat(tables[n][known], starts))
            for used in (known, owners, starts):
                used.clear()

        get = places[n].get
        for at in left:
            for piece in pieces_of(words[at], n):
                found = [i for g in piece if (i := get(g)) is not None]
                if found:
                    owners.append(at)
                    starts.append(len(known))
                    known += found
                    votes[at] += len(found)
                if len(known) > PIECE:
                    add()
        add()
        if votes:
            out[list(votes)] /= np.array(list(votes.values()), np.float32)[:, None]
            left = [at for at in left if at not in votes]
    return out


class _Scores(dict):
    """Places of words in a table of their scores, which starts anew when it is full."""

    def __init__(self, model: dict):
        super().__init__()
        self.model = model
        self.rows = np.zeros((max(20_000, REMEMBERED // max(1, len(model["langs"]))), len(model["langs"])), np.float32)

    def learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self]
        if new:
            self.rows[len(self) : len(self) + len(new)] = word_scores(self.model, new)
            self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))

    def total(self, words: list[str]) -> np.ndarray:
        out = np.zeros(self.rows.shape[1])
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            if len(self) + len(part) > len(self.rows):
                self.clear()
            self.learn(part)
            out += self.rows[list(map(self.__getitem__, part))].sum(axis=0, dtype=float)
        return out


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score. The model's size is bounded by the fit's parameters."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, langs = _Scores(shared.value), shared.value["langs"]
        for batch in batches:
            found, score = [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                if not words or not langs:
                    found.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                total = scores.total(words)
                best = int(total.argmax())
                # a long text's sum says more than its independent words do: 20 words' worth at most
                p = np.exp((total - total[best]) * min(1.0, 20 / len(words)))
                found.append(langs[best])
                score.append(float(1 / p.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document; rows whose crc32 is a multiple of 5 are held out of the fit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(doc_hash_mod("doc_id", 5) != 0))
    out = predict(docs, model)
    return out.select("doc_id", (doc_hash_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL: dict[str, str] = {}
