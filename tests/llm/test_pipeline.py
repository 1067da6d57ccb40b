import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from brute import components  # noqa: E402

from quillgrid.llm import bpe, decontaminate, quality, toxicity  # noqa: E402
from quillgrid.llm.common import doc_hash_mod  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "slot"]


@pytest.fixture(scope="module")
def docs(spark):
    """The table, an extra column, copies near and exact, a benchmark item, nulls and an empty text."""
    rng = random.Random(6)
    own = [f"v{rng.randint(0, 500)}" for _ in range(120)]
    near = own[:60] + ["changed"] + own[61:]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    rows = [(10**9 + i, t, "en", "s", 1) for i, t in enumerate([" ".join(own), " ".join(near), " ".join(own), f"so it says {item} here", None, ""])]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    return table.unionByName(spark.createDataFrame(rows, table.schema)).withColumn("slot", F.lit("x")).persist()


def _kept(df):
    assert df.columns == COLUMNS
    rows = df.collect()
    assert all(r["slot"] == "x" for r in rows)
    return sorted(r["doc_id"] for r in rows)


def test_classifier_stages_keep_what_the_scores_say(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(doc_hash_mod("doc_id", 4) != 2)
    good = quality.score(docs, quality.fit(docs, labels)).where(F.col("score") >= quality.THRESHOLD)
    assert _kept(corpus_pipeline.quality_stage(spark, docs, SF)) == sorted(r["doc_id"] for r in good.collect())
    clean = toxicity.score(docs, toxicity.fit(toxicity.train_rows(docs, labels, toxicity.MAX_DOCS))).where(F.col("score") < toxicity.THRESHOLD)
    assert _kept(corpus_pipeline.toxicity_stage(spark, docs, SF)) == sorted(r["doc_id"] for r in clean.collect())


def test_near_dedup_stage_equals_brute_force(spark, docs):
    want = components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert _kept(corpus_pipeline.near_dedup_stage(spark, docs, SF)) == sorted(i for i, (_, c) in want.items() if i == c)


def test_decontaminate_stage_drops_what_matches(spark, docs):
    found = {r["doc_id"] for r in decontaminate.matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert 10**9 + 3 in found
    assert _kept(corpus_pipeline.decontaminate_stage(spark, docs, SF)) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in found)


def test_whole_pipeline_is_its_stages_in_a_row(spark):
    got = corpus_pipeline.run(spark, SF)
    step = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF).persist()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, step.collect()))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < got.count() < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_empty_table(spark):
    step = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF)
    assert step.count() == 0
    assert bpe.RESULT.startswith("doc_id")
