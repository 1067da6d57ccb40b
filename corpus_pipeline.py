"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

quality: documents that the co-trained classifier rejects go. toxicity: documents with a toxicity score of 0.3 or more go.
near_dedup: one document of each group of near-duplicates (five-word shingles, 0.8) stays. decontaminate: documents that
hold a benchmark item go. bpe: every document that is left, encoded and decoded.

The classifiers learn from labels whose crc32 leaves another remainder than 2 by 4. Rows keep the columns of documents up to
the last stage, which returns one row a document: doc_id, n_tokens and the digests of ids and decoded text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm import bpe, decontaminate, minhash, quality, toxicity
from quillgrid.llm.common import Scratch, doc_hash_mod, only_ids, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(doc_hash_mod("doc_id", 4) != 2)
    return quality.accepted(docs, quality.fit(docs, labels))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(doc_hash_mod("doc_id", 4) != 2)
    return toxicity.accepted(docs, toxicity.fit(toxicity.train_rows(docs, labels, toxicity.MAX_DOCS)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the document that its group keeps; rows with one id are one document and stay or go together."""
    gone = minhash.near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id")
    return only_ids(docs, Scratch(spark).keep(gone), inside=False)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return only_ids(docs, found.select("doc_id"), inside=False)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]
#: SQL can express neither the classifiers nor the tokenizer; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        last = docs
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if i:
            scratch.drop(last)
    return docs
