"""A corpus pipeline: toxic documents go, copies go, near copies go, secrets are masked, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read
again as the next stage's documents. All stages but the last return the columns of documents.

Defined results, for every stage and so for the whole: null ids are ids like others, a null text is an empty one (it is
not toxic, all rows with it are copies of one another, it has no shingles and no secrets, and packs as one token);
very long texts are read whole; other columns are passed on as they are, whatever their names; an empty table gives no
rows. The labels are joined by id; where ids repeat, each row is still a document of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import exact_dedup, jaccard_join, packing, secret_scan, toxicity
from tidewire.llm.common import discard, finished


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under one half. Rows of equal text stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text; of ties (equal ids too) the smallest id, then any one row."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest id; rows without shingles all stay."""
    return jaccard_join.keep_firsts(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; every secret in a text is replaced, and n_chars follows where it was."""
    return secret_scan.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: where it lies in which sequence. Rows with equal ids are packed each."""
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Trained scores, near copies and tokens cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, of documents that may be empty. Every stage's rows are stored; its scratch, and its predecessor's rows, go then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, finished(spark, lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")  # noqa: B023
        discard(before)
    return docs
