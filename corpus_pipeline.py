"""The corpus pipeline: documents that pass a quality classifier, without exact and near copies,
personal data masked, packed into windows of token ids.

Each stage takes what the one before wrote as Parquet.  All but the last return the columns of
``documents``; rows with null columns pass through as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import exact_dedup, near, packing, pii, quality
from threadloom.llm.common import discard, stash, table
from threadloom.llm.queries import END_ID

#: Documents that score less go.
QUALITY = 0.7
#: Rows that the classifier may learn from, as for ``op10_quality``.
LEARN = "not coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``QUALITY`` or more; all of them if no model can be trained, for want of
    labelled documents of both classes."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"), rows=LEARN)
    return quality.keep(docs, weights, QUALITY) if weights.any() else docs


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word sets that share 0.8 of their union link, found through SimHash neighbours and a prefix index;
    the least doc_id of each group stays."""
    return near.drop_near(docs, words=5)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("pii", mask_personal),
    ("packing", pack),
]

#: The tokenizer and the classifiers are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        spent, docs = docs, stash(stage(spark, docs, sf_dir), name)
        discard(spent)  # only what a stage has written goes
    return STAGES[-1][1](spark, docs, sf_dir)
