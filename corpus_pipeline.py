"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes each one's result as Parquet to the shared folder and reads it for the
next. All stages but the last return the columns of ``documents``, with n_chars
following the text.

Defined cases: a null or empty text, and one without a letter, goes in the first
stage; repeated rows are near copies of each other, of which one stays; rows without
an id are all kept by the second stage and count as the last ones in the third; an
empty table gives no rows; of equal sequences of words the smallest id stays; texts
of any length are processed whole; further columns, whatever their names, go with
their rows up to the last stage, which gives its own columns only.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import chunk_dedup, jaccard_join, langid, packing, pii
from lodestack.storage import remove_folder, shared_folder

#: Pairs of documents at this share of common five-word shingles count as near copies.
NEAR_COPIES = jaccard_join.Join(shingle=5, percent=80)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language the centroids reject."""
    model = langid.fit(docs)
    return langid.annotate(docs, model).where(~F.col("rejected")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, of the smallest id, of each group of near copies."""
    return jaccard_join.keep_one(docs, NEAR_COPIES)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; what they left without a word goes."""
    return _counted(chunk_dedup.deduplicated(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalise personal data and the terms that disclose it."""
    return _counted(pii.sanitise(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences: one row per piece."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("substring_dedup", substring_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return made
        made.write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
        if number:
            # what this stage was made from is read no more
            remove_folder(spark, f"{folder}/{number - 1}-{STAGES[number - 1][0]}")
    return docs
