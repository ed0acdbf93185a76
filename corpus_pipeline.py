"""From raw documents to token ids: quality, near duplicates, personal data, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet to the shared folder and rereads it for the next
stage. All but the last return the columns of documents, extra ones included,
whatever they are called. Every stage works on all rows that the one before it
kept. A null text counts as empty throughout and stays null; an empty table
stays empty; ids and sources may be null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kithbase.llm import bpe, gam, mixing, neardup, pii
from kithbase.llm.store import place

KEEP = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score by the additive model reaches KEEP; the model learns from the labels outside the held-out fold. Null and empty texts are scored as texts without words; repeated rows fare alike; without labels every score is 0.5 and all rows stay."""
    model = gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return gam.scored(docs, model, KEEP)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id. Null and empty texts are one group; of repeated rows one stays."""
    return neardup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with spans of personal data replaced by their kind in brackets; n_chars follows the text. A null text stays null; very long texts are decoded whole."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row none, one or two times, so that the sources come to their target weights. A null source is a source of its own; rows without words are taken as their hash has it; rows equal in id and text share one fate."""
    return mixing.mix(docs, emit="rows")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and token ids of every row, and their number and digests; decoding is part of the digests. A null or empty text has no tokens; columns of docs called like new ones are replaced."""
    blob = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(docs, blob, public_tokenizers.PATTERN, emit="both")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixture", mixture), ("tokens", tokens)]

#: The classifier, the similarity of multisets and the field aren't SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = place(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
