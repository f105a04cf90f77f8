"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.  Null and empty texts pass every
filter but toxicity's score for an empty text; columns that the operators don't know stay as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandflow.llm import decontam, lm, neardup, packing, pii, toxicity
from strandflow.llm.common import cut, forget, table

TOXIC = 0.3


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; every fourth fold of the labels teaches nothing."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), only=lambda _: ~lm.held_out_fold(4, 2))
    return toxicity.drop_toxic(docs, model, TOXIC)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, a similarity of 0.8."""
    return neardup.drop_near_copies(docs, k=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts are replaced by their kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii_redaction), ("packing", pack)]

#: SQL can't express the trained and the approximate stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        read, docs = docs, cut(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(read)
    return STAGES[-1][1](spark, docs, sf_dir)
