"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from strandflow.llm import decontam, lm, media, neardup, packing, pii, quality, tokens, toxicity, warc
from strandflow.llm.common import table

WORD_BPE = "word_bpe_49k.json"


def op1_quality(spark, sf_dir):
    """A row for each document: its score and whether it stays."""
    docs = table(spark, sf_dir, "documents")
    _, scorer = quality.train(docs)
    return quality.score(docs, scorer).withColumn("keep", F.col("score") >= quality.KEEP)


def op2_decontamination(spark, sf_dir):
    """A row for each document and benchmark item whose passage it holds."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("contaminated", F.lit(True))


def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_counts(spark, sf_dir):
    counts = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op6_lm_scores(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), lm.held_out_fold(7, 2))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)).drop("ids")


def op8_media(spark, sf_dir):
    return media.digest(media.probe(media.stored(media.encode(table(spark, sf_dir, "documents")))))


def op3_pii(spark, sf_dir):
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), only=lambda _: ~lm.held_out_fold(4, 2))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", lm.held_out_fold(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


QUERIES = {f.__name__: f for f in (op1_quality, op2_decontamination, op3_pii, op4_warc, op5_token_counts, op6_lm_scores, op7_packing, op8_media, op9_toxicity, op10_near_dedup)}

#: Base 32 of a SHA-1 from its hex digits, five of which are four letters.
_BASE32 = """list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(floor(
    ((strpos('0123456789abcdef', substr(hex, 5*(i//4)+1, 1))-1) * 65536 + (strpos('0123456789abcdef', substr(hex, 5*(i//4)+2, 1))-1) * 4096
    + (strpos('0123456789abcdef', substr(hex, 5*(i//4)+3, 1))-1) * 256 + (strpos('0123456789abcdef', substr(hex, 5*(i//4)+4, 1))-1) * 16
    + (strpos('0123456789abcdef', substr(hex, 5*(i//4)+5, 1))-1)) / (32 ** (3 - i % 4))) AS BIGINT) % 32, 1)), 'string_agg', '')"""

SQL = {
    "op4_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM h""",
}
