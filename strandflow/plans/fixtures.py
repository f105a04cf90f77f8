"""The analysis tables, derived from the test tables by arithmetic that Spark and DuckDB evaluate alike.

``embeddings`` gives instances with 64 numeric attributes; an attribute's value also makes a genotype call (0, 1, 2 by two
thresholds, some missing by arithmetic on the ids).  ``part`` gives ranges, ``events`` gives segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def numerics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("attr_id", "value"))
    return e.withColumn("value", F.col("value").cast("double"))


def genotypes(spark: SparkSession, sf: str) -> DataFrame:
    n = numerics(spark, sf).withColumn("vid", F.col("attr_id") + 1)
    d = F.when((F.col("sample_id") * 7 + F.col("vid") * 13) % 31 != 0, F.when(F.col("value") < -0.08, 0).when(F.col("value") > 0.08, 2).otherwise(1))
    return n.select("sample_id", "vid", d.alias("dosage"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    e, i, label = table(spark, sf, "embeddings"), F.col("vec_id"), F.col("label")
    return e.select(i.alias("sample_id"), (label < 5).alias("aff"), label.alias("cluster"), label.alias("cls"), (i % 2 + 1).cast("int").alias("sex"), F.element_at("embedding", 1).cast("double").alias("pheno"), (i % 5 != 0).alias("founder"))


def variants(spark: SparkSession, sf: str) -> DataFrame:
    vid = F.col("id").cast("int")
    return spark.range(1, 65).select(vid.alias("vid"), (F.floor((vid - 1) / 16) + 1).cast("int").alias("chr"), (vid * 1000).alias("bp"), F.concat(F.lit("v"), vid.cast("string")).alias("name"))


def trios(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf, "embeddings").where(i % 3 == 2).select(i.alias("kid"), (i - 2).alias("father"), (i - 1).alias("mother"))


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    start = (k * 37 % 64 * 1000).cast("int")
    return table(spark, sf, "part").select((F.col("p_size") % 4 + 1).alias("chr"), start.alias("start"), (start + 2500).alias("stop"), F.concat("p_name", F.lit("/"), k.cast("string")).alias("name"), F.col("p_brand").alias("grp"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    bp1 = (e * 7919 % 1_000_000).cast("int")
    return table(spark, sf, "events").select(e.alias("seg_id"), u.alias("sample_id"), (u % 4 + 1).cast("int").alias("chr"), bp1.alias("bp1"), (bp1 + F.floor(F.col("value") * 100).cast("int")).alias("bp2"), F.when(F.col("event_type") == "view", 1).otherwise(3).alias("type"), F.col("value").alias("score"), (e % 20).cast("int").alias("sites"))


def instances(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cls"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """A weight and a q value for each variant, from its parts' prices."""
    v = (F.col("p_partkey") % 64 + 1).cast("int")
    return table(spark, sf, "part").groupBy(v.alias("vid")).agg((F.avg("p_retailprice") / 1000).alias("weight"), F.avg(F.col("p_size").cast("double")).alias("q"))


#: The same tables in DuckDB's SQL.
CTE = """
num AS (SELECT vec_id AS sample_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS attr_id, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
g AS (SELECT sample_id, attr_id + 1 AS vid, CASE WHEN (sample_id * 7 + (attr_id + 1) * 13) % 31 = 0 THEN NULL WHEN value < -0.08::DOUBLE THEN 0 WHEN value > 0.08::DOUBLE THEN 2 ELSE 1 END AS dosage FROM num),
s AS (SELECT vec_id AS sample_id, label < 5 AS aff, label AS cluster, label AS cls, CAST(vec_id % 2 + 1 AS INTEGER) AS sex, CAST(embedding[1] AS DOUBLE) AS pheno, vec_id % 5 <> 0 AS founder FROM embeddings),
v AS (SELECT CAST(i AS INTEGER) AS vid, CAST((i - 1) // 16 + 1 AS INTEGER) AS chr, CAST(i * 1000 AS INTEGER) AS bp, 'v' || i AS name FROM range(1, 65) t(i)),
trios AS (SELECT vec_id AS kid, vec_id - 2 AS father, vec_id - 1 AS mother FROM embeddings WHERE vec_id % 3 = 2),
ranges AS (SELECT p_size % 4 + 1 AS chr, CAST(p_partkey * 37 % 64 * 1000 AS INTEGER) AS start, CAST(p_partkey * 37 % 64 * 1000 + 2500 AS INTEGER) AS stop, p_name || '/' || p_partkey AS name, p_brand AS grp FROM part),
seg AS (SELECT event_id AS seg_id, user_id AS sample_id, CAST(user_id % 4 + 1 AS INTEGER) AS chr, CAST(event_id * 7919 % 1000000 AS INTEGER) AS bp1,
    CAST(event_id * 7919 % 1000000 AS INTEGER) + CAST(floor(value * 100) AS INTEGER) AS bp2, CASE WHEN event_type = 'view' THEN 1 ELSE 3 END AS type, value AS score, CAST(event_id % 20 AS INTEGER) AS sites FROM events),
wt AS (SELECT CAST(p_partkey % 64 + 1 AS INTEGER) AS vid, avg(p_retailprice) / 1000 AS weight, avg(CAST(p_size AS DOUBLE)) AS q FROM part GROUP BY 1)
"""
