"""Simulated genotypes and phenotypes: seeded by hashes, so equal on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def dummy(spark: SparkSession, n: int, m: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """n samples with a random affection and m variants with random calls."""
    s = spark.range(n).select(F.col("id").cast("int").alias("sample_id")).withColumn("aff", unit(seed, F.lit("aff"), F.col("sample_id")) < 0.5)
    v = spark.range(m).select(F.col("id").cast("int").alias("vid"))
    u = unit(seed, F.col("sample_id"), F.col("vid"))
    g = s.select("sample_id").crossJoin(F.broadcast(v)).select("sample_id", "vid", F.when(u < 0.25, 0).when(u < 0.75, 1).otherwise(2).alias("dosage"))
    return s, g


def genotype_odds(freq: Column, prevalence: float, odds_het: Column, odds_hom: Column) -> tuple[list[Column], list[Column]]:
    """P(genotype | case) and P(genotype | control) for dosages 2, 1, 0, from the risks that the odds ratios give."""
    base = [freq * freq, 2 * freq * (1 - freq), (1 - freq) * (1 - freq)]
    risk0 = F.lit(prevalence) / (base[0] * odds_hom + base[1] * odds_het + base[2])
    risks = [risk0 * odds_hom, risk0 * odds_het, risk0]
    case = [b * r / prevalence for b, r in zip(base, risks, strict=True)]
    control = [b * (1 - r) / (1 - prevalence) for b, r in zip(base, risks, strict=True)]
    return case, control


def case_control(spark: SparkSession, params: DataFrame, cases: int, controls: int, prevalence: float = 0.01, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, variants and calls from (n, label, low, high, odds_het, odds_hom): n variants with a frequency between low and high."""
    v = params.select("label", "low", "high", "odds_het", "odds_hom", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).withColumn("name", F.concat_ws("_", "label", F.col("k").cast("string")))
    v = v.withColumn("freq", F.col("low") + (F.col("high") - F.col("low")) * unit(seed, F.col("name")))
    s = spark.range(cases + controls).select(F.col("id").cast("int").alias("sample_id"), (F.col("id") < cases).alias("aff"))
    case, control = genotype_odds(F.col("freq"), prevalence, F.col("odds_het"), F.col("odds_hom"))
    p2, p1 = (F.when(F.col("aff"), a).otherwise(b) for a, b in zip(case[:2], control[:2], strict=True))
    u = unit(seed, F.col("sample_id"), F.col("name"))
    g = s.crossJoin(F.broadcast(v)).select("sample_id", "name", F.when(u < p2, 2).when(u < p2 + p1, 1).otherwise(0).alias("dosage"))
    return s, v.select("name", "freq"), g


def quantitative(spark: SparkSession, params: DataFrame, n: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Samples with a phenotype of unit variance and calls, from (n, label, low, high, variance): each variant explains its share."""
    v = params.select("label", "low", "high", "variance", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).withColumn("name", F.concat_ws("_", "label", F.col("k").cast("string")))
    v = v.withColumn("freq", F.col("low") + (F.col("high") - F.col("low")) * unit(seed, F.col("name")))
    f = F.col("freq")
    v = v.withColumn("effect", F.sqrt(F.col("variance") / (2 * f * (1 - f))))
    s = spark.range(n).select(F.col("id").cast("int").alias("sample_id"))
    u = unit(seed, F.col("sample_id"), F.col("name"))
    g = s.crossJoin(F.broadcast(v)).withColumn("dosage", F.when(u < f * f, 2).when(u < f * f + 2 * f * (1 - f), 1).otherwise(0))
    rest = 1 - F.sum("variance")
    score = g.groupBy("sample_id").agg(F.sum(F.col("effect") * (F.col("dosage") - 2 * f)).alias("signal"), F.sqrt(F.greatest(rest, F.lit(0.0))).alias("sd"))
    a, b = unit(seed, F.lit("r"), F.col("sample_id")), unit(seed, F.lit("t"), F.col("sample_id"))
    noise = F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * 3.141592653589793 * b)
    return score.select("sample_id", (F.col("signal") + F.col("sd") * noise).alias("pheno")), g.select("sample_id", "name", "dosage")
