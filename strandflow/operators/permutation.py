"""Multiple testing by ranges of ordered p values, and permutation as matrix products of calls and shuffled labels.

A replicate's shuffle orders the samples by a hash of seed, replicate and sample within each cluster and deals the labels in
that order: the same anywhere, any time, without a random number stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.stats import chi2_sf1, div
from strandflow.lineage import cut
from strandflow.operators.ordered import in_ranges, running
from strandflow.operators.products import label_sums


def multiple_testing(results: DataFrame, chisq: str = "chisq") -> DataFrame:
    """vid, unadj, gc, bonf, holm, sidak_ss, sidak_sd, fdr_bh, fdr_by.

    Results are one row for each variant; places and running extremes come by ranges of the order (``ordered``).
    """
    x = results.where(F.col(chisq).isNotNull()).select("vid", F.col(chisq).alias("c"))
    med = x.agg(F.greatest(F.percentile("c", 0.5) / 0.456, F.lit(1.0)).alias("lambda"), F.count("*").alias("t"), F.sum(F.lit(1)).alias("one"))
    x = x.crossJoin(F.broadcast(med)).withColumn("unadj", chi2_sf1(F.col("c"))).withColumn("gc", chi2_sf1(F.col("c") / F.col("lambda")))
    order = ["unadj", "vid"]
    x = running(in_ranges(x, *order), order, {"place": ("sum", F.lit(1))})
    p, t, i = F.col("unadj"), F.col("t").cast("double"), F.col("place") - 1
    x = x.crossJoin(F.broadcast(x.agg(F.sum(1.0 / F.col("place")).alias("h"))))
    one = lambda c: F.least(F.lit(1.0), c)
    up = {"holm": ("max", one((t - i) * p)), "sidak_sd": ("max", -F.expm1((t - i) * F.log1p(-p)))}
    down = {"fdr_bh": ("min", one(t * p / (i + 1))), "fdr_by": ("min", one(F.col("h") * t * p / (i + 1)))}
    x = running(x, order, up, down)
    return x.select("vid", "unadj", "gc", one(p * t).alias("bonf"), "holm", (-F.expm1(t * F.log1p(-p))).alias("sidak_ss"), "sidak_sd", "fdr_bh", "fdr_by")


def shuffled(s: DataFrame, label: str, reps: DataFrame, seed: int = 1, within: str | None = None) -> DataFrame:
    """rep, sample_id, label: the labels dealt anew within clusters, for each replicate."""
    group = [F.col(within)] if within else [F.lit(0)]
    x = s.select("sample_id", F.col(label).alias("label"), group[0].alias("grp")).crossJoin(F.broadcast(reps))
    # A square modulo a prime of a line whose slope is the replicate's: plain integers, so SQL can follow it.
    prime = F.lit(2_147_483_647)
    slope = (F.col("rep").cast("long") * 40_692 + seed * 69_621 + 48_271) % prime
    line = (F.col("sample_id").cast("long") * slope + F.col("rep") * 7919) % prime
    key = (line * line + line) % prime
    x = x.withColumn("from", F.row_number().over(Window.partitionBy("rep", "grp").orderBy("sample_id"))).withColumn("to", F.row_number().over(Window.partitionBy("rep", "grp").orderBy(key, "sample_id")))
    dealt = x.select("rep", "grp", F.col("from").alias("to"), F.col("label").alias("dealt"))
    return x.join(dealt, ["rep", "grp", "to"]).select("rep", "sample_id", F.col("dealt").alias("label"))


def max_t(g: DataFrame, s: DataFrame, n: int, seed: int = 1, within: str | None = None) -> DataFrame:
    """vid, chisq, emp1, emp2 of the allelic test: matrix products of blocks of variants and the replicates' labels, replicate 0 as observed.

    The allele counts of cases determine the table, as its margins are the same in each replicate.
    """
    reps = s.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("rep"))
    labels = shuffled(s, "aff", reps, seed, within).unionByName(s.select(F.lit(0).alias("rep"), "sample_id", F.col("aff").alias("label")))
    x = cut(label_sums(g, labels), "replicates")
    # Copies of both alleles in cases, then in controls.
    a, b = F.col("x"), 2 * F.col("n") - F.col("x")
    c, d = F.col("all_x") - a, 2 * F.col("all_n") - F.col("all_x") - b
    x = x.select("rep", "vid", div((a + b + c + d) * (a * d - b * c) ** 2, (a + b) * (c + d) * (a + c) * (b + d)).alias("stat"))
    seen = x.where("rep = 0").select("vid", F.col("stat").alias("chisq"))
    top = x.where("rep > 0").groupBy("rep").agg(F.max("stat").alias("top"))
    # All replicates' maxima are n numbers: they go to each variant as one array.
    tops = top.agg(F.collect_list("top").alias("tops"))
    one = x.where("rep > 0").join(seen, "vid").groupBy("vid", "chisq").agg(F.sum((F.col("stat") >= F.col("chisq") - 1e-9).cast("int")).alias("r1"))
    r2 = F.size(F.filter("tops", lambda t: t >= F.col("chisq") - 1e-9))
    return one.crossJoin(F.broadcast(tops)).select("vid", "chisq", ((F.col("r1") + 1) / F.lit(n + 1.0)).alias("emp1"), ((r2 + 1) / F.lit(n + 1.0)).alias("emp2"))


def adaptive(g: DataFrame, statistic: Callable[[DataFrame, DataFrame], DataFrame], labels: Callable[[int, int], DataFrame], observed: DataFrame, batch: int = 100, most: int = 10_000, alpha: float = 0.05, width: float = 1.96) -> DataFrame:
    """vid, r, n, emp1: variants leave when the interval of their p excludes ``alpha``; the rest go on in batches.

    ``labels(first, count)`` deals replicates; ``statistic(g, labels)`` gives (rep, vid, stat).  Only the open ids return to the driver.
    """
    spark, done, start = g.sparkSession, [], 1
    open_rows = {r.vid: [r.stat, 0] for r in observed.where("stat is not null").select("vid", "stat").collect()}
    while open_rows and start <= most:
        ids = spark.createDataFrame([(k, float(v[0])) for k, v in open_rows.items()], "vid int, seen double")
        hits = statistic(g.join(ids.select("vid"), "vid", "left_semi"), labels(start, batch)).join(ids, "vid").groupBy("vid").agg(F.sum((F.col("stat") >= F.col("seen") - 1e-9).cast("int")).alias("r")).collect()
        n = start - 1 + batch
        for h in hits:
            open_rows[h.vid][1] += h.r
        for k in list(open_rows):
            r = open_rows[k][1]
            p = (r + 1) / (n + 1)
            half = width * (p * (1 - p) / n) ** 0.5
            if p - half > alpha or p + half < alpha or n >= most:
                done.append((k, r, n, p))
                del open_rows[k]
        start += batch
    return spark.createDataFrame(done, "vid int, r int, n int, emp1 double")
