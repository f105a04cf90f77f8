"""Filters and predicates on samples, variants, calls and numeric attributes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.stats import div
from strandflow.operators.ordered import in_ranges, running
from strandflow.operators.summaries import allele_freq, hwe, missing_by


def mind(g: DataFrame, most: float) -> DataFrame:
    """Samples whose missing rate is at most ``most``; comes before the variants' filters."""
    return g.join(missing_by(g, "sample_id").where(F.col("f_miss") <= most).select("sample_id"), "sample_id", "left_semi")


def geno(g: DataFrame, most: float) -> DataFrame:
    """Variants whose missing rate is at most ``most``."""
    return g.join(missing_by(g, "vid").where(F.col("f_miss") <= most).select("vid"), "vid", "left_semi")


def maf(g: DataFrame, least: float = 0.0, most: float = 1.0) -> DataFrame:
    """Variants by the frequency of the rarer allele."""
    f = F.least("freq", 1 - F.col("freq"))
    return g.join(allele_freq(g).where((f + 1e-12 >= least) & (f <= most)).select("vid"), "vid", "left_semi")


def hwe_filter(g: DataFrame, s: DataFrame, most_chisq: float, group: str = "UNAFF") -> DataFrame:
    """Variants whose Hardy-Weinberg chi-square in a group is at most a bound (or unknown)."""
    bad = hwe(g, s).where((F.col("grp") == group) & (F.col("chisq") > most_chisq)).select("vid")
    return g.join(bad, "vid", "left_anti")


def qc(g: DataFrame, s: DataFrame, most_sample: float, most_variant: float, least_maf: float, most_chisq: float) -> DataFrame:
    """vid, n: surviving variants with their calls, after all four filters in order."""
    x = hwe_filter(maf(geno(mind(g, most_sample), most_variant), least_maf), s, most_chisq)
    return x.where("dosage is not null").groupBy("vid").agg(F.count("*").alias("n"))


def region(v: DataFrame, chr: int | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Variants of a chromosome and span of positions; negative positions are out.  The predicates reach the scan."""
    cond = F.col("bp") >= 0
    for c, x in ((F.col("chr"), chr),):
        cond = cond if x is None else cond & (c == x)
    cond = cond if start is None else cond & (F.col("bp") >= start)
    return v.where(cond if stop is None else cond & (F.col("bp") <= stop))


def named(v: DataFrame, spec: str) -> DataFrame:
    """Variants named in ``a,b-c``: single names and ranges by the order of (chr, bp)."""
    bounds = [p.split("-", 1) for p in re.split(r"\s*,\s*", spec) if p]
    ends = {n for b in bounds for n in b}
    place = {r["name"]: (r["chr"], r["bp"]) for r in v.where(F.col("name").isin(*ends)).select("name", "chr", "bp").collect()}
    cond = F.lit(False)
    for b in bounds:
        lo, hi = place[b[0]], place[b[-1]]
        key = F.struct("chr", "bp")
        cond = cond | ((key >= F.struct(F.lit(lo[0]), F.lit(lo[1]))) & (key <= F.struct(F.lit(hi[0]), F.lit(hi[1]))))
    return v.where(cond)


def window_around(v: DataFrame, name: str, kb: float) -> DataFrame:
    """Variants within kb of a named one."""
    at = v.where(F.col("name") == name).select(F.col("chr").alias("c0"), F.col("bp").alias("b0"))
    return v.join(F.broadcast(at), (F.col("chr") == F.col("c0")) & (F.abs(F.col("bp") - F.col("b0")) <= kb * 1000)).drop("c0", "b0")


def keep(x: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    return x.join(ids, on, "left_semi")


def remove(x: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    return x.join(ids, on, "left_anti")


def subset(s: DataFrame, which: str) -> DataFrame:
    """Cases, controls, males, females, founders or nonfounders."""
    aff, sex, founder = F.col("aff"), F.col("sex"), F.col("founder")
    return s.where({"cases": aff, "controls": ~aff, "males": sex == 1, "females": sex == 2, "founders": founder, "nonfounders": ~founder}[which])


def has_attributes(x: DataFrame, attributes: Column, spec: str) -> DataFrame:
    """Rows with one of the wanted attributes (or none asked for) and none of those after a minus."""
    names = [a for a in spec.split(",") if a]
    want, avoid = [a for a in names if a[0] != "-"], [a[1:] for a in names if a[0] == "-"]
    cond = F.arrays_overlap(attributes, F.array(*map(F.lit, want))) if want else F.lit(True)
    return x.where(cond & ~F.arrays_overlap(attributes, F.array(*map(F.lit, avoid))) if avoid else cond)


def mask_low_quality(g: DataFrame, quality: DataFrame, least: float, most: float) -> DataFrame:
    """Calls whose score is outside the window become missing; calls without a score stay."""
    x = g.join(quality.select("sample_id", "vid", "score"), ["sample_id", "vid"], "left")
    out = F.col("score").isNotNull() & ~F.col("score").between(least, most)
    return x.select("sample_id", "vid", F.when(~out, F.col("dosage")).alias("dosage"))


def thin(x: DataFrame, key: str, share: float, seed: int = 1) -> DataFrame:
    """A share of the keys, by hash: the same ones every time."""
    return x.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000))


def floor_quantile(x: DataFrame, column: str, q: float) -> DataFrame:
    """One row: the value at index floor(q * n) of the sorted column, found by counts of distinct values."""
    counts = x.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    at = F.least(F.floor(F.lit(q) * F.col("total")), F.col("total") - 1)
    upto = running(in_ranges(counts, column), [column], {"upto": ("sum", F.col("n"))})
    return upto.crossJoin(F.broadcast(total)).where(F.col("upto") > at).agg(F.min(column).alias("cut"))


def low_values(num: DataFrame, q: float) -> DataFrame:
    """Attributes with some value at or above the q quantile of all values."""
    cut = floor_quantile(num, "value", q)
    top = num.groupBy("attr_id").agg(F.max("value").alias("top")).crossJoin(F.broadcast(cut)).where("top >= cut")
    return num.join(top.select("attr_id"), "attr_id", "left_semi")


def low_variance(num: DataFrame, q: float) -> DataFrame:
    """attr_id, var: attributes whose variance is at or above the q quantile of the variances."""
    v = num.groupBy("attr_id").agg(F.var_samp("value").alias("var"))
    return v.crossJoin(F.broadcast(floor_quantile(v, "var", q))).where("var >= cut").drop("cut")


def monomorphic(g: DataFrame) -> DataFrame:
    """Variants with one level at most."""
    return g.groupBy("vid").agg(F.count_distinct("dosage").alias("n")).where("n <= 1").select("vid")


def duplicates(x: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return x.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def top_n(scores: DataFrame, n: int, score: str = "score", tie: str = "attribute") -> DataFrame:
    """The n best scores, ties by name."""
    return scores.orderBy(F.desc(score), tie).limit(n)


def pfilter(results: DataFrame, most: float, p: str = "p") -> DataFrame:
    return results.where(F.col(p) <= most)


def rate(a: Column, b: Column) -> Column:
    return div(a, b)


def hwe_exact_filter(g: DataFrame, s: DataFrame, least_p: float, group: str = "UNAFF") -> DataFrame:
    """Variants whose exact Hardy-Weinberg p in a group is at least a bound."""
    from strandflow.functions.stats import hwe_p

    counts = hwe(g, s).where(F.col("grp") == group)
    bad = counts.where(hwe_p(*(F.col(c).cast("double") for c in ("het", "hom1", "hom2"))) < least_p).select("vid")
    return g.join(bad, "vid", "left_anti")


def gene_subset(ranges: DataFrame, names: DataFrame) -> DataFrame:
    """Ranges whose name is listed."""
    return ranges.join(names.select("name").distinct(), "name", "left_semi")
