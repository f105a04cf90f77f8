"""Association tests in closed form: one aggregation of conditional counts, then expressions.

``g`` is (sample_id, vid, dosage); ``s`` has sample_id, aff (boolean), pheno (double), cluster, sex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.stats import chi2_sf1, div, n_if, sum_if, upper_tail

def d_() -> Column:
    return F.col("dosage")


def allele_table(g: DataFrame, s: DataFrame, by: tuple[str, ...] = ("vid",)) -> DataFrame:
    """Copies of both alleles in cases and controls."""
    x = g.where(d_().isNotNull()).join(s.select("sample_id", "aff", *(c for c in by if c != "vid")), "sample_id")
    aff = F.col("aff")
    return x.groupBy(*by).agg(sum_if(aff, d_()).cast("long").alias("a1_aff"), sum_if(aff, 2 - d_()).cast("long").alias("a2_aff"), sum_if(~aff, d_()).cast("long").alias("a1_unaff"), sum_if(~aff, 2 - d_()).cast("long").alias("a2_unaff"))


def _chisq_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    return div((a + b + c + d) * (a * d - b * c) ** 2, (a + b) * (c + d) * (a + c) * (b + d))


def allelic(g: DataFrame, s: DataFrame, by: tuple[str, ...] = ("vid",), z: float = 1.959964) -> DataFrame:
    """Allelic chi-square, odds ratio, its standard error and confidence bounds."""
    x = allele_table(g, s, by)
    a, b, c, d = (F.col(k).cast("double") for k in ("a1_aff", "a2_aff", "a1_unaff", "a2_unaff"))
    ratio = div(a * d, b * c)
    se = F.when((a > 0) & (b > 0) & (c > 0) & (d > 0), F.sqrt(div(F.lit(1), a) + div(F.lit(1), b) + div(F.lit(1), c) + div(F.lit(1), d)))
    x = x.select("*", div(a, a + b).alias("f_a"), div(c, c + d).alias("f_u"), _chisq_2x2(a, b, c, d).alias("chisq"), ratio.alias("odds_ratio"), se.alias("se"))
    return x.withColumn("p", chi2_sf1(F.col("chisq"))).withColumn("l95", F.exp(F.log("odds_ratio") - z * F.col("se"))).withColumn("u95", F.exp(F.log("odds_ratio") + z * F.col("se")))


def genotype_table(g: DataFrame, s: DataFrame) -> DataFrame:
    """Genotype counts in cases (a2, a1, a0 by dosage) and controls (u2, u1, u0)."""
    aff = F.col("aff")
    x = g.where(d_().isNotNull()).join(s.select("sample_id", "aff"), "sample_id")
    return x.groupBy("vid").agg(*(n_if(c & (d_() == k)).alias(f"{n}{k}") for n, c in (("a", aff), ("u", ~aff)) for k in (2, 1, 0)))


def model_tests(g: DataFrame, s: DataFrame, cell: int = 5) -> DataFrame:
    """vid, test, chisq, df for GENO, TREND, ALLELIC, DOM and REC; GENO, DOM and REC need every cell to have ``cell``."""
    x = genotype_table(g, s)
    a2, a1, a0, u2, u1, u0 = (F.col(k).cast("double") for k in ("a2", "a1", "a0", "u2", "u1", "u0"))
    A, U = a2 + a1 + a0, u2 + u1 + u0
    T, n2, n1 = A + U, a2 + u2, a1 + u1
    trend = (U / T * a1 - A / T * u1) + 2 * (U / T * a2 - A / T * u2)
    var = A * U * (T * (n1 + 4 * n2) - (n1 + 2 * n2) ** 2) / (T * T * T)

    def table(*pairs):
        out = F.lit(0.0)
        for obs_a, obs_u in pairs:
            for obs, row in ((obs_a, A), (obs_u, U)):
                expected = row * (obs_a + obs_u) / T
                out = out + div((obs - expected) ** 2, expected)
        return out

    enough = lambda *cells: F.least(*cells) >= cell
    rows = [
        ("GENO", F.when(enough(a2, a1, a0, u2, u1, u0), table((a2, u2), (a1, u1), (a0, u0))), 2),
        ("TREND", div(trend * trend, var), 1),
        ("ALLELIC", _chisq_2x2(2 * a2 + a1, 2 * a0 + a1, 2 * u2 + u1, 2 * u0 + u1), 1),
        ("DOM", F.when(enough(a2 + a1, a0, u2 + u1, u0), _chisq_2x2(a2 + a1, a0, u2 + u1, u0)), 1),
        ("REC", F.when(enough(a2, a1 + a0, u2, u1 + u0), _chisq_2x2(a2, a1 + a0, u2, u1 + u0)), 1),
    ]
    tests = F.array(*(F.struct(F.lit(n).alias("test"), c.alias("chisq"), F.lit(k).alias("df")) for n, c, k in rows))
    return x.where(F.lit(True)).select("vid", F.explode(tests).alias("t")).select("vid", "t.*")


def fisher(g: DataFrame, s: DataFrame) -> DataFrame:
    """Allele counts with the exact two-sided p."""
    from strandflow.functions.stats import fisher_p

    x = allele_table(g, s)
    return x.withColumn("p", fisher_p(*(F.col(c).cast("double") for c in ("a1_aff", "a2_aff", "a1_unaff", "a2_unaff"))))


def moments(g: DataFrame, s: DataFrame, by: tuple[str, ...] = ("vid",)) -> DataFrame:
    """n, variances and covariance (n - 1) of dosage and phenotype."""
    x = g.where(d_().isNotNull()).join(s.where("pheno is not null").select("sample_id", "pheno", *(c for c in by if c != "vid")), "sample_id")
    d = d_().cast("double")
    return x.groupBy(*by).agg(F.count("*").alias("nanal"), F.var_samp(d).alias("vg"), F.var_samp("pheno").alias("vy"), F.covar_samp(d, F.col("pheno")).alias("cov"))


def _slope(n: Column, vg: Column, vy: Column, cov: Column) -> tuple[Column, Column]:
    beta = div(cov, vg)
    return beta, div(div(vy, vg) - div(cov * cov, vg * vg), n - 2)


def quantitative(g: DataFrame, s: DataFrame) -> DataFrame:
    """vid, nanal, beta, se, r2, t of the regression of the phenotype on the dosage."""
    x = moments(g, s)
    n, vg, vy, cov = (F.col(c).cast("double") for c in ("nanal", "vg", "vy", "cov"))
    beta, var = _slope(n, vg, vy, cov)
    se = F.when(var > 0, F.sqrt(var))
    return x.select("vid", "nanal", beta.alias("beta"), se.alias("se"), div(cov * cov, vg * vy).alias("r2"), div(beta, se).alias("t"))


def qt_means(g: DataFrame, s: DataFrame) -> DataFrame:
    """vid, dosage, n, freq, mean, sd of the phenotype by genotype."""
    x = g.where(d_().isNotNull()).join(s.where("pheno is not null").select("sample_id", "pheno"), "sample_id").groupBy("vid", "dosage").agg(F.count("*").alias("n"), F.avg("pheno").alias("mean"), F.stddev_samp("pheno").alias("sd"))
    return x.withColumn("freq", div(F.col("n"), F.sum("n").over(Window.partitionBy("vid"))))


def cmh(g: DataFrame, s: DataFrame) -> DataFrame:
    """vid, chisq, or_mh, se over 2 x 2 x K tables: the clusters' tables, then their sums."""
    x = allele_table(g, s, ("vid", "cluster"))
    a, b, c, d = (F.col(k).cast("double") for k in ("a1_aff", "a2_aff", "a1_unaff", "a2_unaff"))
    n = a + b + c + d
    parts = {
        "diff": a - div((a + b) * (a + c), n),
        "var": div((a + b) * (c + d) * (a + c) * (b + d), n * n * (n - 1)),
        "r": div(a * d, n),
        "s": div(b * c, n),
        "v1": div((a + d) * a * d, n * n),
        "v2": div((b + c) * b * c, n * n),
        "v3": div((a + d) * b * c + (b + c) * a * d, n * n),
    }
    x = x.where(n >= 2).groupBy("vid").agg(*(F.sum(e).alias(k) for k, e in parts.items()))
    se = F.sqrt(div(F.col("v1"), 2 * F.col("r") ** 2) + div(F.col("v2"), 2 * F.col("s") ** 2) + div(F.col("v3"), 2 * F.col("r") * F.col("s")))
    return x.select("vid", div(F.col("diff") ** 2, F.col("var")).alias("chisq"), div(F.col("r"), F.col("s")).alias("or_mh"), se.alias("se"))


def breslow_day(g: DataFrame, s: DataFrame) -> DataFrame:
    """vid, bd, df: whether the clusters' odds ratios agree with the common one."""
    x = allele_table(g, s, ("vid", "cluster")).join(cmh(g, s).select("vid", "or_mh"), "vid").where("or_mh is not null")
    a, b, c, d, r = (F.col(k).cast("double") for k in ("a1_aff", "a2_aff", "a1_unaff", "a2_unaff", "or_mh"))
    row, col, n = a + b, a + c, a + b + c + d
    # The expected count solves a quadratic whose cross product is the common odds ratio.
    p, q, k = 1 - r, n - row - col + r * (row + col), -r * row * col
    root = F.when(F.abs(p) < 1e-12, div(-k, q)).otherwise(div(-q + F.sqrt(F.greatest(q * q - 4 * p * k, F.lit(0.0))), 2 * p))
    e = F.col("e")
    var = div(F.lit(1), div(F.lit(1), e) + div(F.lit(1), row - e) + div(F.lit(1), col - e) + div(F.lit(1), n - row - col + e))
    x = x.where((row > 0) & (col > 0) & (n > row) & (n > col)).withColumn("e", root).where("e > 0").withColumn("term", div((a - e) ** 2, var))
    return x.groupBy("vid").agg(F.sum("term").alias("bd"), (F.count("term") - 1).alias("df"))


def homogeneity(g: DataFrame, s: DataFrame) -> DataFrame:
    """vid, total, assoc, homog, df: the log odds ratios' chi-square in all, of their mean, and of their spread."""
    x = allele_table(g, s, ("vid", "cluster")).where("a1_aff > 0 and a2_aff > 0 and a1_unaff > 0 and a2_unaff > 0")
    a, b, c, d = (F.col(k).cast("double") for k in ("a1_aff", "a2_aff", "a1_unaff", "a2_unaff"))
    x = x.withColumn("l", F.log(a * d / (b * c))).withColumn("w", 1 / (1 / a + 1 / b + 1 / c + 1 / d))
    x = x.groupBy("vid").agg(F.sum(F.col("w") * F.col("l") * F.col("l")).alias("total"), div(F.sum(F.col("w") * F.col("l")) ** 2, F.sum("w")).alias("assoc"), F.count("*").alias("k"))
    return x.select("vid", "total", "assoc", (F.col("total") - F.col("assoc")).alias("homog"), (F.col("k") - 1).alias("df"))


def gxe(g: DataFrame, s: DataFrame, group: str = "sex") -> DataFrame:
    """vid, beta1, beta2, z: whether the regression differs between two groups (1 and 2)."""
    x = moments(g, s.withColumn("grp", F.col(group)), ("vid", "grp"))
    n, vg, vy, cov = (F.col(c).cast("double") for c in ("nanal", "vg", "vy", "cov"))
    beta, var = _slope(n, vg, vy, cov)
    x = x.select("vid", "grp", beta.alias("beta"), var.alias("v"))
    pick = lambda c, k: F.max(F.when(F.col("grp") == k, F.col(c)))
    x = x.groupBy("vid").agg(pick("beta", 1).alias("beta1"), pick("beta", 2).alias("beta2"), pick("v", 1).alias("v1"), pick("v", 2).alias("v2"))
    return x.select("vid", "beta1", "beta2", div(F.col("beta1") - F.col("beta2"), F.sqrt(F.col("v1") + F.col("v2"))).alias("z"))


def loop_assoc(g: DataFrame, s: DataFrame) -> DataFrame:
    """vid, cluster, chisq: each cluster as cases against all others, from one table of counts."""
    t = g.where(d_().isNotNull()).join(s.select("sample_id", "cluster"), "sample_id").groupBy("vid", "cluster").agg(F.sum(d_()).cast("double").alias("x1"), F.sum(2 - d_()).cast("double").alias("x2"))
    w = Window.partitionBy("vid")
    o1, o2 = F.sum("x1").over(w) - F.col("x1"), F.sum("x2").over(w) - F.col("x2")
    return t.select("vid", "cluster", _chisq_2x2(F.col("x1"), F.col("x2"), o1, o2).alias("chisq"))


def profile_score(g: DataFrame, weights: DataFrame, impute: bool = True) -> DataFrame:
    """sample_id, cnt, cnt2, score: mean weight of an allele; a missing call counts with its expectation, or not at all."""
    x = g.join(weights.select("vid", "weight"), "vid")
    if impute:
        d = d_().cast("double")
        mean = g.groupBy("vid").agg(F.avg(d).alias("m"))
        x = x.join(mean, "vid").withColumn("d", F.coalesce(d, F.col("m")))
    else:
        x = x.where(d_().isNotNull()).withColumn("d", d_().cast("double"))
    x = x.where("d is not null").groupBy("sample_id").agg((2 * F.count("*")).alias("cnt"), F.coalesce(F.sum(d_()), F.lit(0)).cast("long").alias("cnt2"), F.sum(F.col("d") * F.col("weight")).alias("sum"))
    return x.select("sample_id", "cnt", "cnt2", div(F.col("sum"), F.col("cnt")).alias("score"))


def profile_ranges(g: DataFrame, weights: DataFrame, ranges: DataFrame) -> DataFrame:
    """A score for each q-range (label, lower, upper) of the weights' q column; the ranges are few."""
    w = weights.join(F.broadcast(ranges), (F.col("q") >= F.col("lower")) & (F.col("q") <= F.col("upper")))
    x = g.where(d_().isNotNull()).join(w.select("vid", "weight", "label"), "vid").groupBy("label", "sample_id").agg((2 * F.count("*")).alias("cnt"), F.sum(d_() * F.col("weight")).alias("sum"))
    return x.select("label", "sample_id", "cnt", div(F.col("sum"), F.col("cnt")).alias("score"))


def meta_analysis(results: DataFrame) -> DataFrame:
    """vid, n, fixed and random effects with z, Q and I2 from studies' (vid, effect, se)."""
    x = results.where("se > 0 and effect is not null").withColumn("w", 1 / (F.col("se") * F.col("se")))
    w, d = F.col("w"), F.col("effect")
    x = x.groupBy("vid").agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * d).alias("swd"), F.collect_list(F.struct("w", F.col("effect").alias("d"))).alias("studies"))
    x = x.withColumn("fixed", div(F.col("swd"), F.col("sw")))
    q = F.aggregate("studies", F.lit(0.0), lambda a, s: a + s["w"] * (s["d"] - F.col("fixed")) ** 2)
    x = x.withColumn("q", q)
    tau = F.greatest(F.coalesce(div(F.col("q") - (F.col("n") - 1), F.col("sw") - div(F.col("sww"), F.col("sw"))), F.lit(0.0)), F.lit(0.0))
    x = x.withColumn("tau", tau)
    random = lambda top: F.aggregate("studies", F.lit(0.0), lambda a, s: a + (s["d"] if top else F.lit(1.0)) / (1 / s["w"] + F.col("tau")))
    x = x.withColumn("rd", random(True)).withColumn("rw", random(False))
    i2 = F.least(F.greatest(F.coalesce(100 * div(F.col("q") - (F.col("n") - 1), F.col("q")), F.lit(0.0)), F.lit(0.0)), F.lit(100.0))
    x = x.select("vid", "n", "fixed", (F.col("fixed") * F.sqrt("sw")).alias("z_fixed"), div(F.col("rd"), F.col("rw")).alias("random"), div(F.col("rd"), F.sqrt("rw")).alias("z_random"), "q", i2.alias("i2"))
    return x.withColumn("p_fixed", 2 * upper_tail(F.col("z_fixed"))).withColumn("p_random", 2 * upper_tail(F.col("z_random")))


def set_score(results: DataFrame, sets: DataFrame) -> DataFrame:
    """set_name, n, mean chi-square of its variants."""
    return sets.join(results.where("chisq is not null").select("vid", "chisq"), "vid").groupBy("set_name").agg(F.count("*").alias("n"), F.avg("chisq").alias("mean_chisq"))
