"""Family-based tests over trios (kid, father, mother) of sample ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.stats import div, n_if

def k_() -> Column:
    """The kid's dosage; p_ and m_ are the parents'."""
    return F.col("k")


def p_() -> Column:
    return F.col("p")


def m_() -> Column:
    return F.col("m")


def trio_calls(g: DataFrame, trios: DataFrame) -> DataFrame:
    """vid, kid, father, mother and their dosages k, p, m; nulls where a parent or a call is missing."""
    kid = g.select("vid", F.col("sample_id").alias("kid"), F.col("dosage").alias("k"))
    x = trios.join(kid, "kid")
    for who, name in (("father", "p"), ("mother", "m")):
        parent = g.select(F.col("vid").alias("pv"), F.col("sample_id").alias("pid"), F.col("dosage").alias(name))
        x = x.join(parent, (F.col(who) == F.col("pid")) & (F.col("vid") == F.col("pv")), "left").drop("pv", "pid")
    return x


def mendel_code(male_x=None):
    """Code of the inconsistency of dosages k, p, m, or 0: 1-2 heterozygous kid, 3-8 homozygous, 9-10 male on X."""
    auto = (
        F.when((k_() == 1) & (p_() == 2) & (m_() == 2), 1)
        .when((k_() == 1) & (p_() == 0) & (m_() == 0), 2)
        .when((k_() == 2) & (p_() == 0) & (m_() == 0), 5)
        .when((k_() == 2) & (p_() == 0), 3)
        .when((k_() == 2) & (m_() == 0), 4)
        .when((k_() == 0) & (p_() == 2) & (m_() == 2), 8)
        .when((k_() == 0) & (p_() == 2), 6)
        .when((k_() == 0) & (m_() == 2), 7)
        .otherwise(0)
    )
    if male_x is None:
        return auto
    return F.when(male_x, F.when((k_() == 0) & (m_() == 2), 9).when((k_() == 2) & (m_() == 0), 10).otherwise(0)).otherwise(auto)


def mendel(g: DataFrame, trios: DataFrame) -> DataFrame:
    """vid, kid, code of each inconsistency."""
    return trio_calls(g, trios).withColumn("code", mendel_code()).where("code > 0").select("vid", "kid", "code")


def mendel_clean(g: DataFrame, trios: DataFrame) -> DataFrame:
    """Calls that take part in an inconsistency become missing: of the kid, and of the parents that the code names."""
    x = trio_calls(g, trios).withColumn("code", mendel_code()).where("code > 0")
    who = F.when(F.col("code").isin(1, 2), F.array("kid", "father", "mother")).when(F.col("code").isin(3, 6), F.array("kid", "father")).when(F.col("code").isin(4, 7, 9, 10), F.array("kid", "mother")).otherwise(F.array("kid"))
    bad = x.select("vid", F.explode(who).alias("sample_id")).distinct().withColumn("bad", F.lit(True))
    return g.join(bad, ["vid", "sample_id"], "left").select("sample_id", "vid", F.when(F.col("bad").isNull(), F.col("dosage")).alias("dosage"))


def transmissions(g: DataFrame, trios: DataFrame, s: DataFrame) -> DataFrame:
    """Rows with t and u, and tp, up, tm, um by parent: what het parents of affected kids pass on, consistent trios only.

    Two het parents of a het kid transmit one allele each, which counts half for either parent.
    """
    x = trio_calls(g, trios.join(s.where("aff").select(F.col("sample_id").alias("kid")), "kid")).where("k is not null and p is not null and m is not null").where(mendel_code() == 0)
    hp, hm = (p_() == 1).cast("int"), (m_() == 1).cast("int")
    both = (k_() == 1) & (p_() == 1) & (m_() == 1)
    one = lambda het, other: F.when(het == 0, 0.0).when(k_() == 2, 1.0).when(k_() == 0, 0.0).when(both, 0.5).when(other == 0, 1.0).otherwise(0.0)
    x = x.withColumn("tp", one(hp, m_())).withColumn("tm", one(hm, p_())).withColumn("up", hp - F.col("tp")).withColumn("um", hm - F.col("tm"))
    return x.where((p_() == 1) | (m_() == 1)).select("vid", "kid", "tp", "up", "tm", "um")


def tdt(g: DataFrame, trios: DataFrame, s: DataFrame) -> DataFrame:
    """vid, t, u, odds_ratio, chisq."""
    x = transmissions(g, trios, s).groupBy("vid").agg(F.sum(F.col("tp") + F.col("tm")).alias("t"), F.sum(F.col("up") + F.col("um")).alias("u"))
    t, u = F.col("t"), F.col("u")
    return x.select("vid", "t", "u", div(t, u).alias("odds_ratio"), div((t - u) ** 2, t + u).alias("chisq"))


def poo(g: DataFrame, trios: DataFrame, s: DataFrame) -> DataFrame:
    """Transmissions by parent, chi-squares, and Z of the difference of the log odds."""
    x = transmissions(g, trios, s).groupBy("vid").agg(*(F.sum(c).alias(c) for c in ("tp", "up", "tm", "um")))
    tp, up, tm, um = (F.col(c) for c in ("tp", "up", "tm", "um"))
    ok = (tp > 0) & (up > 0) & (tm > 0) & (um > 0)
    z = F.when(ok, (F.log(tp / up) - F.log(tm / um)) / F.sqrt(1 / tp + 1 / up + 1 / tm + 1 / um))
    return x.select("vid", "tp", "up", "tm", "um", div((tp - up) ** 2, tp + up).alias("chisq_pat"), div((tm - um) ** 2, tm + um).alias("chisq_mat"), z.alias("z"))


def pseudo_controls(g: DataFrame, trios: DataFrame) -> DataFrame:
    """vid, kid, case, control: the kid's dosage and that of the alleles the parents kept."""
    x = trio_calls(g, trios).where("k is not null and p is not null and m is not null").where(mendel_code() == 0)
    return x.select("vid", "kid", k_().alias("case"), (p_() + m_() - k_()).alias("control"))


def parent_tdt(g: DataFrame, trios: DataFrame, s: DataFrame) -> DataFrame:
    """vid, chisq of affected against unaffected parents of discordant couples."""
    aff = s.select(F.col("sample_id").alias("id"), F.col("aff"))
    couples = trios.select("father", "mother").distinct().join(aff.withColumnsRenamed({"id": "father", "aff": "fa"}), "father").join(aff.withColumnsRenamed({"id": "mother", "aff": "ma"}), "mother").where("fa <> ma")
    x = couples.join(g.select("vid", F.col("sample_id").alias("father"), F.col("dosage").alias("p")), "father").join(g.select("vid", F.col("sample_id").alias("mother"), F.col("dosage").alias("m")), ["mother", "vid"]).where("p is not null and m is not null")
    case, control = F.when(F.col("fa"), p_()).otherwise(m_()), F.when(F.col("fa"), m_()).otherwise(p_())
    x = x.groupBy("vid").agg(F.sum(F.greatest(case - control, F.lit(0))).alias("b"), F.sum(F.greatest(control - case, F.lit(0))).alias("c"))
    return x.select("vid", "b", "c", div((F.col("b") - F.col("c")) ** 2, F.col("b") + F.col("c")).alias("chisq"))


def sibship_test(g: DataFrame, s: DataFrame) -> DataFrame:
    """vid, chisq over sibships (cluster): observed less expected dosage of affected sibs, squared, over its variance."""
    d = F.col("dosage").cast("double")
    x = g.where("dosage is not null").join(s.select("sample_id", "aff", F.col("cluster").alias("sib")), "sample_id").groupBy("vid", "sib").agg(F.count("*").cast("double").alias("n"), n_if(F.col("aff")).cast("double").alias("a"), F.sum(d).alias("t"), F.sum(F.when(F.col("aff"), d).otherwise(0.0)).alias("obs"), F.coalesce(F.var_pop(d), F.lit(0.0)).alias("v"))
    n, a = F.col("n"), F.col("a")
    x = x.where((n > 1) & (a > 0) & (a < n)).groupBy("vid").agg(F.sum(F.col("obs") - a * F.col("t") / n).alias("diff"), F.sum(a * (n - a) / (n - 1) * F.col("v")).alias("var"))
    return x.select("vid", div(F.col("diff") ** 2, F.col("var")).alias("chisq"))


def qfam_parts(g: DataFrame, trios: DataFrame) -> DataFrame:
    """vid, kid, between, within: the parents' mean dosage, and the kid's less it."""
    x = trio_calls(g, trios).where("k is not null and p is not null and m is not null")
    mean = (p_() + m_()) / 2.0
    return x.select("vid", "kid", mean.alias("between"), (k_() - mean).alias("within"))


def qfam(g: DataFrame, trios: DataFrame, s: DataFrame, part: str = "within") -> DataFrame:
    """vid, n, beta, t of the phenotype on the within or between part, by moments."""
    x = qfam_parts(g, trios).join(s.select(F.col("sample_id").alias("kid"), "pheno"), "kid").groupBy("vid").agg(F.count("*").alias("n"), F.var_samp(part).alias("vx"), F.var_samp("pheno").alias("vy"), F.covar_samp(part, "pheno").alias("c"))
    beta = div(F.col("c"), F.col("vx"))
    var = div(div(F.col("vy"), F.col("vx")) - beta * beta, F.col("n") - 2)
    return x.select("vid", "n", beta.alias("beta"), div(beta, F.sqrt(F.when(var > 0, var))).alias("t"))


def ancestors(s: DataFrame, most: int = 12) -> DataFrame:
    """iid, ancestor, meioses: by repeated joins on the parents until no new pairs appear or ``most`` is reached."""
    up = s.select("fid", "iid", F.explode(F.array("pat", "mat")).alias("ancestor")).where("ancestor <> '0'").distinct()
    out, step = up.withColumn("meioses", F.lit(1)), up
    for k in range(2, most + 1):
        step = step.withColumnRenamed("ancestor", "mid").join(up.select("fid", F.col("iid").alias("mid"), "ancestor"), ["fid", "mid"]).select("fid", "iid", "ancestor").distinct()
        if not step.limit(1).count():
            break
        out = out.unionByName(step.withColumn("meioses", F.lit(k)))
    return out
