"""Per-variant and per-sample summaries: conditional counts in one aggregation each.

``g`` is (sample_id, vid, dosage), ``s`` has a row for each sample, ``freq`` is (vid, freq, nm).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.stats import div, n_if

def is_(dosage: int) -> Column:
    return F.col("dosage") == dosage


def ploidy(is_x: Column, is_haploid: Column, male: Column) -> Column:
    """Copies that a sample has of a variant."""
    return F.when(is_haploid | (is_x & male), 1).otherwise(2)


def allele_freq(g: DataFrame, by: tuple[str, ...] = ("vid",), copies: Column | None = None) -> DataFrame:
    """Frequency of allele 1 and alleles seen; null where none is.  A haploid call counts half its dosage."""
    copies = F.lit(2) if copies is None else copies
    called = F.when(F.col("dosage").isNotNull(), copies)
    return g.groupBy(*by).agg(F.coalesce(F.sum(F.col("dosage") * copies / 2), F.lit(0.0)).cast("long").alias("a1"), F.coalesce(F.sum(called), F.lit(0)).cast("long").alias("nchrobs")).select(*by, div(F.col("a1"), F.col("nchrobs")).alias("freq"), "nchrobs")


def allele_counts(g: DataFrame) -> DataFrame:
    """vid, c1, c2, g0: copies of both alleles, and missing calls."""
    d = F.col("dosage")
    return g.groupBy("vid").agg(F.coalesce(F.sum(d), F.lit(0)).cast("long").alias("c1"), F.coalesce(F.sum(2 - d), F.lit(0)).cast("long").alias("c2"), n_if(d.isNull()).alias("g0"))


def freq_by_cluster(g: DataFrame, s: DataFrame) -> DataFrame:
    """vid, cluster, maf, mac, nchrobs."""
    d = F.col("dosage")
    x = g.join(s.select("sample_id", "cluster"), "sample_id").groupBy("vid", "cluster").agg(F.coalesce(F.sum(d), F.lit(0)).cast("long").alias("mac"), (2 * F.count(d)).cast("long").alias("nchrobs"))
    return x.select("vid", "cluster", div(F.col("mac"), F.col("nchrobs")).alias("maf"), "mac", "nchrobs")


def hwe(g: DataFrame, s: DataFrame) -> DataFrame:
    """vid, grp (ALL, AFF, UNAFF), genotype counts, observed and expected heterozygosity, chi-square: by grouping sets."""
    x = g.join(s.select("sample_id", "aff"), "sample_id")
    x = x.groupingSets([["vid"], ["vid", "aff"]], "vid", "aff").agg(n_if(is_(2)).alias("hom1"), n_if(is_(1)).alias("het"), n_if(is_(0)).alias("hom2"), F.grouping("aff").alias("whole"))
    x = x.withColumn("grp", F.when(F.col("whole") == 1, "ALL").when(F.col("aff"), "AFF").otherwise("UNAFF"))
    n = (F.col("hom1") + F.col("het") + F.col("hom2")).cast("double")
    p = div(2 * F.col("hom1") + F.col("het"), 2 * n)
    q = 1 - p
    chisq = div((F.col("hom1") - n * p * p) ** 2, n * p * p) + div((F.col("het") - 2 * n * p * q) ** 2, 2 * n * p * q) + div((F.col("hom2") - n * q * q) ** 2, n * q * q)
    return x.select("vid", "grp", "hom1", "het", "hom2", div(F.col("het"), n).alias("o_het"), (2 * p * q).alias("e_het"), chisq.alias("chisq"))


def missing_by(g: DataFrame, key: str) -> DataFrame:
    """n_miss, n_geno, f_miss by sample or variant."""
    miss = n_if(F.col("dosage").isNull())
    return g.groupBy(key).agg(miss.alias("n_miss"), F.count("*").alias("n_geno")).withColumn("f_miss", div(F.col("n_miss"), F.col("n_geno")))


def missing_case_control(g: DataFrame, s: DataFrame) -> DataFrame:
    """vid, missing and called in cases and controls, rates: the 2x2 table of missingness and affection."""
    gone, aff = F.col("dosage").isNull(), F.col("aff")
    x = g.join(s.select("sample_id", "aff"), "sample_id").groupBy("vid").agg(n_if(gone & aff).alias("miss_a"), n_if(~gone & aff).alias("call_a"), n_if(gone & ~aff).alias("miss_u"), n_if(~gone & ~aff).alias("call_u"))
    return x.withColumn("f_miss_a", div(F.col("miss_a"), F.col("miss_a") + F.col("call_a"))).withColumn("f_miss_u", div(F.col("miss_u"), F.col("miss_u") + F.col("call_u")))


def missing_fisher(g: DataFrame, s: DataFrame) -> DataFrame:
    """The table of missingness and affection with its exact two-sided p."""
    from strandflow.functions.stats import fisher_p

    return missing_case_control(g, s).withColumn("p", fisher_p(*(F.col(c).cast("double") for c in ("miss_a", "call_a", "miss_u", "call_u"))))


def heterozygosity(g: DataFrame) -> DataFrame:
    """sample_id, o_hom, e_hom, n, f: inbreeding from the excess of homozygous calls at polymorphic variants."""
    f = allele_freq(g).where("nchrobs > 1 and freq > 1e-8 and freq < 1 - 1e-8")
    nm, p = F.col("nchrobs").cast("double"), F.col("freq")
    expected = 1 - 2 * p * (1 - p) * nm / (nm - 1)
    x = g.where("dosage is not null").join(f.select("vid", expected.alias("e")), "vid").groupBy("sample_id").agg(n_if(F.col("dosage") != 1).alias("o_hom"), F.sum("e").alias("e_hom"), F.count("*").alias("n"))
    return x.withColumn("f", div(F.col("o_hom") - F.col("e_hom"), F.col("n") - F.col("e_hom")))


def sex_check(g: DataFrame, v: DataFrame, s: DataFrame, x_code: int, female: float = 0.2, male: float = 0.8) -> DataFrame:
    """sample_id, pedsex, snpsex, status, f: sex by the inbreeding of X calls."""
    on_x = g.join(v.where(F.col("chr") == x_code).select("vid"), "vid", "left_semi")
    snp = F.when(F.col("f") > male, 1).when(F.col("f") < female, 2).otherwise(0)
    x = s.select("sample_id", F.col("sex").alias("pedsex")).join(heterozygosity(on_x).select("sample_id", "f"), "sample_id", "left").withColumn("snpsex", snp)
    return x.select("sample_id", "pedsex", "snpsex", F.when((F.col("snpsex") != 0) & (F.col("snpsex") == F.col("pedsex")), "OK").otherwise("PROBLEM").alias("status"), "f")


def fst(g: DataFrame, s: DataFrame) -> DataFrame:
    """vid, fst: (total minus mean within-cluster heterozygosity) over total, weighted by alleles seen."""
    x = freq_by_cluster(g, s).where("nchrobs > 0").groupBy("vid").agg(F.sum("mac").alias("a"), F.sum("nchrobs").alias("n"), F.sum(2 * F.col("maf") * (1 - F.col("maf")) * F.col("nchrobs")).alias("h"))
    p = div(F.col("a"), F.col("n"))
    return x.select("vid", div(2 * p * (1 - p) - div(F.col("h"), F.col("n")), 2 * p * (1 - p)).alias("fst"))


def numeric_summary(num: DataFrame, by: str = "attr_id") -> DataFrame:
    """mean, var, sd, cv by attribute or sample."""
    x = num.groupBy(by).agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.stddev_samp("value").alias("sd"))
    return x.withColumn("cv", div(F.col("sd"), F.col("mean")))


def missing_runs(g: DataFrame, order: str = "vid", least: int = 2) -> DataFrame:
    """sample_id, start, stop, n: runs of consecutive missing calls, by gaps and islands."""
    from pyspark.sql import Window

    w = Window.partitionBy("sample_id").orderBy(order)
    x = g.select("sample_id", "dosage", F.col(order).alias("at"), F.row_number().over(w).alias("i")).where("dosage is null")
    island = F.col("i") - F.row_number().over(Window.partitionBy("sample_id").orderBy("i"))
    return x.withColumn("k", island).groupBy("sample_id", "k").agg(F.min("at").alias("start"), F.max("at").alias("stop"), F.count("*").alias("n")).where(F.col("n") >= least).drop("k")


def level_counts(g: DataFrame) -> DataFrame:
    """vid, dosage, n: how often each level occurs (null: missing), and the distinct levels of a variant."""
    return g.groupBy("vid", "dosage").agg(F.count("*").alias("n"))


def class_type(s: DataFrame, column: str, missing: float = -9.0) -> str:
    """case-control, multiclass or continuous, from the values of a phenotype column."""
    x = F.col(column).try_cast("double")
    r = s.where(x.isNotNull() & (x != missing)).agg(F.count_distinct(x).alias("n"), F.bool_and(x == F.floor(x)).alias("whole")).first()
    return "continuous" if not r.whole else "case-control" if r.n <= 2 else "multiclass"


def missing_but_by_design(g: DataFrame, key: str) -> DataFrame:
    """n_miss, n_design, n_geno, f_miss: calls missing by design (``by_design``) count neither as missing nor as tried."""
    design = F.col("by_design")
    x = g.groupBy(key).agg(n_if(F.col("dosage").isNull() & ~design).alias("n_miss"), n_if(design).alias("n_design"), n_if(~design).alias("n_geno"))
    return x.withColumn("f_miss", div(F.col("n_miss"), F.col("n_geno")))


def transitions(v: DataFrame) -> DataFrame:
    """chr, ti, tv, ratio: variants whose alleles are both purines or both pyrimidines, and the others."""
    pair = F.array_join(F.array_sort(F.array(F.upper("a1"), F.upper("a2"))), "")
    known, ti = F.upper("a1").isin(*"ACGT") & F.upper("a2").isin(*"ACGT") & (F.upper("a1") != F.upper("a2")), pair.isin("AG", "CT")
    return v.groupBy("chr").agg(n_if(known & ti).alias("ti"), n_if(known & ~ti).alias("tv")).withColumn("ratio", div(F.col("ti"), F.col("tv")))


def reads_by_sample(counts: DataFrame) -> DataFrame:
    """sample, depth, genes seen, and the most reads of a gene."""
    return counts.groupBy("sample").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("depth"), n_if(F.col("n") > 0).alias("genes"), F.max("n").alias("most"))
