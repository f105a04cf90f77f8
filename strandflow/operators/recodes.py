"""Updates and recodes of alleles, ids, phenotypes and numeric attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.stats import div
from strandflow.operators.summaries import allele_freq


def update(x: DataFrame, new: DataFrame, key: str | list[str], columns: list[str]) -> DataFrame:
    """New values where the list has some, the old ones else."""
    names = {c: f"new_{c}" for c in columns}
    y = x.join(new.select(*([key] if isinstance(key, str) else key), *(F.col(c).alias(n) for c, n in names.items())), key, "left")
    return y.select(*(F.coalesce(names[c], c).alias(c) if c in names else F.col(c) for c in x.columns))


def complement(allele: Column) -> Column:
    """The other strand's allele."""
    return F.translate(allele, "ACGTacgt1234", "TGCAtgca4321")


def to_numbers(allele: Column) -> Column:
    return F.translate(allele, "ACGT", "1234")


def to_letters(allele: Column) -> Column:
    return F.translate(allele, "1234", "ACGT")


def flip_strand(v: DataFrame, names: DataFrame) -> DataFrame:
    """Variants of the list with both alleles complemented."""
    hit = names.select("name").distinct().withColumn("flip", F.lit(True))
    y = v.join(hit, "name", "left")
    return y.select(*(F.when(F.col("flip"), complement(F.col(c))).otherwise(F.col(c)).alias(c) if c in ("a1", "a2") else F.col(c) for c in v.columns))


def reference_allele(g: DataFrame, v: DataFrame, refs: DataFrame) -> DataFrame:
    """Dosages of the listed allele: turned over where it is the variant's second."""
    turned = v.join(refs.select("name", F.col("allele").alias("ref")), "name").where("ref = a2").select("vid").withColumn("turn", F.lit(True))
    return _turn(g, turned)


def minor_first(g: DataFrame) -> DataFrame:
    """Dosages of the rarer allele."""
    return _turn(g, allele_freq(g).where("freq > 0.5").select("vid").withColumn("turn", F.lit(True)))


def _turn(g: DataFrame, turned: DataFrame) -> DataFrame:
    return g.join(turned, "vid", "left").select("sample_id", "vid", F.when(F.col("turn"), 2 - F.col("dosage")).otherwise(F.col("dosage")).alias("dosage"))


def clean_haploid(g: DataFrame, v: DataFrame, s: DataFrame) -> DataFrame:
    """Heterozygous calls of haploid variants, and any Y calls of females, become missing.  v has is_x, is_y, is_haploid."""
    x = g.join(v.select("vid", "is_x", "is_y", "is_haploid"), "vid").join(s.select("sample_id", "sex"), "sample_id")
    male = F.col("sex") == 1
    bad = ((F.col("is_haploid") | (F.col("is_x") & male)) & (F.col("dosage") == 1)) | (F.col("is_y") & ~male)
    return x.select("sample_id", "vid", F.when(~F.coalesce(bad, F.lit(False)), F.col("dosage")).alias("dosage"))


def zero_cluster(g: DataFrame, s: DataFrame, zero: DataFrame) -> DataFrame:
    """Calls of (vid, cluster) pairs become missing."""
    x = g.join(s.select("sample_id", "cluster"), "sample_id").join(zero.select("vid", "cluster").distinct().withColumn("z", F.lit(True)), ["vid", "cluster"], "left")
    return x.select("sample_id", "vid", F.when(F.col("z").isNull(), F.col("dosage")).alias("dosage"))


def affection(pheno: Column, zero_one: bool = False, missing: float = -9.0) -> Column:
    """Case: 2 (or 1 with 0/1 coding); null where missing, or 0 without it."""
    known = (pheno != missing) if zero_one else (pheno != missing) & (pheno != 0)
    return F.when(known, pheno == (1 if zero_one else 2))


def centre(num: DataFrame) -> DataFrame:
    m = num.groupBy("attr_id").agg(F.avg("value").alias("m"))
    return num.join(m, "attr_id").select("sample_id", "attr_id", (F.col("value") - F.col("m")).alias("value"))


def standardise(num: DataFrame) -> DataFrame:
    """(value - mean) / sd by attribute; an attribute that doesn't vary is only centred."""
    m = num.groupBy("attr_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return num.join(m, "attr_id").select("sample_id", "attr_id", ((F.col("value") - F.col("m")) / sd).alias("value"))


def dummy_coding(s: DataFrame, column: str, levels: list) -> DataFrame:
    """One 0/1 column for each level but the first."""
    return s.select("*", *(F.when(F.col(column) == x, 1).otherwise(0).alias(f"{column}_{x}") for x in levels[1:]))


def make_phenotype(s: DataFrame, labels: DataFrame, value: str | None) -> DataFrame:
    """Cases: samples whose label is ``value`` (None: that are listed at all); controls: the others."""
    hit = labels if value is None else labels.where(F.col("label") == value)
    return s.join(hit.select("sample_id").distinct().withColumn("hit", F.lit(True)), "sample_id", "left").withColumn("pheno", F.when(F.col("hit"), 2.0).otherwise(1.0)).drop("hit")


def make_founders(s: DataFrame) -> DataFrame:
    """Founders: samples neither of whose parents is in the table."""
    ids = s.select("fid", F.col("iid").alias("p")).distinct()
    for c in ("pat", "mat"):
        s = s.join(ids.withColumnsRenamed({"fid": "pf"}), (s.fid == F.col("pf")) & (F.col(c) == F.col("p")), "left").withColumn(f"has_{c}", F.col("p").isNotNull()).drop("pf", "p")
    return s.withColumn("founder", ~F.col("has_pat") & ~F.col("has_mat")).drop("has_pat", "has_mat")


def missing_parents(s: DataFrame) -> DataFrame:
    """fid, iid, sex of parents that are named but have no row."""
    named = s.where("pat <> '0'").select("fid", F.col("pat").alias("iid"), F.lit(1).alias("sex")).unionByName(s.where("mat <> '0'").select("fid", F.col("mat").alias("iid"), F.lit(2).alias("sex"))).distinct()
    return named.join(s.select("fid", "iid"), ["fid", "iid"], "left_anti")


def recode_additive(g: DataFrame, vids: list[int], dominance: bool = False) -> DataFrame:
    """A column of dosages for each variant, and one of heterozygotes if asked for."""
    x = g.groupBy("sample_id").pivot("vid", vids).agg(F.first("dosage"))
    out = [F.col("sample_id")]
    for v in vids:
        out.append(F.col(f"`{v}`").alias(f"v{v}"))
        if dominance:
            out.append(F.when(F.col(f"`{v}`").isNotNull(), (F.col(f"`{v}`") == 1).cast("int")).alias(f"v{v}_het"))
    return x.select(*out)


def split_groups(s: DataFrame, by: str = "cls", parts: int = 3) -> DataFrame:
    """part: 0 (train), 1 (holdout), 2 (test), dealt within each class in an order of hashed ids."""
    w = Window.partitionBy(by).orderBy(F.xxhash64("id"), "id")
    return s.withColumn("part", ((F.row_number().over(w) - 1) % parts).cast("int"))


def genotype_text(dosage: Column, a1: Column, a2: Column) -> Column:
    """Both alleles with a blank between; 0 0 where missing."""
    return F.when(dosage == 2, F.concat_ws(" ", a1, a1)).when(dosage == 1, F.concat_ws(" ", a1, a2)).when(dosage == 0, F.concat_ws(" ", a2, a2)).otherwise("0 0")


def share(a: Column, b: Column) -> Column:
    return div(a, b)


def obligatory_missing(g: DataFrame, s: DataFrame, blocks: DataFrame) -> DataFrame:
    """Calls with a flag: those of (vid, cluster) pairs that were never typed are missing by design."""
    x = g.join(s.select("sample_id", "cluster"), "sample_id").join(blocks.select("vid", "cluster").distinct().withColumn("hit", F.lit(True)), ["vid", "cluster"], "left")
    by_design = F.coalesce("hit", F.lit(False))
    return x.select("sample_id", "vid", F.when(~by_design, F.col("dosage")).alias("dosage"), by_design.alias("by_design"))
