"""Readers of the text formats, as DataFrames over ``spark.read.text`` and ``csv``; compressed files are read as they are.

White space separates fields; a line may begin with some.  Long tables come out: genotypes (fid, iid, name, a, b) with
alleles as text, null for missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MISSING = "-9"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with something on them, as arrays of fields."""
    x = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"[\s]+", " ")).alias("value")).where("value <> ''")
    return x.select(F.split("value", " ").alias("f"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number in the file: read as one text, so for side files that say an order (maps, lists)."""
    x = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", "\n"), lambda s: F.trim(F.regexp_replace(s, r"[\s]+", " "))), lambda s: s != "")).alias("idx", "line"))
    return x.select("idx", F.split("line", " ").alias("f"))


def _f(i: int) -> Column:
    return F.element_at("f", i)


def _cells(x: DataFrame, heads: dict[str, Column], cells: Column) -> DataFrame:
    """The heads of a line, idx and c for each of its cells, ahead of a join.

    Heads are taken first, or each cell's row would carry all fields of its line; ``posexplode`` of a column would add a filter
    that splits the line again for each cell, the outer form adds none.  The optimiser would judge the cells by their file,
    which may be compressed, and broadcast them all.
    """
    each = x.select(*(c.alias(k) for k, c in heads.items()), cells.alias("cells"))
    return each.select(*heads, F.posexplode_outer("cells").alias("idx", "c")).hint("merge")


def _allele(c: Column, missing: str = "0") -> Column:
    return F.when(c != missing, c)


def _number(c: Column) -> Column:
    return c.try_cast("double")


def fam(spark: SparkSession, path: str, missing: str = MISSING) -> DataFrame:
    """fid, iid, pat, mat, sex (null unless 1 or 2), pheno (null where missing)."""
    sex, p = _f(5).try_cast("int"), _number(_f(6))
    return lines(spark, path).select(_f(1).alias("fid"), _f(2).alias("iid"), _f(3).alias("pat"), _f(4).alias("mat"), F.when(sex.isin(1, 2), sex).alias("sex"), F.when(p != float(missing), p).alias("pheno"))


def trait(samples: DataFrame) -> str:
    """Whether the phenotype is a disease (only 0, 1, 2 and missing) or quantitative."""
    return "quantitative" if samples.where("pheno is not null and pheno not in (0, 1, 2)").limit(1).count() else "disease"


def map_file(spark: SparkSession, path: str, three: bool = False) -> DataFrame:
    """idx, chr, name, cm, bp, use: in file order; a negative position takes a variant out."""
    x = numbered(spark, path).where(~_f(1).startswith("#"))
    bp = _f(3 if three else 4).cast("int")
    w = Window.orderBy("idx")
    return x.select((F.row_number().over(w) - 1).alias("idx"), _f(1).alias("chr"), _f(2).alias("name"), (F.lit(0.0) if three else _number(_f(3))).alias("cm"), bp.alias("bp"), (bp >= 0).alias("use"))


def bim(spark: SparkSession, path: str) -> DataFrame:
    x = numbered(spark, path)
    return x.select("idx", _f(1).alias("chr"), _f(2).alias("name"), _number(_f(3)).alias("cm"), _f(4).cast("int").alias("bp"), _f(5).alias("a1"), _f(6).alias("a2"))


def ped(spark: SparkSession, ped_path: str, map_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, variants and long genotypes of a PED and its MAP."""
    variants = map_file(spark, map_path)
    x = lines(spark, ped_path).where(~_f(1).startswith("#"))
    n = F.floor((F.size("f") - 6) / 2).cast("int")
    calls = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("f", 6 + 2 * i).alias("a"), F.get("f", 7 + 2 * i).alias("b")))
    long = _cells(x.where(n > 0), {"fid": _f(1), "iid": _f(2)}, calls)
    g = long.join(variants.where("use").select("idx", "name"), "idx").select("fid", "iid", "name", _allele(F.col("c.a")).alias("a"), _allele(F.col("c.b")).alias("b"))
    return fam(spark, ped_path), variants.where("use").drop("use"), g


def tped(spark: SparkSession, tped_path: str, tfam_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The transposed form: a row for each variant."""
    who = numbered(spark, tfam_path).select("idx", _f(1).alias("fid"), _f(2).alias("iid"))
    x = lines(spark, tped_path)
    variants = x.select(_f(1).alias("chr"), _f(2).alias("name"), _number(_f(3)).alias("cm"), _f(4).cast("int").alias("bp"))
    n = F.floor((F.size("f") - 4) / 2).cast("int")
    calls = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("f", 4 + 2 * i).alias("a"), F.get("f", 5 + 2 * i).alias("b")))
    g = _cells(x.where(n > 0), {"name": _f(2)}, calls).join(who, "idx").select("fid", "iid", "name", _allele(F.col("c.a")).alias("a"), _allele(F.col("c.b")).alias("b"))
    return fam(spark, tfam_path), variants, g


def lgen(spark: SparkSession, path: str, compound: bool = False) -> DataFrame:
    """The long form: FID IID SNP and two alleles, or one field of two letters."""
    a, b = (F.substring(_f(4), 1, 1), F.substring(_f(4), 2, 1)) if compound else (_f(4), _f(5))
    return lines(spark, path).select(_f(1).alias("fid"), _f(2).alias("iid"), _f(3).alias("name"), _allele(a).alias("a"), _allele(b).alias("b"))


def fill_reference(g: DataFrame, samples: DataFrame, reference: DataFrame) -> DataFrame:
    """Calls that a long file leaves out are homozygous for the reference (name, a1[, a2]); a listed missing call stays missing."""
    every = samples.select("fid", "iid").crossJoin(F.broadcast(reference.select("name", F.col("a1").alias("ref"))))
    x = every.join(g.withColumn("listed", F.lit(True)), ["fid", "iid", "name"], "left")
    pick = lambda c: F.when(F.col("listed"), F.col(c)).otherwise(F.col("ref")).alias(c)
    return x.select("fid", "iid", "name", pick("a"), pick("b"))


def to_dosage(g: DataFrame, keep_order: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Variants (name, a1, a2, a1 the rarer; ties by letter) and calls (fid, iid, name, dosage of a1)."""
    each = g.select("name", F.explode(F.array("a", "b")).alias("x")).where("x is not null").groupBy("name", "x").agg(F.count("*").alias("n"))
    if keep_order is None:
        ranked = each.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("l"))
        alleles = ranked.select("name", F.when(F.size("l") > 1, F.element_at("l", 1)["x"]).otherwise("0").alias("a1"), F.element_at("l", -1)["x"].alias("a2"))
    else:
        alleles = keep_order.select("name", "a1", "a2")
    d = (F.col("a") == F.col("a1")).cast("int") + (F.col("b") == F.col("a1")).cast("int")
    return alleles, g.join(alleles, "name").select("fid", "iid", "name", d.alias("dosage"))


def numeric_file(spark: SparkSession, path: str) -> DataFrame:
    """fid, iid, attr_id, attr, value of a file with a header; a field that is no number is null."""
    names = spark.read.text(path).first()["value"].split()[2:]
    x = lines(spark, path).where(F.upper(_f(1)) != "FID")
    x = x.select(_f(1).alias("fid"), _f(2).alias("iid"), F.posexplode(F.slice("f", 3, len(names))).alias("attr_id", "v"))
    return x.select("fid", "iid", "attr_id", F.element_at(F.array(*map(F.lit, names)), F.col("attr_id") + 1).alias("attr"), _number(F.col("v")).alias("value"))


def phenotypes(spark: SparkSession, path: str, missing: str = MISSING) -> DataFrame:
    """fid, iid, column (1 on), name, pheno: every column of a phenotype or covariate file, with or without a header."""
    first = spark.read.text(path).first()["value"].split()
    header = first[0].upper() == "FID"
    names = first[2:] if header else [f"P{i}" for i in range(1, len(first) - 1)]
    x = lines(spark, path)
    x = x.where(F.upper(_f(1)) != "FID") if header else x
    x = x.select(_f(1).alias("fid"), _f(2).alias("iid"), F.posexplode(F.slice("f", 3, len(names))).alias("k", "v"))
    v = _number(F.col("v"))
    return x.select("fid", "iid", (F.col("k") + 1).alias("column"), F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("name"), F.when(v != float(missing), v).alias("pheno"))


def clusters(spark: SparkSession, path: str, column: int = 1) -> DataFrame:
    """fid, iid, label, cluster (numbered by label)."""
    x = lines(spark, path).select(_f(1).alias("fid"), _f(2).alias("iid"), _f(2 + column).alias("label"))
    ids = x.select("label").distinct().withColumn("cluster", F.dense_rank().over(Window.orderBy("label")) - 1)
    return x.join(ids, "label").select("fid", "iid", "label", "cluster")


def sets(spark: SparkSession, path: str) -> DataFrame:
    """set_name, name of a token stream: a name, members, END."""
    tokens = spark.read.text(path, wholetext=True).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), r"(?:^| )END(?: |$)").alias("s"))
    each = tokens.select(F.explode("s").alias("s")).where("trim(s) <> ''").select(F.split(F.trim("s"), " ").alias("m"))
    return each.select(F.element_at("m", 1).alias("set_name"), F.explode(F.slice(F.col("m"), F.lit(2), F.size("m"))).alias("name"))


def range_list(spark: SparkSession, path: str, border_kb: float = 0) -> DataFrame:
    """chr, start, stop, name, grp."""
    b = int(border_kb * 1000)
    return lines(spark, path).select(chromosome(_f(1)).alias("chr"), F.greatest(_f(2).cast("int") - b, F.lit(0)).alias("start"), (_f(3).cast("int") + b).alias("stop"), F.get("f", F.lit(3)).alias("name"), F.get("f", F.lit(4)).alias("grp"))


def chromosome(c: Column, autosomes: int = 22) -> Column:
    """Code of a chromosome's label."""
    up = F.upper(F.regexp_replace(c, "^(?i)chr", ""))
    return F.when(up == "X", autosomes + 1).when(up == "Y", autosomes + 2).when(up == "XY", autosomes + 3).when(up.isin("MT", "M"), autosomes + 4).otherwise(F.coalesce(up.try_cast("int"), F.lit(0)))


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """chr, name, a1, a2, maf, nchrobs of a table with a header."""
    x = lines(spark, path).where(F.upper(_f(2)) != "SNP")
    return x.select(_f(1).alias("chr"), _f(2).alias("name"), _f(3).alias("a1"), _f(4).alias("a2"), F.coalesce(_number(_f(5)), F.lit(0.0)).alias("maf"), _f(6).try_cast("int").alias("nchrobs"))


def read_frequencies(freq: DataFrame, variants: DataFrame) -> DataFrame:
    """Frequencies of the variants' own first allele: 1 - maf where the alleles are swapped, null where they don't fit."""
    f = freq.select("name", F.col("a1").alias("f1"), F.col("a2").alias("f2"), "maf")
    same, swapped = (F.col("a1") == F.col("f1")) & (F.col("a2") == F.col("f2")), (F.col("a1") == F.col("f2")) & (F.col("a2") == F.col("f1"))
    return variants.join(f, "name", "left").select("name", "a1", "a2", F.when(same, F.col("maf")).when(swapped, 1 - F.col("maf")).alias("freq"))


def headed(spark: SparkSession, path: str) -> DataFrame:
    """Any white-space table with a header (results, pair tables, runs), all columns as text."""
    names = spark.read.text(path).first()["value"].split()
    x = lines(spark, path)
    return x.where(_f(1) != names[0]).select(*(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)))


def results(spark: SparkSession, paths: list[str], snp: str = "SNP", p: str = "P") -> DataFrame:
    """file, name, p of association results; rows without a p are out."""
    out = None
    for k, path in enumerate(paths):
        x = headed(spark, path)
        x = x.select(F.lit(k).alias("file"), F.col(snp).alias("name"), _number(F.col(p)).alias("p")).where("p is not null")
        out = x if out is None else out.unionByName(x)
    return out


def cnv_list(spark: SparkSession, path: str) -> DataFrame:
    x = lines(spark, path).where(F.upper(_f(1)) != "FID")
    return x.select(_f(1).alias("fid"), _f(2).alias("iid"), chromosome(_f(3)).alias("chr"), _f(4).cast("int").alias("bp1"), _f(5).cast("int").alias("bp2"), _f(6).cast("int").alias("type"), _number(_f(7)).alias("score"), _f(8).try_cast("int").alias("sites"))


def dosages(spark: SparkSession, path: str, samples: DataFrame, numbers: int = 2, skip: tuple[int, int, int] = (0, 0, 0), header: bool = False) -> DataFrame:
    """fid, iid, name, a1, a2, dose (copies of a1): one number is a dosage, two are P(11) and P(12), three the lot.

    ``samples`` (idx, fid, iid) names the columns in order.
    """
    x = lines(spark, path)
    x = x.where(F.upper(F.get("f", F.lit(skip[0]))) != "SNP") if header else x
    a = skip[0] + 1 + skip[1]
    first = a + 2 + skip[2]
    n = F.floor((F.size("f") - first) / numbers).cast("int")
    value = lambda i, k: F.get("f", first + i * numbers + k).try_cast("double")
    dose = lambda i: value(i, 0) if numbers == 1 else 2 * value(i, 0) + value(i, 1)
    heads = {"name": F.get("f", F.lit(skip[0])), "a1": F.get("f", F.lit(a)), "a2": F.get("f", F.lit(a + 1))}
    x = _cells(x, heads, F.transform(F.sequence(F.lit(0), n - 1), dose)).withColumnRenamed("c", "dose")
    return x.join(samples.select("idx", "fid", "iid"), "idx").drop("idx")


def hard_calls(d: DataFrame, least: float = 0.1) -> DataFrame:
    """Dosages near a whole number as calls, the others as missing."""
    near = F.round("dose")
    return d.withColumn("dosage", F.when(F.abs(F.col("dose") - near) <= least, near.cast("int")))


def dosage_info(d: DataFrame) -> DataFrame:
    """name, freq, info: observed over expected variance of the allele share."""
    x = d.withColumn("x", F.col("dose") / 2).groupBy("name").agg(F.avg("x").alias("freq"), F.var_pop("x").alias("v"))
    return x.select("name", "freq", F.when((F.col("freq") > 0) & (F.col("freq") < 1), 2 * F.col("v") / (F.col("freq") * (1 - F.col("freq")))).alias("info"))


def generic_variants(spark: SparkSession, path: str) -> DataFrame:
    """fid, iid, name, allele1, dose1, allele2, dose2."""
    return lines(spark, path).select(_f(1).alias("fid"), _f(2).alias("iid"), _f(3).alias("name"), _f(4).alias("allele1"), _number(_f(5)).alias("dose1"), _f(6).alias("allele2"), _number(_f(7)).alias("dose2"))


def matrix_file(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """i, j, weight of a named square matrix, full or its upper triangle, with a header (``#`` before it or not)."""
    x = numbered(spark, path)
    names = [n for n in x.where("idx = 0").first()["f"] if n != comment]
    rows = x.where("idx > 0").select((F.col("idx") - 1).alias("r"), "f", F.size("f").alias("k"))
    n = len(names)
    cells = rows.select("r", "k", F.posexplode("f").alias("c", "v")).withColumn("c", F.when(F.col("k") == n, F.col("c")).otherwise(F.col("c") + n - F.col("k")))
    name = F.array(*map(F.lit, names))
    return cells.where("r <= c").select(F.element_at(name, F.col("r").cast("int") + 1).alias("i"), F.element_at(name, F.col("c").cast("int") + 1).alias("j"), _number(F.col("v")).alias("weight"))


def sif(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(_f(1).alias("i"), _f(3).alias("j"), _number(_f(2)).alias("weight"))


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """chr, start, stop, name of transcripts or factors."""
    return lines(spark, path).select(chromosome(_f(1)).alias("chr"), _f(2).cast("int").alias("start"), _f(3).cast("int").alias("stop"), _f(4).alias("name"))


def tag_list(spark: SparkSession, path: str) -> DataFrame:
    """label, members: haplotype tests."""
    return lines(spark, path).select(_f(1).alias("label"), F.slice(F.col("f"), F.lit(2), F.size("f")).alias("members"))


def instances(spark: SparkSession, path: str, class_column: str = "class", sep: str = "\t") -> DataFrame:
    """id, cls, values of a delimited machine-learning table whose other columns are attributes."""
    x = spark.read.csv(path, sep=sep, header=True)
    attributes = [c for c in x.columns if c != class_column]
    return x.select(F.monotonically_increasing_id().alias("id"), F.col(class_column).cast("int").alias("cls"), F.array(*(F.col(c).try_cast("double") for c in attributes)).alias("values"))


def runs_of_homozygosity(spark: SparkSession, path: str) -> DataFrame:
    """fid, iid, chr, bp1, bp2, n of a table of runs with a header (columns by name, whatever their order)."""
    x = headed(spark, path)
    return x.select(F.col("FID").alias("fid"), F.col("IID").alias("iid"), chromosome(F.col("CHR")).alias("chr"), F.col("POS1").cast("int").alias("bp1"), F.col("POS2").cast("int").alias("bp2"), F.col("NSNP").cast("int").alias("n"))


def shared_segments(spark: SparkSession, path: str) -> DataFrame:
    """fid1, iid1, fid2, iid2, chr, bp1, bp2 of a table of segments that pairs share, with a header."""
    x = headed(spark, path)
    return x.select(*(F.col(c).alias(c.lower()) for c in ("FID1", "IID1", "FID2", "IID2")), chromosome(F.col("CHR")).alias("chr"), F.col("BP1").cast("int").alias("bp1"), F.col("BP2").cast("int").alias("bp2"))


def counts_table(spark: SparkSession, path: str) -> DataFrame:
    """gene, sample, n of a table of read counts: a row for each gene, samples in the header; a field that is no number is null."""
    names = spark.read.text(path).first()["value"].split()
    x = lines(spark, path).where(_f(1) != names[0]).select(_f(1).alias("gene"), F.posexplode(F.slice("f", 2, len(names) - 1)).alias("k", "v"))
    return x.select("gene", F.element_at(F.array(*map(F.lit, names[1:])), F.col("k") + 1).alias("sample"), F.col("v").try_cast("long").alias("n"))
