"""Writers: each makes a DataFrame of lines (or columns) in the format; ``write_lines`` stores it as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, codec: str = "none") -> None:
    df.write.option("compression", codec).text(path)


def _call(sep: str = " ") -> Column:
    return F.concat_ws(sep, F.coalesce("a", F.lit("0")), F.coalesce("b", F.lit("0")))


def _ordered(key: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), _call().alias("c")))), lambda x: x["c"])


def ped_lines(g: DataFrame, samples: DataFrame, variants: DataFrame) -> DataFrame:
    """A PED line for each sample, calls in the order of ``variants.idx``."""
    calls = g.join(variants.select("name", "idx"), "name").groupBy("fid", "iid").agg(F.concat_ws(" ", _ordered("idx")).alias("calls"))
    head = F.concat_ws(" ", "fid", "iid", "pat", "mat", F.coalesce(F.col("sex").cast("string"), F.lit("0")), F.coalesce(F.col("pheno").cast("string"), F.lit("-9")))
    return samples.join(calls, ["fid", "iid"]).select(F.concat_ws(" ", head, "calls").alias("value"))


def map_lines(variants: DataFrame) -> DataFrame:
    return variants.orderBy("idx").select(F.concat_ws(" ", "chr", "name", F.col("cm").cast("string"), F.col("bp").cast("string")).alias("value"))


def tped_lines(g: DataFrame, samples: DataFrame, variants: DataFrame) -> DataFrame:
    """A line for each variant, calls in the order of ``samples.idx``."""
    calls = g.join(samples.select("fid", "iid", "idx"), ["fid", "iid"]).groupBy("name").agg(F.concat_ws(" ", _ordered("idx")).alias("calls"))
    return variants.join(calls, "name").select(F.concat_ws(" ", "chr", "name", F.col("cm").cast("string"), F.col("bp").cast("string"), "calls").alias("value"))


def lgen_lines(g: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Long lines; with a reference (name, a1) only the calls that differ from it."""
    if reference is not None:
        g = g.join(reference.select("name", F.col("a1").alias("ref")), "name", "left").where("not (a <=> ref and b <=> ref)")
    return g.select(F.concat_ws(" ", "fid", "iid", "name", _call()).alias("value"))


def rlist_lines(g: DataFrame, variants: DataFrame) -> DataFrame:
    """For each variant, the samples that are not homozygous for the common allele, by genotype."""
    x = g.join(variants.select("name", "a1", "a2"), "name")
    kind = F.when(F.col("a").isNull() | F.col("b").isNull(), "NIL").when((F.col("a") == F.col("a1")) & (F.col("b") == F.col("a1")), "HOM").when(F.col("a") != F.col("b"), "HET")
    x = x.withColumn("kind", kind).where("kind is not null").groupBy("name", "kind", "a1", "a2").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "fid", "iid"))).alias("who"))
    return x.select(F.concat_ws(" ", "name", "kind", F.when(F.col("kind") == "HET", F.col("a2")).otherwise(F.col("a1")), F.when(F.col("kind") == "HET", F.col("a1")).otherwise(F.col("a1")), F.concat_ws(" ", "who")).alias("value"))


def genotype_list(g: DataFrame) -> DataFrame:
    """name, genotype and the samples that have it."""
    return g.groupBy("name", _call("/").alias("genotype")).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "fid", "iid"))).alias("samples"))


def pair_list(g: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """name and both samples' calls, with the alleles that they share by state."""
    who = lambda ids, n: g.where((F.col("fid") == ids[0]) & (F.col("iid") == ids[1])).select("name", F.col("a").alias(f"a{n}"), F.col("b").alias(f"b{n}"))
    x = who(first, 1).join(who(second, 2), "name")
    same = F.array_sort(F.array("a1", "b1")) == F.array_sort(F.array("a2", "b2"))
    any_ = F.arrays_overlap(F.array("a1", "b1"), F.array("a2", "b2"))
    return x.withColumn("ibs", F.when(F.col("a1").isNull() | F.col("a2").isNull(), None).when(same, 2).when(any_, 1).otherwise(0))


def fastphase_lines(g: DataFrame, variants: DataFrame) -> DataFrame:
    """id, first and second row of alleles for each sample, ? for missing."""
    x = g.join(variants.select("name", "idx"), "name").groupBy("fid", "iid").agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("a", F.lit("?")).alias("a"), F.coalesce("b", F.lit("?")).alias("b")))).alias("c"))
    return x.select(F.concat(F.lit("# ID "), "iid").alias("id"), F.concat_ws("", F.transform("c", lambda y: y["a"])).alias("first"), F.concat_ws("", F.transform("c", lambda y: y["b"])).alias("second"))


def structure_lines(g: DataFrame, variants: DataFrame) -> DataFrame:
    """Two numbers a call, 0 for missing: a line for each sample."""
    code = lambda c: F.when(F.col(c) == F.col("a1"), "1").when(F.col(c) == F.col("a2"), "2").otherwise("0")
    x = g.join(variants.select("name", "idx", "a1", "a2"), "name").groupBy("fid", "iid").agg(F.array_sort(F.collect_list(F.struct("idx", F.concat_ws(" ", code("a"), code("b")).alias("c")))).alias("cs"))
    return x.select(F.concat_ws(" ", "iid", F.concat_ws(" ", F.transform("cs", lambda y: y["c"]))).alias("value"))


def bimbam_lines(g: DataFrame, samples: DataFrame) -> DataFrame:
    """name and each sample's two letters, in the order of ``samples.idx``."""
    pair = F.concat(F.coalesce("a", F.lit("?")), F.coalesce("b", F.lit("?")))
    x = g.join(samples.select("fid", "iid", "idx"), ["fid", "iid"]).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("idx", pair.alias("c")))).alias("cs"))
    return x.select(F.concat_ws(",", "name", F.concat_ws(",", F.transform("cs", lambda y: y["c"]))).alias("value"))


def covariate_columns(s: DataFrame, covariates: list[str]) -> DataFrame:
    return s.select("fid", "iid", *covariates)


def arff_header(relation: str, attributes: list[str], classes: list[str]) -> list[str]:
    """The head of an ARFF file; its data are the rows of ``delimited``."""
    return [f"@RELATION {relation}", "", *(f"@ATTRIBUTE {a} NUMERIC" for a in attributes), f"@ATTRIBUTE class {{{','.join(classes)}}}", "", "@DATA"]


def delimited(x: DataFrame, sep: str = "\t") -> DataFrame:
    """A line of values and class for each instance (id, cls, values)."""
    return x.select(F.concat_ws(sep, F.transform("values", lambda v: v.cast("string")), F.col("cls").cast("string")).alias("value"))


def matrix_lines(edges: DataFrame, names: list[str], upper: bool = False) -> DataFrame:
    """Lines of a square matrix of an edge table whose ends are names, header left to the caller; zeros where no edge is."""
    both = edges.unionByName(edges.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "weight"))
    wide = both.groupBy("i").pivot("j", names).agg(F.first("weight"))
    at = F.array_position(F.array(*map(F.lit, names)), F.col("i"))
    cells = F.array(*(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).cast("string") for n in names))
    return wide.select(at.alias("row"), F.concat_ws("\t", F.slice(cells, at.cast("int"), F.size(cells)) if upper else cells).alias("value")).orderBy("row")


def sif_lines(edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    return edges.where((F.abs("weight") > threshold) & (F.col("i") != F.col("j"))).select(F.concat_ws("\t", "i", F.col("weight").cast("string"), "j").alias("value"))


def segment_track(seg: DataFrame) -> DataFrame:
    """BED-track lines of segments."""
    return seg.select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("chr").cast("string")), F.col("bp1").cast("string"), F.col("bp2").cast("string"), F.concat_ws("_", F.col("fid"), F.col("iid")), F.col("score").cast("string")).alias("value"))


def permuted_phenotypes(shuffles: DataFrame, n: int) -> DataFrame:
    """sample_id and a column for each replicate of (rep, sample_id, label)."""
    return shuffles.groupBy("sample_id").pivot("rep", list(range(1, n + 1))).agg(F.first("label"))


def in_one(rows: DataFrame, order: list[str], header: str | None = None) -> DataFrame:
    """Lines in an order, a header first, in one partition: for formats whose order or header makes them one file."""
    x = rows.select(F.lit(1).alias("_k"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), "value")
    if header is not None:
        head = rows.sparkSession.range(1).select(F.lit(0).alias("_k"), *(F.lit(None).cast(x.schema[f"_o{i}"].dataType).alias(f"_o{i}") for i in range(len(order))), F.lit(header).alias("value"))
        x = head.unionByName(x)
    return x.repartition(1).sortWithinPartitions("_k", *(f"_o{i}" for i in range(len(order)))).select("value")


def table_lines(x: DataFrame, missing: str = "NA") -> DataFrame:
    """All columns of each row, separated by blanks, with a word for nulls."""
    return x.select("*", F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in x.columns)).alias("value"))


def numeric_lines(num: DataFrame) -> DataFrame:
    """fid, iid, value: a line of a numeric file for each sample, attributes in order (fid, iid, attr_id, value)."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("attr_id", F.coalesce(F.col("value").cast("string"), F.lit("-9")).alias("c")))), lambda x: x["c"])
    return num.groupBy("fid", "iid").agg(cells.alias("cells")).select("fid", "iid", F.concat_ws(" ", "fid", "iid", F.concat_ws(" ", "cells")).alias("value"))


def set_lines(sets: DataFrame) -> DataFrame:
    """A block for each set (set_name, name): its name, its members, END."""
    return sets.groupBy("set_name").agg(F.array_sort(F.collect_set("name")).alias("m")).select("set_name", F.concat_ws("\n", "set_name", F.concat_ws("\n", "m"), F.lit("END")).alias("value"))


def dosage_lines(d: DataFrame, samples: DataFrame) -> DataFrame:
    """name, a1, a2 and each sample's dosage, in the order of ``samples.idx``."""
    x = d.join(samples.select("fid", "iid", "idx"), ["fid", "iid"]).groupBy("name", "a1", "a2").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("dose").cast("string").alias("c")))).alias("cs"))
    return x.select(F.concat_ws(" ", "name", "a1", "a2", F.concat_ws(" ", F.transform("cs", lambda y: y["c"]))).alias("value"))


def sample_report(g: DataFrame, fid: str, iid: str) -> DataFrame:
    """name, genotype of one sample; the predicate reaches the scan."""
    return g.where((F.col("fid") == fid) & (F.col("iid") == iid)).select("name", _call("/").alias("genotype"))
