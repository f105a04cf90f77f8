"""Column layouts of the long tables, and the chromosome tables of the species."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SAMPLES = "fid string, iid string, pat string, mat string, sex int, pheno double"
VARIANTS = "chr string, name string, cm double, bp int, a1 string, a2 string"
#: dosage: copies of allele 1, null for a missing call.
GENOTYPES = "fid string, iid string, name string, a string, b string"
NUMERICS = "fid string, iid string, attr string, value double"
RANGES = "chr string, start int, stop int, name string, grp string"
SEGMENTS = "fid string, iid string, chr string, bp1 int, bp2 int, type int, score double, sites int"
MISSING = "-9"

#: Autosomes of each species; X, Y, XY (and MT for humans) follow.
AUTOSOMES = {"human": 22, "dog": 38, "mouse": 19, "cow": 29, "sheep": 26, "horse": 31, "rice": 12}


def chromosomes(spark: SparkSession, species: str = "human") -> DataFrame:
    """code, label, is_x, is_y, is_haploid of each chromosome."""
    n = AUTOSOMES[species]
    rows = [(i, str(i), False, False, species == "rice" and False) for i in range(1, n + 1)]
    if species != "rice":
        rows += [(n + 1, "X", True, False, False), (n + 2, "Y", False, True, True)]
    if species in ("human", "dog"):
        rows.append((n + 3, "XY", False, False, False))
    if species == "human":
        rows.append((n + 4, "MT", False, False, True))
    return spark.createDataFrame(rows, "code int, label string, is_x boolean, is_y boolean, is_haploid boolean")
