"""Distances between two arrays, as column expressions, and between sequences' substitution counts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column, b: Column, diff) -> Column:
    """Sum of diff over the pairs of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, diff), F.lit(0.0), lambda s, x: s + x)


def manhattan(a: Column, b: Column) -> Column:
    return total(a, b, lambda x, y: F.abs(x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(a, b, lambda x, y: (x - y) * (x - y)))


def genotype_mismatch(a: Column, b: Column) -> Column:
    """1 for each pair of different dosages; two thirds where either is missing."""
    return total(a, b, lambda x, y: F.when(x.isNull() | y.isNull(), 2.0 / 3.0).when(x == y, 0.0).otherwise(1.0))


def allele_mismatch(a: Column, b: Column) -> Column:
    """Half a unit for each allele that differs; two thirds where either is missing."""
    return total(a, b, lambda x, y: F.when(x.isNull() | y.isNull(), 2.0 / 3.0).otherwise(F.abs(x - y) / 2.0))


#: By name, for rankers and distance tables.
METRICS = {"manhattan": manhattan, "euclidean": euclidean, "gm": genotype_mismatch, "am": allele_mismatch}


def jukes_cantor(p: float) -> float:
    """Distance of sequences that differ at a share p of sites."""
    return math.inf if p >= 0.75 else -0.75 * math.log(1 - 4 * p / 3)


def kimura(transitions: float, transversions: float) -> float:
    """Two-parameter distance from the shares of transitions and transversions."""
    a, b = 1 - 2 * transitions - transversions, 1 - 2 * transversions
    return math.inf if a <= 0 or b <= 0 else -0.5 * math.log(a) - 0.25 * math.log(b)
