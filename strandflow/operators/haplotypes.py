"""Haplotypes of windows: EM with posteriors, tests on posterior weights, imputation, blocks, and missingness by flanks.

A window is a group of a few variants; its EM is numpy within that group, so windows are spread over the cluster.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions.stats import chi2_sf
from strandflow.operators.models import haplotype_em


def posteriors(calls: np.ndarray, freq: dict[tuple[int, ...], float]) -> list[list[tuple[tuple[int, ...], tuple[int, ...], float]]]:
    """For each sample the pairs of haplotypes that fit its calls (-1: missing), with their posterior."""
    haps = [h for h, f in freq.items() if f > 1e-10]
    cache: dict[tuple[int, ...], list] = {}
    out = []
    for p in map(tuple, calls.tolist()):
        if p not in cache:
            fits = [(a, b, freq[a] * freq[b] * (1 if a == b else 2)) for i, a in enumerate(haps) for b in haps[i:] if all(c < 0 or x + y == c for x, y, c in zip(a, b, p, strict=True))]
            total = sum(w for *_, w in fits)
            cache[p] = [(a, b, w / total) for a, b, w in fits] if total > 0 else []
        out.append(cache[p])
    return out


def _wide(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.pivot(index="sample_id", columns="vid", values="dosage").fillna(-1).astype(int)


def phase(g: DataFrame, windows: DataFrame) -> DataFrame:
    """window, sample_id, hap1, hap2, posterior of every sample's pairs of haplotypes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = _wide(pdf)
        x = wide.to_numpy()
        rows = [(int(pdf["window"].iloc[0]), s, "".join(map(str, a)), "".join(map(str, b)), w) for s, ps in zip(wide.index, posteriors(x, haplotype_em(x)), strict=True) for a, b, w in ps if w > 1e-6]
        return pd.DataFrame(rows, columns=["window", "sample_id", "hap1", "hap2", "posterior"])

    return g.join(windows, "vid").groupBy("window").applyInPandas(run, "window int, sample_id long, hap1 string, hap2 string, posterior double")


def haplotype_counts(phased: DataFrame) -> DataFrame:
    """window, sample_id, hap, dose: expected copies of each haplotype."""
    return phased.select("window", "sample_id", "posterior", F.explode(F.array("hap1", "hap2")).alias("hap")).groupBy("window", "sample_id", "hap").agg(F.sum("posterior").alias("dose"))


def haplotype_case_control(phased: DataFrame, s: DataFrame, least: float = 0.01) -> DataFrame:
    """window, hap, f_a, f_u, chisq of each haplotype against all others, on posterior weights."""
    c = haplotype_counts(phased).join(s.select("sample_id", "aff"), "sample_id").groupBy("window", "hap").agg(F.sum(F.when(F.col("aff"), F.col("dose")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("aff"), 0.0).otherwise(F.col("dose"))).alias("u"))
    t = c.groupBy("window").agg(F.sum("a").alias("ta"), F.sum("u").alias("tu"))
    a, u, b, d = F.col("a"), F.col("u"), F.col("ta") - F.col("a"), F.col("tu") - F.col("u")
    chisq = (a + u + b + d) * (a * d - u * b) ** 2 / F.nullif((a + u) * (b + d) * (a + b) * (u + d), F.lit(0.0))
    x = c.join(t, "window").where((F.col("a") + F.col("u")) / (F.col("ta") + F.col("tu")) >= least)
    return x.select("window", "hap", (a / F.nullif(F.col("ta"), F.lit(0.0))).alias("f_a"), (u / F.nullif(F.col("tu"), F.lit(0.0))).alias("f_u"), chisq.alias("chisq"))


def haplotype_quantitative(phased: DataFrame, s: DataFrame, least: float = 0.01) -> DataFrame:
    """window, hap, beta, t of the phenotype on the expected copies of each haplotype; a sample without it has 0."""
    doses = haplotype_counts(phased)
    ids = phased.select("window", "sample_id").distinct().join(s.where("pheno is not null").select("sample_id", "pheno"), "sample_id")
    n = ids.groupBy("window").agg(F.count("*").alias("n"), F.avg("pheno").alias("my"), F.var_samp("pheno").alias("vy"))
    x = doses.join(ids, ["window", "sample_id"]).groupBy("window", "hap").agg(F.sum("dose").alias("sd"), F.sum(F.col("dose") ** 2).alias("sdd"), F.sum(F.col("dose") * F.col("pheno")).alias("sdy")).join(n, "window").where(F.col("sd") / (2 * F.col("n")) >= least)
    k = F.col("n").cast("double")
    vg, cov = (F.col("sdd") - F.col("sd") ** 2 / k) / (k - 1), (F.col("sdy") - F.col("sd") * F.col("my")) / (k - 1)
    x = x.withColumn("vg", vg).withColumn("cov", cov).where("vg > 1e-12 and n > 2").withColumn("beta", F.col("cov") / F.col("vg"))
    var = (F.col("vy") / F.col("vg") - F.col("beta") ** 2) / (k - 2)
    return x.select("window", "hap", "beta", (F.col("beta") / F.sqrt(F.when(var > 0, var))).alias("t"))


def impute(g: DataFrame, windows: DataFrame) -> DataFrame:
    """sample_id, vid, dose of the missing calls: the expected copies given the window's other calls."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = _wide(pdf)
        x = wide.to_numpy()
        rows = []
        for s, call, ps in zip(wide.index, x, posteriors(x, haplotype_em(x)), strict=True):
            for j in np.flatnonzero(call < 0):
                if ps:
                    rows.append((s, int(wide.columns[j]), float(sum(w * (a[j] + b[j]) for a, b, w in ps))))
        return pd.DataFrame(rows, columns=["sample_id", "vid", "dose"])

    return g.join(windows, "vid").groupBy("window").applyInPandas(run, "sample_id long, vid int, dose double")


def mishap(g: DataFrame, v: DataFrame) -> DataFrame:
    """vid, hap, m_miss, m_call, chisq: whether a missing call goes with the haplotypes of the flanking variants.

    A variant's window is itself and its neighbour on either side.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("chr").orderBy("bp", "vid")
    flank = v.select("vid", F.lag("vid").over(w).alias("l"), F.lead("vid").over(w).alias("r")).where("l is not null and r is not null")
    need = flank.select(F.col("vid").alias("mid"), F.explode(F.array("l", "vid", "r")).alias("vid"))
    x = g.join(need, "vid")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mid = int(pdf["mid"].iloc[0])
        wide = _wide(pdf)
        miss = wide[mid].to_numpy() < 0
        sides = wide.drop(columns=[mid]).to_numpy()
        rows = []
        if miss.any() and not miss.all():
            counts: dict[tuple[int, ...], list[float]] = {}
            for m, ps in zip(miss, posteriors(sides, haplotype_em(sides)), strict=True):
                for a, b, p in ps:
                    for h in (a, b):
                        counts.setdefault(h, [0.0, 0.0])[int(not m)] += p
            tm, tc = (sum(c[k] for c in counts.values()) for k in (0, 1))
            for h, (a, b) in sorted(counts.items()):
                c, d = tm - a, tc - b
                bottom = (a + b) * (c + d) * (a + c) * (b + d)
                chi = (a + b + c + d) * (a * d - b * c) ** 2 / bottom if bottom > 0 else np.nan
                rows.append((mid, "".join(map(str, h)), a, b, chi, float(chi2_sf(chi, 1)) if bottom > 0 else np.nan))
        return pd.DataFrame(rows, columns=["vid", "hap", "miss", "called", "chisq", "p"])

    return x.groupBy("mid").applyInPandas(run, "vid int, hap string, miss double, called double, chisq double, p double")


def dprime_interval(n: np.ndarray) -> tuple[float, float]:
    """90 % interval of |D'| from a 3x3 table of counts (rows and columns by dosage 0, 1, 2), by its likelihood on a grid."""
    total = 2 * n.sum()
    p = (2 * n[2].sum() + n[1].sum()) / total
    q = (2 * n[:, 2].sum() + n[:, 1].sum()) / total
    if not (0 < p < 1 and 0 < q < 1):
        return np.nan, np.nan
    best = None
    for sign in (1, -1):
        most = min(p * (1 - q), (1 - p) * q) if sign > 0 else min(p * q, (1 - p) * (1 - q))
        logs = []
        for k in range(101):
            d = sign * k / 100 * most
            h = {(1, 1): p * q + d, (1, 0): p * (1 - q) - d, (0, 1): (1 - p) * q - d, (0, 0): (1 - p) * (1 - q) + d}
            cells = np.zeros((3, 3))
            for (a, b), (c, e) in itertools.product(h, repeat=2):
                cells[a + c, b + e] += h[a, b] * h[c, e]
            logs.append(float((n * np.log(np.maximum(cells, 1e-12))).sum()))
        if best is None or max(logs) > max(best):
            best = logs
    w = np.exp(np.array(best) - max(best))
    c = np.cumsum(w) / w.sum()
    return float(np.searchsorted(c, 0.05)) / 100, float(min(100, np.searchsorted(c, 0.95))) / 100


def blocks(g: DataFrame, v: DataFrame, most_kb: float = 200.0) -> DataFrame:
    """chr, start, stop, n: spans in which 95 % of the informative pairs are in strong LD; the longest first, without overlap.

    Spark gives each near pair's table; the choice of spans is a pass over a chromosome's pairs.
    """
    from strandflow.operators.products import genotype_pairs

    at = v.select("vid", "chr", "bp")
    x = genotype_pairs(g.join(v.select("vid", F.col("chr").alias("c1")), "vid"), ("c1",))
    a, b = (at.select(F.col("vid").alias(f"v{k}"), F.col("bp").alias(f"b{k}")) for k in (1, 2))
    x = x.join(a, "v1").join(b, "v2").where((F.abs(F.col("b1") - F.col("b2")) <= most_kb * 1000))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        strong, weak = set(), set()
        for r in pdf.itertuples():
            lo, hi = dprime_interval(np.array([[getattr(r, f"n{i}{j}") for j in range(3)] for i in range(3)], float))
            pair = (min(r.b1, r.b2), max(r.b1, r.b2))
            if lo >= 0.7 and hi >= 0.98:
                strong.add(pair)
            elif hi < 0.9:
                weak.add(pair)
        out, used = [], []
        for lo, hi in sorted(strong, key=lambda p: (p[0] - p[1], p)):
            if any(lo <= e and s <= hi for s, e in used):
                continue
            inside = [p for p in strong if lo <= p[0] and p[1] <= hi]
            against = [p for p in weak if lo <= p[0] and p[1] <= hi]
            if len(inside) >= 0.95 * (len(inside) + len(against)):
                used.append((lo, hi))
                n = len({e for p in zip(pdf["b1"], pdf["b2"], strict=True) for e in p if lo <= e <= hi})
                out.append((int(pdf["c1"].iloc[0]), int(lo), int(hi), n))
        return pd.DataFrame(sorted(out), columns=["chr", "start", "stop", "n"])

    return x.groupBy("c1").applyInPandas(run, "chr int, start int, stop int, n int")
