"""Runs of homozygosity and copy-number segments, by windows and interval joins."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.stats import div, n_if
from strandflow.operators.joins import overlap_counts, overlap_join, overlap_share, range_join


def homozygous_runs(g: DataFrame, v: DataFrame, window: int = 50, most_het: int = 1, most_missing: int = 5, share: float = 0.05, least_snps: int = 100, least_kb: float = 1000.0, most_gap: int = 1_000_000) -> DataFrame:
    """sample_id, chr, start, stop, nsnp, kb, density, phom, phet.

    A window of consecutive variants is homozygous if it has few het and missing calls; a variant is in a run if a share of
    the windows that cover it are; runs break at gaps.
    """
    w = Window.partitionBy("sample_id", "chr").orderBy("bp", "vid")
    x = g.join(v.select("vid", "chr", "bp"), "vid")
    ahead = w.rowsBetween(0, window - 1)
    x = x.withColumns({"het": F.sum((F.col("dosage") == 1).cast("int")).over(ahead), "miss": F.sum(F.col("dosage").isNull().cast("int")).over(ahead), "len": F.count("*").over(ahead)})
    good = (F.col("len") == window) & (F.coalesce("het", F.lit(0)) <= most_het) & (F.col("miss") <= most_missing)
    x = x.withColumns({"good": good.cast("int"), "whole": (F.col("len") == window).cast("int")})
    behind = w.rowsBetween(-(window - 1), 0)
    x = x.withColumn("rate", div(F.sum("good").over(behind), F.sum("whole").over(behind)))
    x = x.withColumn("inside", F.coalesce(F.col("rate") >= share, F.lit(False)))
    fresh = F.col("inside") & (~F.coalesce(F.lag("inside").over(w), F.lit(False)) | (F.col("bp") - F.lag("bp").over(w) > most_gap))
    x = x.withColumn("run", F.sum(fresh.cast("int")).over(w)).where("inside")
    x = x.groupBy("sample_id", "chr", "run").agg(F.min("bp").alias("start"), F.max("bp").alias("stop"), F.count("*").alias("nsnp"), n_if(F.col("dosage") != 1).alias("hom"), n_if(F.col("dosage") == 1).alias("hets"))
    x = x.withColumn("kb", (F.col("stop") - F.col("start")) / 1000.0).where((F.col("nsnp") >= least_snps) & (F.col("kb") >= least_kb))
    return x.select("sample_id", "chr", "start", "stop", "nsnp", "kb", div(F.col("kb"), F.col("nsnp")).alias("density"), div(F.col("hom"), F.col("nsnp")).alias("phom"), div(F.col("hets"), F.col("nsnp")).alias("phet"))


def run_pools(runs: DataFrame, least: int = 2) -> DataFrame:
    """chr, start, stop, n: stretches that at least so many samples' runs cover, by a sweep over their ends."""
    ends = runs.select("chr", F.col("start").alias("at"), F.lit(1).alias("d")).unionByName(runs.select("chr", (F.col("stop") + 1).alias("at"), F.lit(-1).alias("d"))).groupBy("chr", "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("chr").orderBy("at")
    x = ends.withColumn("n", F.sum("d").over(w)).withColumn("stop", F.lead("at").over(w) - 1)
    return x.where(F.col("n") >= least).select("chr", F.col("at").alias("start"), "stop", "n")


def cnv_filter(seg: DataFrame, least_kb: float = 0, most_kb: float | None = None, least_score: float | None = None, least_sites: int | None = None, kind: str | None = None) -> DataFrame:
    """Segments by length, score, sites and type (del: below 2 copies, dup: above)."""
    kb = (F.col("bp2") - F.col("bp1")) / 1000.0
    cond = kb >= least_kb
    for x, c in ((most_kb, lambda m: kb <= m), (least_score, lambda m: F.col("score") >= m), (least_sites, lambda m: F.col("sites") >= m), (kind, lambda m: F.col("type") < 2 if m == "del" else F.col("type") > 2)):
        cond = cond if x is None else cond & c(x)
    return seg.where(cond)


def cnv_intersect(seg: DataFrame, regions: DataFrame, least: float = 0.0, kind: str = "default", exclude: bool = False, disrupt: bool = False) -> DataFrame:
    """Segments that meet a region by more than a share (or, to disrupt it, have an end in it), or those that don't."""
    # Only whether a region is met counts: equal ones are one, and what lies within another is met by no greater share of a segment.
    regions = regions.select("chr", "bp1", "bp2").distinct()
    if not disrupt and (kind == "default" or least <= 0):
        wider = Window.partitionBy("chr").orderBy("bp1", F.desc("bp2")).rowsBetween(Window.unboundedPreceding, -1)
        regions = regions.withColumn("reach", F.max("bp2").over(wider)).where("reach is null or reach < bp2").drop("reach")
    m = overlap_join(seg, regions)
    if disrupt:
        m = m.where((F.col("bp1") > F.col("b_bp1")) & (F.col("bp1") < F.col("b_bp2")) | (F.col("bp2") > F.col("b_bp1")) & (F.col("bp2") < F.col("b_bp2")))
    elif least > 0:
        m = m.where(overlap_share(kind) >= least)
    return seg.join(m.select("seg_id").distinct(), "seg_id", "left_anti" if exclude else "left_semi")


def dominated(x: np.ndarray, y: np.ndarray, w: np.ndarray, to_x: np.ndarray, to_y: np.ndarray) -> np.ndarray:
    """For each asked corner the weight of the points with x <= to_x and y <= to_y, bit by bit of y's places (a wavelet matrix)."""
    order = np.argsort(x, kind="stable")
    last = np.searchsorted(x[order], to_x, "right")
    by_y = np.argsort(y[order], kind="stable")
    j = np.searchsorted(y[order][by_y], to_y, "right")
    v, w = np.empty(len(x), np.int64), w[order]
    v[by_y] = np.arange(len(x))
    first, out = np.zeros(len(to_x), np.int64), np.zeros(len(to_x), np.int64)
    for bit in reversed(range(len(x).bit_length())):
        low = (v >> bit & 1) == 0
        lows, weight = np.concatenate(([0], np.cumsum(low))), np.concatenate(([0], np.cumsum(np.where(low, w, 0))))
        up = (j >> bit & 1) == 1
        out += np.where(up, weight[last] - weight[first], 0)
        first, last = (np.where(up, lows[-1] + k - lows[k], lows[k]) for k in (first, last))
        turn = np.concatenate((np.flatnonzero(low), np.flatnonzero(~low)))
        v, w = v[turn], w[turn]
    return out


def meeting(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray, w: np.ndarray, n: int, d: int) -> np.ndarray:
    """For each segment [p, q] the weight of the [r, s] that meet it by n / d (0 to 1) of both together or more.

    (n + d) * meet >= n * (sum of lengths) is linear wherever begins and ends lie in one order; each of the four orders is a
    triangle in (r, s), which is a sum and difference of corners of two sides.
    """
    size, gap, rise, fall = q - p + 1, s - r, d * s + n * r, d * r + n * s
    most, least = d * size // n - 1, -(-n * size // d) - 1
    over, under = (n + d) * (p - 1) + n * (size + 1), (n + d) * (q + 1) - n * (size + 1)
    at = lambda x, y, to_x, to_y: dominated(x, y, w, to_x, to_y)
    nowhere, all_ = np.zeros(len(r), np.int64), np.zeros(len(p), np.int64)
    ends, begins, both = at(nowhere, s, all_, q - 1), at(nowhere, r, all_, p), at(r, s, p, q - 1)
    around = at(r, gap, p, most) - at(s, gap, q - 1, most) + ends - both
    within = ends - both - at(s, gap, q - 1, least - 1) + at(r, gap, p, least - 1)
    before = at(r, -rise, p, -over) - at(-s, -rise, -q, -over) + w.sum() - ends - begins + both
    behind = at(nowhere, fall, all_, under) - at(r, fall, p, under) - at(s, fall, q - 1, under) + both
    return around + within + before + behind


def cnv_frequency(seg: DataFrame, least: float = 0.5) -> DataFrame:
    """seg_id, n: segments (itself included) that meet a segment by a share of both together.

    Equal segments are one with a weight.  Such a share bounds the lengths' ratio and the begins' distance, so segments meet by class of
    length and stretch of begins, and are counted there by ``meeting``: neither a row nor a step for a pair.
    """
    if least <= 0:
        m = overlap_join(seg, seg.select("seg_id", "chr", "bp1", "bp2")).where(overlap_share("union") >= least)
        return m.groupBy("seg_id").agg(F.count("*").alias("n"))
    if least > 1:
        return seg.select("seg_id", F.lit(0).cast("long").alias("n")).where("false")
    # A little over the ratio, so that no class hangs on a logarithm's last bit.
    base = 1.001 / least
    own = seg.where("bp1 <= bp2").groupBy("chr", F.col("bp1").cast("long").alias("bp1"), F.col("bp2").cast("long").alias("bp2")).agg(F.count("*").alias("w"))
    own = own.withColumn("cls", F.floor(F.log(F.col("bp2") - F.col("bp1") + 1) / math.log(base)))
    top = F.pow(F.lit(base), F.col("cls") + 1)
    width, reach = F.greatest(F.ceil(4 * top), F.lit(200_000)), F.ceil(top * base)
    asks = own.select("chr", "cls", F.floor(F.col("bp1") / width).alias("bin"), "bp1", "bp2", F.lit(0).cast("long").alias("w"))
    near = own.withColumn("cls", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)))
    near = near.withColumn("bin", F.explode(F.sequence(F.floor((F.col("bp1") - reach) / width), F.floor((F.col("bp1") + reach) / width))))

    share = Fraction(str(float(least)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf["w"].to_numpy() == 0
        p, q = (pdf[c].to_numpy()[mine] for c in ("bp1", "bp2"))
        n = meeting(p, q, *(pdf[c].to_numpy()[~mine] for c in ("bp1", "bp2", "w")), share.numerator, share.denominator)
        return pd.DataFrame({"chr": [key[0]] * len(p), "bp1": p, "bp2": q, "n": n})

    kind = dict(own.dtypes)["chr"]
    met = asks.unionByName(near.select("chr", "cls", "bin", "bp1", "bp2", "w")).where("chr is not null").groupBy("chr", "cls", "bin").applyInPandas(run, f"chr {kind}, bp1 long, bp2 long, n long")
    return seg.select("seg_id", "chr", "bp1", "bp2").join(met, ["chr", "bp1", "bp2"]).groupBy("seg_id").agg(F.sum("n").alias("n"))


def cnv_summary(seg: DataFrame) -> DataFrame:
    """sample_id, nseg, kb, kbavg."""
    kb = (F.col("bp2") - F.col("bp1")) / 1000.0
    return seg.groupBy("sample_id").agg(F.count("*").alias("nseg"), F.sum(kb).alias("kb"), F.avg(kb).alias("kbavg"))


def cnv_region_counts(seg: DataFrame, regions: DataFrame, s: DataFrame) -> DataFrame:
    """name, aff, unaff: case and control segments that meet each region.

    A name of one range and a segment of one row are counted by running counts over the distinct ranges; only names and segments that
    occur more than once, which count once wherever they meet, are joined by pairs.
    """
    r = regions.select("name", "chr", "bp1", "bp2").distinct().withColumn("_single", (F.count("*").over(Window.partitionBy("name")) == 1) & F.col("bp1").isNotNull() & (F.col("bp1") <= F.col("bp2")))
    x = seg.select("seg_id", "sample_id", "chr", "bp1", "bp2").distinct().withColumn("_alone", (F.count("*").over(Window.partitionBy("seg_id", "sample_id")) == 1) & F.col("bp1").isNotNull() & (F.col("bp1") <= F.col("bp2")))
    who = s.select("sample_id", "aff")
    aff, unaff = F.when(F.col("aff"), 1).otherwise(0), F.when(~F.col("aff"), 1).otherwise(0)
    one, at = r.where("_single"), F.struct("chr", "bp1", "bp2").alias("at")
    alone = x.where("_alone").join(who, "sample_id").groupBy("chr", "bp1", "bp2").agg(F.sum(aff).alias("n1"), F.sum(unaff).alias("n2"))
    sums = overlap_counts(one.select("chr", "bp1", "bp2").distinct().withColumn("at", at), alone, ["at"], {"aff": F.col("n1"), "unaff": F.col("n2")}, 10_000).select("at.*", "aff", "unaff")
    plain = one.join(sums, ["chr", "bp1", "bp2"]).select("name", "aff", "unaff")
    y, few = x.select("seg_id", "sample_id", "chr", "bp1", "bp2", "_alone"), r.select("chr", "bp1", "bp2", "name", "_single")
    pairs = overlap_join(y, few.where("not _single")).unionByName(overlap_join(y.where("not _alone"), few.where("_single")))
    m = pairs.select("seg_id", "sample_id", "b_name").distinct().join(who, "sample_id").select(F.col("b_name").alias("name"), aff.alias("aff"), unaff.alias("unaff"))
    return plain.unionByName(m.select("name", *(F.col(c).cast("long") for c in ("aff", "unaff")))).groupBy("name").agg(F.sum("aff").alias("aff"), F.sum("unaff").alias("unaff"))


def rare_window(counts: DataFrame, radius: int) -> DataFrame:
    """vid, case_rare, control_rare over a window of positions on either side, by a range frame."""
    w = Window.partitionBy("chr").orderBy("bp").rangeBetween(-radius, radius)
    return counts.select("vid", F.sum("case_rare").over(w).alias("case_rare"), F.sum("control_rare").over(w).alias("control_rare"))


def smooth(x: DataFrame, value: str, radius: int) -> DataFrame:
    """Mean of a value over a window of positions."""
    w = Window.partitionBy("chr").orderBy("bp").rangeBetween(-radius, radius)
    return x.withColumn("smooth", F.avg(value).over(w))


def ibd_segments(p: DataFrame, least: float = 0.5, least_n: int = 2) -> DataFrame:
    """pair, start, stop, n: runs of consecutive positions (idx) whose posterior is high enough."""
    w = Window.partitionBy("pair").orderBy("idx")
    x = p.withColumn("i", F.row_number().over(w)).where(F.col("post") >= least)
    x = x.withColumn("k", F.col("i") - F.row_number().over(w))
    return x.groupBy("pair", "k").agg(F.min("idx").alias("start"), F.max("idx").alias("stop"), F.count("*").alias("n")).where(F.col("n") >= least_n).drop("k")


def genes_hit(seg: DataFrame, genes: DataFrame) -> DataFrame:
    """seg_id and the number of genes whose start lies in the segment, by running counts: no row for a segment and a gene."""
    points = genes.select("chr", F.col("start").alias("bp1"), F.col("start").alias("bp2"))
    return overlap_counts(seg, points, ["seg_id"], {"genes": F.lit(1)}, 1000)


def coverage(seg: DataFrame, v: DataFrame, s: DataFrame) -> DataFrame:
    """vid, aff, unaff: case and control samples with a segment over each variant's position; variants without any have zeros."""
    r = seg.select("chr", F.col("bp1").alias("start"), F.col("bp2").alias("stop"), "sample_id")
    over = range_join(v.select("vid", "chr", "bp"), r).select("vid", "sample_id").distinct().join(s.select("sample_id", "aff"), "sample_id")
    n = over.groupBy("vid").agg(n_if(F.col("aff")).alias("aff"), n_if(~F.col("aff")).alias("unaff"))
    return v.select("vid").join(n, "vid", "left").select("vid", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("aff", "unaff")))


def burden(seg: DataFrame, s: DataFrame) -> DataFrame:
    """aff, people, segments, rate, share with any, kb and kb a segment: every sample counts, also those without a segment."""
    own = seg.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum((F.col("bp2") - F.col("bp1")) / 1000.0).alias("kb"))
    x = s.select("sample_id", "aff").join(own, "sample_id", "left").groupBy("aff").agg(F.count("*").alias("people"), F.coalesce(F.sum("n"), F.lit(0)).alias("segments"), F.count("n").alias("some"), F.coalesce(F.sum("kb"), F.lit(0.0)).alias("kb"))
    return x.select("aff", "people", "segments", div(F.col("segments"), F.col("people")).alias("rate"), div(F.col("some"), F.col("people")).alias("share"), "kb", div(F.col("kb"), F.col("segments")).alias("kb_each"))
