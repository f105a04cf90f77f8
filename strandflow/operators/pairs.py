"""Pairs of samples and of variants: IBS and IBD, linkage disequilibrium, and pairwise epistasis.

All pairs come from matrix products of blocks (``products``); pairs within a band of variants from an equi-join on the sample and
the block, aggregated in the tasks before pairs are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.stats import div, n_if, norm_cdf
from strandflow.lineage import cut
from strandflow.operators.products import called, cells_of, counts, genotype_pairs, moments, products, reduced


_IBS_OF = {"m": called} | {str(d): (lambda c, d=d: c == d) for d in range(3)}
_IBS_SUMS = {"n": ("m", "m"), "s0": ("0", "0"), "s1": ("1", "1"), "s2": ("2", "2"), "d1": ("0", "2"), "d2": ("2", "0")}


def _states(g: DataFrame) -> tuple[DataFrame, int | None]:
    """i, j, ibs0, ibs1, ibs2, het2 of pairs with common calls; and how many places pairs may have, None where that is not bounded."""
    g = g.where("dosage is not null")
    packed = counts(g, "sample_id", "vid", {"m": F.lit(True)} | {str(d): F.col("dosage") == d for d in range(3)}, _IBS_SUMS)
    x, most = packed or (products(g, "sample_id", "vid", "dosage", _IBS_OF, _IBS_SUMS), None)
    same, far = F.col("s0") + F.col("s1") + F.col("s2"), F.col("d1") + F.col("d2")
    return x.where("n > 0").select("i", "j", far.cast("long").alias("ibs0"), (F.col("n") - same - far).cast("long").alias("ibs1"), same.cast("long").alias("ibs2"), F.col("s1").cast("long").alias("het2")), most


def _ppc(x: DataFrame) -> DataFrame:
    """``x`` with ppc of its ibs0 and het2."""
    m = (F.col("ibs0") + F.col("het2")).cast("double")
    z = div(div(F.col("het2"), m) - 2.0 / 3.0, F.sqrt(div(F.lit(2.0 / 9.0), m)))
    return x.withColumn("z", z).withColumn("ppc", norm_cdf(F.col("z"))).drop("z")


def ibs(g: DataFrame) -> DataFrame:
    """i, j, ibs0, ibs1, ibs2, dst, ppc: alleles shared by state; ppc by its normal approximation."""
    x, most = _states(g)
    if most is None:
        x = _ppc(x)
    else:
        # One table of all that can be, a few thousand values, instead of a polynomial for each pair.
        side = most + 1
        at = _ppc(g.sparkSession.range(0, side * side, 1, 1).select("id", F.floor(F.col("id") / side).alias("ibs0"), (F.col("id") % side).alias("het2")))
        table = at.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "ppc"))), lambda c: c["ppc"]).alias("ppc"))
        x = x.withColumn("ppc", F.get(table.scalar(), (F.col("ibs0") * side + F.col("het2")).cast("int")))
    n = F.col("ibs0") + F.col("ibs1") + F.col("ibs2")
    return x.select("i", "j", "ibs0", "ibs1", "ibs2", div(0.5 * F.col("ibs1") + F.col("ibs2"), n).alias("dst"), "ppc")


def similar(g: DataFrame, finish, schema: str, carried: str | None = None) -> DataFrame | None:
    """What ``finish(items, a, b, once, dst, own)`` makes of blocks of the similarity of ``ibs``, nan without common calls (``reduced``)."""
    def of(items, a, b, once, sums, own):
        n, same, far = sums["n"], sums["s0"] + sums["s1"] + sums["s2"], sums["d1"] + sums["d2"]
        with np.errstate(all="ignore"):
            dst = (0.5 * (n - same - far) + same) / n
        return finish(items, a, b, once & (n > 0), dst, own)

    return reduced(g.where("dosage is not null"), "sample_id", "vid", "dosage", _IBS_OF, _IBS_SUMS, of, schema, carried)


def close(g: DataFrame, least: float) -> DataFrame:
    """i, j, dst of the pairs that are at least so similar by state; the others have no rows."""
    def finish(items, a, b, once, dst, own):
        r, c = np.nonzero(once & (dst >= least))
        one, two = items[a][r], items[b][c]
        return pd.DataFrame({"i": np.minimum(one, two), "j": np.maximum(one, two), "dst": dst[r, c]})

    kind = dict(g.dtypes)["sample_id"]
    x = similar(g, finish, f"i {kind}, j {kind}, dst double")
    return ibs(g).select("i", "j", "dst").where(F.col("dst") >= least) if x is None else x


def nearest(g: DataFrame, k: int) -> DataFrame:
    """id, o, dst: each block's k most similar to a sample, ties by id; so the k most similar of all are among them."""
    def best(who, others, dst, may):
        d = np.where(may, dst, -1.0)
        m = min(k, d.shape[1])
        r, c = np.nonzero((d >= -np.partition(-d, m - 1, axis=1)[:, [m - 1]]) & may)
        order = np.lexsort((c, -d[r, c], r))
        r, c = r[order], c[order]
        start = np.searchsorted(r, np.arange(len(who)))
        at = np.arange(len(r)) - start[r] < k
        return pd.DataFrame({"id": who[r[at]], "o": others[c[at]], "dst": dst[r[at], c[at]]})

    def finish(items, a, b, once, dst, own):
        if a[0] in b:
            # Of one block: its slices meet all of it.
            return best(items[a], items[b], dst, ~np.isnan(dst) & (a[:, None] != b[None, :]))
        return pd.concat((best(items[a], items[b], dst, once), best(items[b], items[a], dst.T, once.T)), ignore_index=True)

    kind = dict(g.dtypes)["sample_id"]
    x = similar(g, finish, f"id {kind}, o {kind}, dst double")
    return _both_ways(ibs(g)) if x is None else x


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("i").alias("id"), F.col("j").alias("o"), "dst").unionByName(pairs.select(F.col("j").alias("id"), F.col("i").alias("o"), "dst"))


def ibd_expectations(g: DataFrame) -> DataFrame:
    """One row: means over variants of P(IBS | IBD), with the finite-sample corrections of moments."""
    x = g.where("dosage is not null").groupBy("vid").agg(F.sum("dosage").cast("double").alias("x"), (2.0 * F.count("*")).alias("t")).withColumn("y", F.col("t") - F.col("x")).where("x > 0 and y > 0 and t > 3")
    X, Y, T = F.col("x"), F.col("y"), F.col("t")
    p, q = X / T, Y / T
    c = [(X - k) / X for k in range(4)]
    d = [(Y - k) / Y for k in range(4)]
    t1, t2, t3 = T / (T - 1), T / (T - 2), T / (T - 3)
    return x.agg(
        F.avg(2 * p**2 * q**2 * c[1] * d[1] * t1 * t2 * t3).alias("e00"),
        F.avg(4 * p**3 * q * c[1] * c[2] * t1 * t2 * t3 + 4 * p * q**3 * d[1] * d[2] * t1 * t2 * t3).alias("e01"),
        F.avg(p**4 * c[1] * c[2] * c[3] * t1 * t2 * t3 + q**4 * d[1] * d[2] * d[3] * t1 * t2 * t3 + 4 * p**2 * q**2 * c[1] * d[1] * t1 * t2 * t3).alias("e02"),
        F.avg(2 * p**2 * q * c[1] * t1 * t2 + 2 * p * q**2 * d[1] * t1 * t2).alias("e11"),
        F.avg(p**3 * c[1] * c[2] * t1 * t2 + q**3 * d[1] * d[2] * t1 * t2 + p**2 * q * c[1] * t1 * t2 + p * q**2 * d[1] * t1 * t2).alias("e12"),
    )


def ibd(g: DataFrame) -> DataFrame:
    """i, j, z0, z1, z2, pi_hat: by moments, clipped to probabilities."""
    x = _states(g)[0].crossJoin(F.broadcast(ibd_expectations(g)))
    s = (F.col("ibs0") + F.col("ibs1") + F.col("ibs2")).cast("double")
    z0 = div(F.col("ibs0"), F.col("e00") * s)
    x = x.withColumn("s", s).withColumn("z0", z0).withColumn("z1", div(F.col("ibs1") - F.col("z0") * F.col("e01") * F.col("s"), F.col("e11") * F.col("s")))
    x = x.withColumn("z2", div(F.col("ibs2") - F.col("z0") * F.col("e02") * F.col("s") - F.col("z1") * F.col("e12") * F.col("s"), F.col("s")))
    x = x.withColumns({z: F.greatest(F.least(F.col(z), F.lit(1.0)), F.lit(0.0)) for z in ("z0", "z1", "z2")})
    total = F.col("z0") + F.col("z1") + F.col("z2")
    x = x.withColumn("total", total)
    x = x.select("i", "j", *(div(F.col(z), F.col("total")).alias(z) for z in ("z0", "z1", "z2")))
    return x.withColumn("pi_hat", F.col("z1") / 2 + F.col("z2"))


def missing_identity(g: DataFrame) -> DataFrame:
    """i, j, ibm: share of variants at which both or neither of two samples are missing."""
    features = {"m": called, "gone": lambda c: c == 1}
    wanted = {"n": ("m", "m"), "both": ("gone", "gone"), "first": ("gone", "m"), "second": ("m", "gone")}
    x = products(g.select("sample_id", "vid", F.col("dosage").isNull().cast("int").alias("gone")), "sample_id", "vid", "gone", features, wanted).where("n > 0")
    return x.select("i", "j", div(F.col("n") - F.col("first") - F.col("second") + 2 * F.col("both"), F.col("n")).alias("ibm"))


def neighbours(pairs: DataFrame, k1: int, k2: int) -> DataFrame:
    """id, rank, dst, z: the k1-th to k2-th nearest neighbours' similarity, against all samples' at that rank."""
    return _ranked(_both_ways(pairs), k1, k2)


def nearest_neighbours(g: DataFrame, k1: int, k2: int) -> DataFrame:
    """``neighbours`` of the pairs of ``ibs``, without a row for each pair."""
    return _ranked(nearest(g, k2), k1, k2)


def _ranked(both: DataFrame, k1: int, k2: int) -> DataFrame:
    x = both.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("dst"), "o"))).where(F.col("rank").between(k1, k2))
    # Read twice.
    x = cut(x.select("id", "rank", "dst"), "neighbours")
    m = x.groupBy("rank").agg(F.avg("dst").alias("m"), F.stddev_samp("dst").alias("sd"))
    return x.join(F.broadcast(m), "rank").select("id", "rank", "dst", div(F.col("dst") - F.col("m"), F.col("sd")).alias("z"))


def _variant_pairs(g: DataFrame, band: int, by: tuple[str, ...] = ()) -> DataFrame:
    """sample_id, v1, a, v2, b: pairs of calls of a sample, by blocks of ``band`` variants, each joined with itself and the next."""
    x = g.where("dosage is not null")
    a = x.select("sample_id", *by, F.col("vid").alias("v1"), F.col("dosage").cast("double").alias("a"))
    b = x.select("sample_id", F.col("vid").alias("v2"), F.col("dosage").cast("double").alias("b"))
    block = lambda c: F.floor(F.col(c) / band)
    b = b.withColumn("block", F.explode(F.array(block("v2"), block("v2") - 1)))
    return a.withColumn("block", block("v1")).join(b, ["sample_id", "block"]).where((F.col("v1") < F.col("v2")) & (F.col("v2") - F.col("v1") < band)).drop("block")


def _correlation(n: Column, sa: Column, sb: Column, saa: Column, sbb: Column, sab: Column) -> Column:
    return div(n * sab - sa * sb, F.sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)))


def ld(g: DataFrame, band: int | None = None, least_r2: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """v1, v2, r, r2 over samples with both calls; with ``band`` only variants fewer than so many apart."""
    if band is None:
        x = moments(g, "vid", "sample_id", "dosage", by).withColumnsRenamed({"i": "v1", "j": "v2"})
    else:
        a, b = F.col("a"), F.col("b")
        x = _variant_pairs(g, band, by).groupBy("v1", "v2", *by).agg(F.count("*").cast("double").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"), F.sum(a * b).alias("sab"))
    r = _correlation(*(F.col(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")))
    x = x.select("v1", "v2", *by, r.alias("r")).withColumn("r2", F.col("r") * F.col("r"))
    return x.where(F.col("r2") >= least_r2) if least_r2 > 0 else x


def tags(g: DataFrame, targets: DataFrame, band: int, least_r2: float = 0.8) -> DataFrame:
    """vid, n_tags: variants that tag each target."""
    r = ld(g, band, least_r2)
    both = r.select(F.col("v1").alias("vid"), F.col("v2").alias("tag")).unionByName(r.select(F.col("v2").alias("vid"), F.col("v1").alias("tag")))
    return targets.select("vid").join(both, "vid", "left").groupBy("vid").agg(F.count("tag").alias("n_tags"))


def flip_scan(g: DataFrame, s: DataFrame, band: int, least: float = 0.1) -> DataFrame:
    """vid, pos, neg: neighbours correlated alike, or oppositely, in cases and controls."""
    r = ld(g.join(s.select("sample_id", "aff"), "sample_id"), band, by=("aff",)).groupBy("v1", "v2").agg(F.max(F.when(F.col("aff"), F.col("r"))).alias("ra"), F.max(F.when(~F.col("aff"), F.col("r"))).alias("ru")).where((F.abs("ra") >= least) & (F.abs("ru") >= least))
    both = r.select(F.col("v1").alias("vid"), "ra", "ru").unionByName(r.select(F.col("v2").alias("vid"), "ra", "ru"))
    return both.groupBy("vid").agg(n_if(F.col("ra") * F.col("ru") > 0).alias("pos"), n_if(F.col("ra") * F.col("ru") < 0).alias("neg"))


def ld_prune(g: DataFrame, v: DataFrame, window: int, step: int, most_r2: float) -> DataFrame:
    """vid, kept: pairwise pruning in sliding windows; the second of a correlated pair goes.

    The pairs within a window's reach come from Spark; the pass over a chromosome's pairs, in order, is one group.
    """
    import pandas as pd

    w = Window.partitionBy("chr").orderBy("bp", "vid")
    order = v.withColumn("idx", F.row_number().over(w) - 1).select("vid", "chr", "idx")
    # A variant's place in its chromosome, chromosomes far apart: only pairs within a window's reach are formed.
    far = 1 << 40
    placed = g.join(order.select("vid", (F.col("chr").cast("long") * far + F.col("idx")).alias("place")), "vid").select("sample_id", F.col("place").alias("vid"), "dosage")
    edges = ld(placed, window, most_r2).select(F.floor(F.col("v1") / far).cast("int").alias("chr"), (F.col("v1") % far).cast("int").alias("i"), (F.col("v2") % far).cast("int").alias("j"))
    vs = order.groupBy("chr").agg(F.array_sort(F.collect_list(F.struct("idx", "vid"))).alias("vs"))

    def prune(rows):
        for batch in rows:
            out = []
            for chrom, vids, pairs in zip(batch["chr"], batch["vs"], batch["es"], strict=True):
                ids, gone = [x["vid"] for x in vids], set()
                links: dict[int, list[int]] = {}
                for e in pairs if pairs is not None else []:
                    links.setdefault(e["i"], []).append(e["j"])
                for start in range(0, len(ids), step):
                    for i in range(start, min(len(ids), start + window)):
                        if i not in gone:
                            gone.update(j for j in links.get(i, []) if j < start + window)
                out += [(chrom, vid, k not in gone) for k, vid in enumerate(ids)]
            yield pd.DataFrame(out, columns=["chr", "vid", "kept"])

    es = edges.groupBy("chr").agg(F.collect_list(F.struct("i", "j")).alias("es"))
    return vs.join(es, "chr", "left").mapInPandas(prune, "chr int, vid int, kept boolean").select("vid", "kept")


def clump(results: DataFrame, r2: DataFrame, p1: float = 1e-4, p2: float = 1e-2, least_r2: float = 0.5) -> list[dict]:
    """Greedy clumps: the best open variant takes all open ones correlated with it.  Candidates (p <= p2) are few by design."""
    cand = {r.vid: r.p for r in results.where(F.col("p") <= p2).select("vid", "p").collect()}
    ids = results.sparkSession.createDataFrame([(k,) for k in cand], "vid int")
    near: dict[int, set[int]] = {}
    pairs = r2.where(F.col("r2") >= least_r2).join(ids.withColumnRenamed("vid", "v1"), "v1", "left_semi").join(ids.withColumnRenamed("vid", "v2"), "v2", "left_semi")
    for r in pairs.select("v1", "v2").collect():
        near.setdefault(r.v1, set()).add(r.v2)
        near.setdefault(r.v2, set()).add(r.v1)
    taken, out = set(), []
    for vid in sorted(cand, key=lambda k: (cand[k], k)):
        if vid in taken or cand[vid] > p1:
            continue
        members = sorted(near.get(vid, set()) - taken - {vid})
        taken |= {vid, *members}
        ps = [cand[m] for m in members]
        out.append({"index": vid, "p": cand[vid], "total": len(members), "nsig": sum(p > 0.05 for p in ps), "s05": sum(0.01 < p <= 0.05 for p in ps), "s01": sum(0.001 < p <= 0.01 for p in ps), "s001": sum(1e-4 < p <= 0.001 for p in ps), "s0001": sum(p <= 1e-4 for p in ps), "members": members})
    return out


def two_locus(g: DataFrame, s: DataFrame) -> DataFrame:
    """v1, v2, d1, d2, n_aff, n_unaff: genotype by genotype counts of all pairs of variants."""
    x = cells_of(genotype_pairs(g.join(s.select("sample_id", "aff"), "sample_id"), ("aff",)), "d1", "d2", "n")
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return x.groupBy("v1", "v2", "d1", "d2").agg(side(F.col("aff")).alias("n_aff"), side(~F.col("aff")).alias("n_unaff"))


def fast_epistasis(g: DataFrame, s: DataFrame, case_only: bool = False) -> DataFrame:
    """v1, v2, z: difference of the log odds of allele pairs in cases and controls, or those of cases alone.

    The four allele-pair counts of two dosages are their products with each other's complement.
    """
    aff, cells = F.col("aff"), {"p": lambda a, b: a * b, "q": lambda a, b: a * (2 - b), "r": lambda a, b: (2 - a) * b, "t": lambda a, b: (2 - a) * (2 - b)}
    x = genotype_pairs(g.join(s.select("sample_id", "aff"), "sample_id"), ("aff",))
    total = lambda e: sum((e(a, b) * F.col(f"n{a}{b}") for a in range(3) for b in range(3) if e(a, b)), F.lit(0.0))
    x = x.groupBy("v1", "v2").agg(*(F.sum(F.when(c, total(e)).otherwise(0.0)).alias(f"{k}{n}") for n, c in (("a", aff), ("u", ~aff)) for k, e in cells.items()))
    side = lambda n: [F.col(k + n) for k in cells]

    def log_odds(n):
        p, q, r, t = side(n)
        return F.when(F.least(p, q, r, t) > 0, F.log(F.when(p * t > 0, p * t).otherwise(1.0) / F.when(q * r > 0, q * r).otherwise(1.0))), div(F.lit(1), p) + div(F.lit(1), q) + div(F.lit(1), r) + div(F.lit(1), t)

    la, va = log_odds("a")
    if case_only:
        return x.select("v1", "v2", F.abs(div(la, F.sqrt(va))).alias("z"))
    lu, vu = log_odds("u")
    return x.select("v1", "v2", F.abs(div(la - lu, F.sqrt(va + vu))).alias("z"))


def best_partner(pairs: DataFrame) -> DataFrame:
    """vid, n, best, z: tests, best partner and its z, by each variant."""
    both = pairs.select(F.col("v1").alias("vid"), F.col("v2").alias("o"), "z").unionByName(pairs.select(F.col("v2").alias("vid"), F.col("v1").alias("o"), "z"))
    x = both.where("z is not null").groupBy("vid").agg(F.count("*").alias("n"), F.max(F.struct(F.col("z"), (-F.col("o")).alias("o"))).alias("b"))
    return x.select("vid", "n", (-F.col("b.o")).alias("best"), F.col("b.z").alias("z"))


def within_bounds(pairs: DataFrame, by: str, least: float | None = None, most: float | None = None) -> DataFrame:
    """Pairs of samples whose relatedness lies between two bounds, either of which may be absent."""
    x = pairs if least is None else pairs.where(F.col(by) >= least)
    return x if most is None else x.where(F.col(by) <= most)


def between_lists(pairs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs (i, j) with one sample in each list (sample_id)."""
    has = lambda x, ids, c: x.join(ids.select(F.col("sample_id").alias(c)).distinct(), c, "left_semi")
    one, other = has(has(pairs, first, "i"), second, "j"), has(has(pairs, second, "i"), first, "j")
    return one.unionByName(other).dropDuplicates(["i", "j"]).select(*pairs.columns)


def far_apart(pairs: DataFrame, v: DataFrame, gap: int) -> DataFrame:
    """Pairs of variants (v1, v2) on different chromosomes, or at least ``gap`` positions apart."""
    at = lambda n: v.select(F.col("vid").alias(f"v{n}"), F.col("chr").alias(f"c{n}"), F.col("bp").alias(f"b{n}"))
    x = pairs.join(at(1), "v1").join(at(2), "v2").where((F.col("c1") != F.col("c2")) | (F.abs(F.col("b1") - F.col("b2")) >= gap))
    return x.select(*pairs.columns)


def across_sets(pairs: DataFrame, first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Pairs of variants with one in the first set (vid) and the other in the second, or anywhere where there is none."""
    has = lambda x, ids, c: x.join(ids.select(F.col("vid").alias(c)).distinct(), c, "left_semi")
    meet = lambda a, b: has(pairs, first, a) if second is None else has(has(pairs, first, a), second, b)
    return meet("v1", "v2").unionByName(meet("v2", "v1")).dropDuplicates(["v1", "v2"]).select(*pairs.columns)
