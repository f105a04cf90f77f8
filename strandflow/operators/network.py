"""Coexpression networks: correlations by pairs of attributes, differences between groups, and graph methods.

Pair statistics come from sums of products, aggregated in Spark.  Graph methods work on the attributes' square matrix, whose side is
the number of attributes, in numpy on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions.stats import div, upper_tail
from strandflow.lineage import cut
from strandflow.operators.products import moments

#: Attributes whose matrix the driver takes.
MOST = 20_000


def pair_moments(num: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """i, j (i <= j), n and sums over samples that have both attributes."""
    return moments(num, "attr_id", "sample_id", "value", by, diagonal=True)


def covariance(num: DataFrame) -> DataFrame:
    """i, j, cov, r: sample covariance and correlation."""
    n, sa, sb, saa, sbb, sab = (F.col(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab"))
    return pair_moments(num).select("i", "j", div(sab - sa * sb / n, n - 1).alias("cov"), div(n * sab - sa * sb, F.sqrt((n * saa - sa * sa) * (n * sbb - sb * sb))).alias("r"))


def coexpression(num: DataFrame, s: DataFrame) -> DataFrame:
    """i, j, r_aff, r_unaff, n_aff, n_unaff, diff: correlations in cases and controls, i < j."""
    n, sa, sb, saa, sbb, sab = (F.col(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab"))
    x = pair_moments(num.join(s.select("sample_id", "aff"), "sample_id"), ("aff",)).where("i < j").select("aff", "i", "j", "n", div(n * sab - sa * sb, F.sqrt((n * saa - sa * sa) * (n * sbb - sb * sb))).alias("r"))
    pick = lambda c, k: F.max(F.when(F.col("aff") == k, F.col(c)))
    x = x.groupBy("i", "j").agg(pick("r", True).alias("r_aff"), pick("r", False).alias("r_unaff"), pick("n", True).alias("n_aff"), pick("n", False).alias("n_unaff"))
    return x.withColumn("diff", F.col("r_aff") - F.col("r_unaff"))


def _atanh(r):
    return 0.5 * F.log((1 + r) / (1 - r))


def dcgain(num: DataFrame, s: DataFrame) -> DataFrame:
    """i, j, z, p: difference of the correlations' Fisher transforms; at least 4 samples a group, no perfect correlation."""
    x = coexpression(num, s).where("n_aff > 3 and n_unaff > 3 and abs(r_aff) < 1 and abs(r_unaff) < 1")
    z = F.abs(_atanh(F.col("r_aff")) - _atanh(F.col("r_unaff"))) / F.sqrt(1 / (F.col("n_aff") - 3) + 1 / (F.col("n_unaff") - 3))
    return x.select("i", "j", z.alias("z")).withColumn("p", 2 * upper_tail(F.col("z")))


def dmgain(num: DataFrame, s: DataFrame) -> DataFrame:
    """i, j, z: difference of the correlations less what the attributes' degrees let expect."""
    x = coexpression(num, s)
    n = x.agg(F.max("n_aff").alias("na"), F.max("n_unaff").alias("nu"))
    ends = x.select(F.col("i").alias("k"), "r_aff", "r_unaff").unionByName(x.select(F.col("j").alias("k"), "r_aff", "r_unaff"))
    deg = ends.groupBy("k").agg((F.sum("r_aff") + 1).alias("ka"), (F.sum("r_unaff") + 1).alias("ku"))
    total = deg.agg(F.sum("ka").alias("ma"), F.sum("ku").alias("mu"))
    di, dj = (deg.select(F.col("k").alias(c), F.col("ka").alias(f"ka_{c}"), F.col("ku").alias(f"ku_{c}")) for c in "ij")
    x = x.join(di, "i").join(dj, "j").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(n))
    a = F.col("r_aff") - F.col("ka_i") * F.col("ka_j") / F.col("ma")
    u = F.col("r_unaff") - F.col("ku_i") * F.col("ku_j") / F.col("mu")
    return x.select("i", "j", (F.abs(a - u) / F.sqrt(1 / (F.col("na") - 3) + 1 / (F.col("nu") - 3))).alias("z"))


def _blocks(num: DataFrame, g: DataFrame) -> tuple[DataFrame, list[int], list[int]]:
    """A row for each sample with its values and dosages, as arrays in the order of the attributes and variants."""
    attrs = [r.k for r in num.select(F.col("attr_id").alias("k")).distinct().orderBy("k").collect()]
    vids = [r.k for r in g.select(F.col("vid").alias("k")).distinct().orderBy("k").collect()]
    row = lambda x, key, value, keys, name: x.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m")).select("sample_id", F.transform(F.array(*map(F.lit, keys)), lambda k: F.col("m")[k].cast("double")).alias(name))
    return row(num.where("value is not null"), "attr_id", "value", attrs, "x").join(row(g.where("dosage is not null"), "vid", "dosage", vids, "d"), "sample_id"), attrs, vids


def dcvar(num: DataFrame, g: DataFrame, model: str = "dom") -> DataFrame:
    """vid, i, j, z, p: dcgain between the two groups that each variant's genotype model makes, for all variants at once.

    A batch of samples gives the sums of products of each variant's two groups as matrix products; the sums are added by variant and pair.
    """
    rows, attrs, vids = _blocks(num, g)
    rule = {"dom": lambda d: (d > 0, d == 0), "rec": lambda d: (d == 2, d < 2), "hom": lambda d: (d == 2, d == 0)}[model]
    up = np.triu_indices(len(attrs), 1)
    ai, aj = np.array(attrs, np.int32)[up[0]], np.array(attrs, np.int32)[up[1]]
    names = ["n", "sa", "sb", "saa", "sbb", "sab"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            # Nulls become NaN: a missing value or call takes no part.
            x, d = (np.array([[np.nan if v is None else v for v in r] for r in b.column(c).to_pylist()], float) for c in ("x", "d"))
            seen, x0 = ~np.isnan(x), np.nan_to_num(x)
            for k, vid in enumerate(vids):
                for first, group in zip((True, False), rule(d[:, k]), strict=True):
                    m, v = seen[group].astype(float), x0[group]
                    sums = [m.T @ m, v.T @ m, m.T @ v, (v * v).T @ m, m.T @ (v * v), v.T @ v]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ai), vid, np.int32)), pa.array(np.full(len(ai), first)), pa.array(ai), pa.array(aj), *(pa.array(s[up]) for s in sums)], ["vid", "aff", "i", "j", *names])

    m = rows.select("x", "d").mapInArrow(run, "vid int, aff boolean, i int, j int, " + ", ".join(f"{n} double" for n in names))
    m = m.groupBy("vid", "aff", "i", "j").agg(*(F.sum(n).alias(n) for n in names))
    n, sa, sb, saa, sbb, sab = (F.col(c) for c in names)
    m = m.select("vid", "aff", "i", "j", "n", div(n * sab - sa * sb, F.sqrt((n * saa - sa * sa) * (n * sbb - sb * sb))).alias("r"))
    pick = lambda c, k: F.max(F.when(F.col("aff") == k, F.col(c)))
    m = m.groupBy("vid", "i", "j").agg(pick("r", True).alias("r1"), pick("r", False).alias("r2"), pick("n", True).alias("n1"), pick("n", False).alias("n2")).where("n1 > 3 and n2 > 3 and abs(r1) < 1 and abs(r2) < 1")
    z = F.abs(_atanh(F.col("r1")) - _atanh(F.col("r2"))) / F.sqrt(1 / (F.col("n1") - 3) + 1 / (F.col("n2") - 3))
    return m.select("vid", "i", "j", z.alias("z")).withColumn("p", 2 * upper_tail(F.col("z")))


def transform_edges(edges: DataFrame, how: str, x: float = 0.0) -> DataFrame:
    """power, fisher, hard (keep above), binary (1 above) or soft (logistic) thresholds of edge weights."""
    w = F.col("weight")
    new = {"power": F.signum(w) * F.abs(w) ** x, "fisher": _atanh(F.greatest(F.least(w, F.lit(0.999999)), F.lit(-0.999999))), "hard": F.when(F.abs(w) > x, w).otherwise(0.0), "binary": F.when(F.abs(w) > x, 1.0).otherwise(0.0), "soft": 1 / (1 + F.exp(-(F.abs(w) - x)))}[how]
    return edges.withColumn("weight", new)


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, strength."""
    both = edges.select(F.col("i").alias("node"), "weight").unionByName(edges.where("i <> j").select(F.col("j").alias("node"), "weight"))
    return both.groupBy("node").agg(F.count(F.when(F.col("weight") != 0, 1)).alias("degree"), F.sum("weight").alias("strength"))


def matrix(edges: DataFrame) -> tuple[list, np.ndarray]:
    """Names and symmetric matrix of an edge table (i, j, weight)."""
    n = edges.select("i").union(edges.select("j")).agg(F.count_distinct("i")).first()[0]
    if n > MOST:
        raise ValueError(f"{n} attributes are too many for a matrix on the driver; the bound is {MOST}")
    rows = edges.select("i", "j", "weight").toPandas()
    names = sorted({*rows["i"], *rows["j"]})
    at = {k: n for n, k in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    i, j = rows["i"].map(at).to_numpy(int), rows["j"].map(at).to_numpy(int)
    m[i, j] = m[j, i] = rows["weight"].to_numpy(float)
    return names, m


def edges_of(spark, names: list, m: np.ndarray, zero: bool = False) -> DataFrame:
    """Upper triangle of a matrix as an edge table."""
    i, j = np.triu_indices(len(names))
    keep = np.ones(len(i), bool) if zero else m[i, j] != 0
    return spark.createDataFrame([(names[a], names[b], float(m[a, b])) for a, b in zip(i[keep], j[keep], strict=True)], "i int, j int, weight double")


def snprank(m: np.ndarray, gamma: float | None = 0.85, power: bool = False, tolerance: float = 1e-4) -> np.ndarray:
    """Centrality of each attribute: its share of the main effects, and what its neighbours hand on by weight.

    ``gamma`` None: by each attribute's share of weights.  Solved directly, or by the power method.
    """
    n, diag = len(m), np.diag(m).copy()
    g = m - np.diag(diag)
    col = g.sum(axis=0)
    hand = np.divide(g, col, out=np.zeros_like(g), where=col != 0)
    if gamma is None:
        below = (g != 0) @ col
        each = np.divide(g.sum(axis=1), below, out=np.zeros(n), where=below != 0)
    else:
        each = np.full(n, gamma)
    # What a neighbour hands on is damped by the neighbour's own share: along columns.
    damp = np.broadcast_to(each, (n, n))
    trace = diag.sum()
    base = (1 - each) / n + (diag / (n * trace) if trace else 0)
    if power:
        r = np.full(n, 1 / n)
        for _ in range(10_000):
            new = (damp * hand) @ r + base
            if np.abs(new - r).max() < tolerance:
                break
            r = new
        return new / new.sum()
    r = np.linalg.solve(np.eye(n) - damp * hand, base)
    return r / r.sum()


def modularity(a: np.ndarray) -> tuple[float, np.ndarray]:
    """Q and module of each node: repeated bisection by the sign of the leading eigenvector while Q grows."""
    k, two_m = a.sum(axis=1), a.sum()
    module = np.zeros(len(a), int)
    if two_m == 0:
        return 0.0, module
    b = a - np.outer(k, k) / two_m
    open_sets, count, q = [np.arange(len(a))], 1, 0.0
    while open_sets:
        at = open_sets.pop()
        if len(at) < 2:
            continue
        part = b[np.ix_(at, at)]
        part = part - np.diag(part.sum(axis=1))
        values, vectors = np.linalg.eigh(part)
        s = np.where(vectors[:, -1] >= 0, 1.0, -1.0)
        gain = float(s @ part @ s) / (2 * two_m)
        if values[-1] <= 1e-9 or gain <= 1e-12 or abs(s.sum()) == len(s):
            continue
        module[at[s < 0]] = count
        count += 1
        q += gain
        open_sets += [at[s > 0], at[s < 0]]
    together = module[:, None] == module[None, :]
    return float((b * together).sum() / two_m), module


def homophily(a: np.ndarray, module: np.ndarray) -> np.ndarray:
    """Share of each module's weight that stays in it."""
    return np.array([a[np.ix_(module == k, module == k)].sum() / max(1e-300, a[module == k].sum()) for k in range(module.max() + 1)])


def indirect_paths(a: np.ndarray, order: int) -> np.ndarray:
    """Sum of the matrix's powers up to an order."""
    out, power = a.copy(), a.copy()
    for _ in range(order - 1):
        power = power @ a
        out += power
    return out


def ripm(a: np.ndarray, most: int, least: int, order: int = 2) -> np.ndarray:
    """Module of each node: modules larger than ``most`` are split again, smaller than ``least`` join the one they reach best by indirect paths."""
    module = np.zeros(len(a), int)
    queue, done = [np.arange(len(a))], []
    while queue:
        at = queue.pop()
        sub = modularity(a[np.ix_(at, at)])[1]
        if len(at) <= most or sub.max() == 0:
            done.append(at)
        else:
            queue += [at[sub == k] for k in range(sub.max() + 1)]
    done.sort(key=lambda x: int(x[0]))
    reach = indirect_paths(a, order)
    while len(done) > 1 and min(map(len, done)) < least:
        small = min(range(len(done)), key=lambda k: (len(done[k]), int(done[k][0])))
        at = done.pop(small)
        to = max(range(len(done)), key=lambda k: (reach[np.ix_(at, done[k])].mean(), -int(done[k][0])))
        done[to] = np.sort(np.concatenate((done[to], at)))
    for k, at in enumerate(done):
        module[at] = k
    return module


def permuted_ranks(num: DataFrame, s: DataFrame, n: int, q: float = 0.95, seed: int = 1) -> DataFrame:
    """attribute, score, threshold: centrality in the differential network, and its floor-index quantile under label shuffles.

    All replicates' correlations are one aggregation; the driver takes one square matrix at a time.
    """
    from strandflow.operators.permutation import shuffled

    spark = s.sparkSession
    reps = spark.range(1, n + 1).select(F.col("id").cast("int").alias("rep"))
    labels = shuffled(s, "aff", reps, seed).unionByName(s.select(F.lit(0).alias("rep"), "sample_id", F.col("aff").alias("label"))).withColumnRenamed("label", "aff")
    c, sa, sb, saa, sbb, sab = (F.col(x) for x in ("n", "sa", "sb", "saa", "sbb", "sab"))
    x = pair_moments(num.join(labels, "sample_id"), ("rep", "aff"))
    x = x.where("i < j").select("rep", "aff", "i", "j", "n", div(c * sab - sa * sb, F.sqrt((c * saa - sa * sa) * (c * sbb - sb * sb))).alias("r"))
    pick = lambda k, v: F.max(F.when(F.col("aff") == v, F.col(k)))
    x = x.groupBy("rep", "i", "j").agg(pick("r", True).alias("r1"), pick("r", False).alias("r2"), pick("n", True).alias("n1"), pick("n", False).alias("n2")).where("n1 > 3 and n2 > 3 and abs(r1) < 1 and abs(r2) < 1")
    z = F.abs(_atanh(F.col("r1")) - _atanh(F.col("r2"))) / F.sqrt(1 / (F.col("n1") - 3) + 1 / (F.col("n2") - 3))
    x = cut(x.select("rep", "i", "j", z.alias("weight")), "ranks")
    names, m = matrix(x.where("rep = 0").drop("rep"))
    seen = snprank(m)
    null = np.sort(np.stack([snprank(matrix(x.where(F.col("rep") == k).drop("rep"))[1]) for k in range(1, n + 1)]), axis=0)
    bound = null[min(n - 1, int(q * n))]
    return spark.createDataFrame([(int(a), float(b), float(t)) for a, b, t in zip(names, seen, bound, strict=True)], "attribute int, score double, threshold double")


def deconvolve(m: np.ndarray, keep: float = 1.0, beta: float = 0.9, control: bool = False) -> np.ndarray:
    """Direct weights behind a matrix of direct and indirect ones: eigenvalues l / (scale + l), scaled to 0..1."""
    a = m - np.diag(np.diag(m))
    cut = np.quantile(a, 1 - keep) if keep < 1 else -np.inf
    a = np.where(a >= cut, a, 0)
    a = (a + a.T) / 2
    values, vectors = np.linalg.eigh(a)
    low, high = abs(min(values.min(), 0)), max(values.max(), 0)
    scale = max(beta and high * (1 - beta) / beta, low * (1 + beta) / beta)
    direct = (vectors * (values / (scale + values))) @ vectors.T
    if not control:
        direct = np.where(direct >= 0, direct, 0)
    span = direct.max() - direct.min()
    return (direct - direct.min()) / span if span else direct
