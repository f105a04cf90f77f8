"""Linear and logistic models: numpy kernels, and their use for each variant or pair in Arrow groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions.stats import chi2_sf, f_sf, t_sf2


def _valid(beta: np.ndarray, cov: np.ndarray) -> bool:
    var = np.diag(cov)
    if not (np.isfinite(beta).all() and np.isfinite(cov).all()) or (var < 1e-20).any():
        return False
    sd = np.sqrt(var)
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    return bool((corr <= 0.99999).all())


def linear(x: np.ndarray, y: np.ndarray, clusters: np.ndarray | None = None) -> dict:
    """Least squares; with clusters the covariance is robust to them."""
    n, k = x.shape
    u, d, vt = np.linalg.svd(x, full_matrices=False)
    inv = np.where(d > 1e-13 * d.max(initial=0), 1 / np.where(d > 0, d, 1), 0) if n else d
    xtx = (vt.T * inv**2) @ vt
    beta = vt.T @ (inv * (u.T @ y))
    res = y - x @ beta
    rss = float(res @ res)
    if clusters is None:
        cov = xtx * rss / max(1, n - k)
    else:
        score = pd.DataFrame(x * res[:, None]).groupby(clusters).sum().to_numpy()
        cov = xtx @ (score.T @ score) @ xtx
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(all="ignore"):
        t = beta / se
    tss = float(((y - y.mean()) ** 2).sum()) if n else 0.0
    ok = n > k and _valid(beta, cov)
    return {"beta": beta, "se": se, "stat": t, "p": t_sf2(t, n - k) if ok else np.full(k, np.nan), "cov": cov, "rss": rss, "r2": 1 - rss / tss if tss else np.nan, "n": n, "ok": ok}


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 25, tolerance: float = 1e-8) -> dict:
    """Newton-Raphson from 0; what doesn't converge, as with separation, is not ok rather than an error."""
    n, k = x.shape
    beta, done, cov = np.zeros(k), False, np.full((k, k), np.nan)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        w = p * (1 - p)
        try:
            cov = np.linalg.inv((x * w[:, None]).T @ x)
        except np.linalg.LinAlgError:
            break
        step = cov @ (x.T @ (y - p))
        beta = beta + step
        if not np.isfinite(beta).all():
            break
        if np.abs(step).sum() < tolerance:
            done = True
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -500, 500))), 1e-300, 1 - 1e-16)
    with np.errstate(all="ignore"):
        se = np.sqrt(np.diag(cov))
        z = beta / se
    ok = done and _valid(beta, cov)
    return {"beta": beta, "se": se, "stat": z, "p": chi2_sf(z * z, 1) if ok else np.full(k, np.nan), "cov": cov, "ll2": float(-2 * (y * np.log(p) + (1 - y) * np.log1p(-p)).sum()), "n": n, "ok": ok}


def joint_test(fit: dict, h: np.ndarray, value: np.ndarray | None = None) -> tuple[float, int, float]:
    """Wald chi-square of H beta = value, its degrees and p."""
    d = h @ fit["beta"] - (0 if value is None else value)
    stat = float(d @ np.linalg.pinv(h @ fit["cov"] @ h.T) @ d)
    return stat, len(h), float(chi2_sf(stat, len(h)))


def nested_p(full: dict, part: dict, k_full: int, k_part: int) -> float:
    """F test of two linear fits, or likelihood ratio of two logistic ones."""
    df = k_full - k_part
    if "ll2" in full:
        return float(chi2_sf(max(0.0, part["ll2"] - full["ll2"]), df))
    rest = full["n"] - k_full
    return float(f_sf(max(0.0, (part["rss"] - full["rss"]) / df / (full["rss"] / rest)), df, rest))


#: Dosage codings by name.
CODING = {"add": lambda d: [("ADD", d)], "dom": lambda d: [("DOM", (d > 0) * 1.0)], "rec": lambda d: [("REC", (d == 2) * 1.0)], "genotypic": lambda d: [("ADD", d), ("DOMDEV", (d == 1) * 1.0)], "hethom": lambda d: [("HOM", (d == 2) * 1.0), ("HET", (d == 1) * 1.0)]}
GLM = "vid int, test string, nmiss int, beta double, se double, stat double, p double"


def glm(g: DataFrame, s: DataFrame, kind: str = "linear", model: str = "add", covariates: Sequence[str] = (), interaction: bool = False, parameters: Sequence[str] | None = None, tests: Sequence[str] = (), clusters: str | None = None) -> DataFrame:
    """Rows of tests for each variant: its terms, covariates, and their products if asked for.  Null covariates leave a sample out.

    ``parameters`` names the terms that stay (None: all), ``tests`` those that are tested jointly besides (a row ``USER_kDF``),
    ``clusters`` a column to whose values a linear model's errors are robust.  A group is one variant's samples; samples' columns
    travel once, joined on the sample.
    """
    y = "aff" if kind == "logistic" else "pheno"
    cols = ["sample_id", F.col(y).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"c_{c}") for c in covariates), *([F.col(clusters).alias("k_")] if clusters else [])]
    x = g.where("dosage is not null").join(s.select(*cols).na.drop(), "sample_id").drop("sample_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf["dosage"].to_numpy(float)
        terms = CODING[model](d)
        extra = [(c, pdf[f"c_{c}"].to_numpy(float)) for c in covariates]
        names = [n for n, _ in (*terms, *extra)]
        cs = [v for _, v in (*terms, *extra)]
        if interaction:
            for n, v in terms:
                for m, w in extra:
                    names.append(f"{n}x{m}")
                    cs.append(v * w)
        if parameters is not None:
            stay = [i for i, n in enumerate(names) if n in parameters]
            names, cs, terms_ = [names[i] for i in stay], [cs[i] for i in stay], [x for x in terms if x[0] in parameters]
        else:
            terms_ = terms
        xs = np.column_stack([np.ones(len(d)), *cs])
        f = linear(xs, pdf["y"].to_numpy(float), pdf["k_"].to_numpy() if clusters else None) if kind == "linear" else logistic(xs, pdf["y"].to_numpy(float))
        bad = np.nan if not f["ok"] else 0.0
        rows = [(pdf["vid"].iloc[0], n, len(d), f["beta"][i] + bad, f["se"][i] + bad, f["stat"][i] + bad, f["p"][i]) for i, n in enumerate(names, 1)]
        joint = [("GENO", range(1, 1 + len(terms_)))] if len(terms_) > 1 else []
        joint += [("USER", [i for i, n in enumerate(names, 1) if n in tests])] if tests else []
        for name, at in joint:
            stat, df, p = joint_test(f, np.eye(xs.shape[1])[list(at)]) if f["ok"] and len(at) else (np.nan, len(at), np.nan)
            rows.append((pdf["vid"].iloc[0], f"{name}_{df}DF", len(d), np.nan, np.nan, stat, p))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in GLM.split(", ")])

    return x.groupBy("vid").applyInPandas(run, GLM)


def condition(s: DataFrame, g: DataFrame, vids: Sequence[int]) -> DataFrame:
    """Samples with the dosages of some variants as columns ``cond_<vid>``, for models on condition of them (null where not called)."""
    x = g.where(F.col("vid").isin(*vids)).groupBy("sample_id").pivot("vid", list(vids)).agg(F.first("dosage"))
    return s.join(x.select("sample_id", *(F.col(f"`{v}`").alias(f"cond_{v}") for v in vids)), "sample_id", "left")


def x_dosage(g: DataFrame, v: DataFrame, s: DataFrame, x_code: int, one_copy: bool = True) -> DataFrame:
    """Dosages of which males have one copy at X variants (0 or 1), or as much as females (0 or 2); a male's heterozygous call is missing."""
    x = g.join(v.select("vid", (F.col("chr") == x_code).alias("on_x")), "vid").join(s.select("sample_id", (F.col("sex") == 1).alias("male")), "sample_id")
    d, single = F.col("dosage").cast("double"), F.col("on_x") & F.col("male")
    return x.select("sample_id", "vid", F.when(single & (d == 1), None).when(single & F.lit(one_copy), d / 2).otherwise(d).alias("dosage"))


PAIRS = "v1 int, v2 int, beta double, stat double, p double"


def epistasis(g: DataFrame, s: DataFrame, kind: str = "logistic", most_p: float = 1.0, covariates: Sequence[str] = ()) -> DataFrame:
    """v1, v2 and the interaction's test, of all pairs of variants: a group is one pair's samples."""
    y = "aff" if kind == "logistic" else "pheno"
    x = g.where("dosage is not null").join(s.select("sample_id", F.col(y).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"c_{c}") for c in covariates)).na.drop(), "sample_id")
    a = x.withColumnsRenamed({"vid": "v1", "dosage": "a"})
    b = x.select("sample_id", F.col("vid").alias("v2"), F.col("dosage").alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
        xs = np.column_stack([np.ones(len(p)), p, q, *(pdf[f"c_{c}"].to_numpy(float) for c in covariates), p * q])
        f = linear(xs, pdf["y"].to_numpy(float)) if kind == "linear" else logistic(xs, pdf["y"].to_numpy(float))
        row = (f["beta"][-1], f["stat"][-1], f["p"][-1]) if f["ok"] else (np.nan,) * 3
        return pd.DataFrame([(pdf["v1"].iloc[0], pdf["v2"].iloc[0], *row)], columns=["v1", "v2", "beta", "stat", "p"])

    out = a.join(b, "sample_id").where("v1 < v2").groupBy("v1", "v2").applyInPandas(run, PAIRS)
    return out if most_p >= 1 else out.where(F.col("p") <= most_p)


def regain(num: DataFrame, s: DataFrame, kind: str = "logistic", covariates: Sequence[str] = (), use_beta: bool = False, threshold: float = 0.0) -> DataFrame:
    """i, j, weight, p: main effects on the diagonal, interactions off it.

    The tested coefficient is always the last column; the diagonal stays the main effect.
    """
    y = "aff" if kind == "logistic" else "pheno"
    t = s.select("sample_id", F.col(y).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"c_{c}") for c in covariates)).na.drop()
    x = num.where("value is not null").join(t, "sample_id")
    a = x.withColumnsRenamed({"attr_id": "i", "value": "a"})
    b = num.where("value is not null").select("sample_id", F.col("attr_id").alias("j"), F.col("value").alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        p, q = pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
        cov = [pdf[f"c_{c}"].to_numpy(float) for c in covariates]
        xs = np.column_stack([np.ones(len(p)), *cov, p] if i == j else [np.ones(len(p)), p, q, *cov, p * q])
        f = linear(xs, pdf["y"].to_numpy(float)) if kind == "linear" else logistic(xs, pdf["y"].to_numpy(float))
        w = (f["beta"] if use_beta else f["stat"])[-1] if f["ok"] else 0.0
        return pd.DataFrame([(i, j, float(w) if abs(w) >= threshold else 0.0, f["p"][-1] if f["ok"] else 1.0)], columns=["i", "j", "weight", "p"])

    return a.join(b, "sample_id").where("i <= j").groupBy("i", "j").applyInPandas(run, "i int, j int, weight double, p double")


def eqtl(g: DataFrame, num: DataFrame, cis: DataFrame | None = None) -> DataFrame:
    """attr_id, vid, n, beta, t: each attribute on each variant (or those of ``cis``), by moments in one aggregation."""
    x = g.where("dosage is not null").withColumn("d", F.col("dosage").cast("double")).join(num.where("value is not null"), "sample_id")
    if cis is not None:
        x = x.join(cis.select("attr_id", "vid"), ["attr_id", "vid"], "left_semi")
    x = x.groupBy("attr_id", "vid").agg(F.count("*").alias("n"), F.var_samp("d").alias("vg"), F.var_samp("value").alias("vy"), F.covar_samp("d", "value").alias("cov"))
    beta = F.when(F.col("vg") > 0, F.col("cov") / F.col("vg"))
    var = F.when(F.col("n") > 2, (F.col("vy") / F.col("vg") - beta * beta) / (F.col("n") - 2))
    return x.where("vg > 0").select("attr_id", "vid", "n", beta.alias("beta"), (beta / F.sqrt(F.when(var > 0, var))).alias("t"))


def rank_by_regression(num: DataFrame, s: DataFrame) -> DataFrame:
    """attr_id, beta, t of the phenotype on each attribute."""
    x = num.where("value is not null").join(s.where("pheno is not null").select("sample_id", "pheno"), "sample_id").groupBy("attr_id").agg(F.count("*").alias("n"), F.var_samp("value").alias("vg"), F.var_samp("pheno").alias("vy"), F.covar_samp("value", "pheno").alias("cov")).where("vg > 0 and n > 2")
    beta = F.col("cov") / F.col("vg")
    var = (F.col("vy") / F.col("vg") - beta * beta) / (F.col("n") - 2)
    return x.select("attr_id", beta.alias("beta"), (beta / F.sqrt(F.when(var > 0, var))).alias("t"))


def hotelling(g: DataFrame, sets: DataFrame, s: DataFrame) -> DataFrame:
    """set_name, n, t2, f, p: Hotelling's T2 of each set's dosages between cases and controls, samples with all calls."""
    x = g.join(sets, "vid").join(s.select("sample_id", "aff"), "sample_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["set_name"].iloc[0]
        wide = pdf.pivot(index="sample_id", columns="vid", values="dosage").dropna()
        aff = pdf.drop_duplicates("sample_id").set_index("sample_id")["aff"].loc[wide.index].to_numpy(bool)
        x = wide.to_numpy(float)
        a, u, k = x[aff], x[~aff], x.shape[1]
        n = len(a) + len(u)
        out = (name, n, np.nan, np.nan, np.nan)
        if len(a) > 1 and len(u) > 1 and n > k + 1:
            d = a.mean(axis=0) - u.mean(axis=0)
            pooled = ((len(a) - 1) * np.atleast_2d(np.cov(a.T)) + (len(u) - 1) * np.atleast_2d(np.cov(u.T))) / (n - 2)
            t2 = float(len(a) * len(u) / n * d @ np.linalg.pinv(pooled) @ d)
            f = t2 * (n - k - 1) / (k * (n - 2))
            out = (name, n, t2, f, float(f_sf(f, k, n - k - 1)))
        return pd.DataFrame([out], columns=["set_name", "n", "t2", "f", "p"])

    return x.groupBy("set_name").applyInPandas(run, "set_name string, n int, t2 double, f double, p double")


def two_snp_em(g: DataFrame) -> DataFrame:
    """v1, v2, r2, dprime: haplotype frequencies by EM on each pair's nine genotype counts."""
    from strandflow.operators.products import genotype_pairs

    x = genotype_pairs(g)

    def run(batches):
        for pdf in batches:
            n = np.stack([[pdf[f"n{i}{j}"].to_numpy(float) for j in range(3)] for i in range(3)])
            total = 2 * n.sum(axis=(0, 1))
            h11 = 2 * n[2, 2] + n[2, 1] + n[1, 2]
            h12 = 2 * n[2, 0] + n[2, 1] + n[1, 0]
            h21 = 2 * n[0, 2] + n[0, 1] + n[1, 2]
            h22 = 2 * n[0, 0] + n[0, 1] + n[1, 0]
            share = np.full(len(pdf), 0.5)
            with np.errstate(all="ignore"):
                for _ in range(200):
                    p11, p12, p21, p22 = h11 + share * n[1, 1], h12 + (1 - share) * n[1, 1], h21 + (1 - share) * n[1, 1], h22 + share * n[1, 1]
                    new = p11 * p22 / (p11 * p22 + p12 * p21)
                    share = np.where(np.isfinite(new), new, 0.5)
                f11, f12, f21 = p11 / total, p12 / total, p21 / total
                p, q = f11 + f12, f11 + f21
                d = f11 - p * q
                most = np.where(d > 0, np.minimum(p * (1 - q), (1 - p) * q), np.minimum(p * q, (1 - p) * (1 - q)))
                yield pd.DataFrame({"v1": pdf["v1"], "v2": pdf["v2"], "r2": d * d / (p * (1 - p) * q * (1 - q)), "dprime": np.abs(d) / most})

    return x.mapInPandas(run, "v1 int, v2 int, r2 double, dprime double")


def haplotype_em(calls: np.ndarray, rounds: int = 200, tolerance: float = 1e-10) -> dict[tuple[int, ...], float]:
    """Haplotype frequencies of a window by EM: calls (samples, variants) of dosages, -1 missing; pairs of haplotypes that fit each sample."""
    k = calls.shape[1]
    haps = [tuple((h >> i) & 1 for i in range(k)) for h in range(1 << k)]
    fits: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    patterns, counts = np.unique(calls, axis=0, return_counts=True)
    for p in map(tuple, patterns.tolist()):
        fits[p] = [(i, j) for i in range(len(haps)) for j in range(i, len(haps)) if all(c < 0 or a + b == c for a, b, c in zip(haps[i], haps[j], p, strict=True))]
    f = np.full(len(haps), 1 / len(haps))
    for _ in range(rounds):
        new = np.zeros(len(haps))
        for p, c in zip(map(tuple, patterns.tolist()), counts, strict=True):
            w = np.array([f[i] * f[j] * (1 if i == j else 2) for i, j in fits[p]])
            if w.sum() <= 0:
                continue
            w = w / w.sum() * c
            for (i, j), x in zip(fits[p], w, strict=True):
                new[i] += x
                new[j] += x
        new /= max(1e-300, new.sum())
        if np.abs(new - f).sum() < tolerance:
            f = new
            break
        f = new
    return {h: float(x) for h, x in zip(haps, f, strict=True)}


def haplotype_freq(g: DataFrame, windows: DataFrame) -> DataFrame:
    """window, haplotype, freq: EM for each window (window, vid) of a few variants."""
    x = g.join(windows, "vid")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="sample_id", columns="vid", values="dosage").fillna(-1).astype(int)
        f = haplotype_em(wide.to_numpy())
        return pd.DataFrame([(int(pdf["window"].iloc[0]), "".join(map(str, h)), x) for h, x in f.items() if x > 1e-8], columns=["window", "haplotype", "freq"])

    return x.groupBy("window").applyInPandas(run, "window int, haplotype string, freq double")


def classical_mds(distance: np.ndarray, k: int) -> np.ndarray:
    """Coordinates by the top eigenvectors of the double-centred squared distances; a vector's first large entry is positive."""
    n = len(distance)
    c = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * c @ (distance**2) @ c)
    at = np.argsort(-values)[:k]
    v = vectors[:, at]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
    return v * np.sqrt(np.maximum(values[at], 0))


def hierarchical(similarity: np.ndarray, clusters: int = 1, least: float = -np.inf, group_average: bool = False, allowed: np.ndarray | None = None, most: int | None = None) -> np.ndarray:
    """Cluster of each sample: the closest two merge while allowed, by complete or average linkage."""
    n = len(similarity)
    sim, size = similarity.astype(float).copy(), np.ones(n)
    if allowed is not None:
        sim[~allowed] = -np.inf
    np.fill_diagonal(sim, -np.inf)
    label, live = np.arange(n), n
    while live > clusters:
        i, j = np.unravel_index(np.argmax(sim), sim.shape)
        if not np.isfinite(sim[i, j]) or sim[i, j] < least:
            break
        if most is not None and size[i] + size[j] > most:
            sim[i, j] = sim[j, i] = -np.inf
            continue
        i, j = min(i, j), max(i, j)
        new = (sim[i] * size[i] + sim[j] * size[j]) / (size[i] + size[j]) if group_average else np.minimum(sim[i], sim[j])
        sim[i], sim[:, i] = new, new
        sim[j], sim[:, j], sim[i, i] = -np.inf, -np.inf, -np.inf
        size[i] += size[j]
        label[label == j] = i
        live -= 1
    return np.unique(label, return_inverse=True)[1]
