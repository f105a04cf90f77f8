"""Tests of sets of variants, of gene pairs, and of generic variants: small matrices in groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.stats import chi2_sf
from strandflow.operators.models import linear, logistic, nested_p


def ld_set_test(results: DataFrame, r2: DataFrame, sets: DataFrame, most_r2: float = 0.5, least_chisq: float = 0.0, most: int = 5) -> DataFrame:
    """set_name, n, stat, chosen: best variants first, none correlated with one that is chosen; the mean of their chi-squares."""
    members = sets.join(results.where((F.col("chisq") > least_chisq)).select("vid", "chisq"), "vid").groupBy("set_name").agg(F.array_sort(F.collect_list(F.struct((-F.col("chisq")).alias("c"), "vid"))).alias("m"))
    near = r2.where(F.col("r2") >= most_r2).select("v1", "v2")
    s1 = sets.withColumnRenamed("vid", "v1")
    s2 = sets.select(F.col("set_name").alias("o"), F.col("vid").alias("v2"))
    links = near.join(s1, "v1").join(s2, "v2").where("set_name = o").groupBy("set_name").agg(F.collect_list(F.struct("v1", "v2")).alias("l"))

    def run(batches):
        for pdf in batches:
            rows = []
            for name, m, l in zip(pdf["set_name"], pdf["m"], pdf["l"], strict=True):
                tied: dict[int, set[int]] = {}
                for e in l if l is not None else []:
                    tied.setdefault(e["v1"], set()).add(e["v2"])
                    tied.setdefault(e["v2"], set()).add(e["v1"])
                chosen: list[tuple[int, float]] = []
                for x in m:
                    if len(chosen) < most and not tied.get(x["vid"], set()) & {c for c, _ in chosen}:
                        chosen.append((x["vid"], -x["c"]))
                rows.append((name, len(m), float(np.mean([c for _, c in chosen])) if chosen else 0.0, [int(c) for c, _ in chosen]))
            yield pd.DataFrame(rows, columns=["set_name", "n", "stat", "chosen"])

    return members.join(links, "set_name", "left").mapInPandas(run, "set_name string, n int, stat double, chosen array<int>")


def set_screen(results: DataFrame, r2: DataFrame, sets: DataFrame) -> DataFrame:
    """set_name, n, stat, p: sum of -2 ln p with the effective number of tests, one for each variant less what LD shares."""
    x = sets.join(results.where("p > 0").select("vid", "p"), "vid")
    s1, s2 = x.select("set_name", F.col("vid").alias("v1")), x.select(F.col("set_name").alias("o"), F.col("vid").alias("v2"))
    shared = r2.join(s1, "v1").join(s2, "v2").where("set_name = o").groupBy("set_name").agg(F.sum("r2").alias("shared"))
    y = x.groupBy("set_name").agg(F.count("*").alias("n"), F.sum(-2 * F.log("p")).alias("stat")).join(shared, "set_name", "left")
    n = F.col("n").cast("double")
    effective = n * n / (n + 2 * F.coalesce("shared", F.lit(0.0)))
    y = y.select("set_name", "n", (F.col("stat") * effective / n).alias("stat"), (2 * effective).alias("df"))
    from strandflow.functions.stats import chi2_p

    return y.withColumn("p", chi2_p(F.col("stat"), F.col("df")))


def stepwise(g: DataFrame, sets: DataFrame, s: DataFrame, enter: float = 0.05) -> DataFrame:
    """set_name, step, vid, p: forward regression of the phenotype; samples with all of a set's calls."""
    x = g.join(sets, "vid").join(s.where("pheno is not null").select("sample_id", "pheno"), "sample_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="sample_id", columns="vid", values="dosage").dropna()
        y = pdf.drop_duplicates("sample_id").set_index("sample_id")["pheno"].loc[wide.index].to_numpy(float)
        chosen, rows = [], []
        while len(wide) > len(chosen) + 2 and len(chosen) < wide.shape[1]:
            base = np.column_stack([np.ones(len(y)), *(wide[c].to_numpy(float) for c in chosen)])
            fits = [(linear(np.column_stack([base, wide[c].to_numpy(float)]), y), c) for c in wide.columns if c not in chosen]
            ps = [(f["p"][-1], int(c)) for f, c in fits if f["ok"]]
            if not ps or min(ps)[0] > enter:
                break
            p, c = min(ps)
            chosen.append(c)
            rows.append((pdf["set_name"].iloc[0], len(chosen), c, float(p)))
        return pd.DataFrame(rows, columns=["set_name", "step", "vid", "p"])

    return x.groupBy("set_name").applyInPandas(run, "set_name string, step int, vid int, p double")


def prune_collinear(x: np.ndarray, most_vif: float = 2.0) -> list[int]:
    """Columns that stay when, again and again, the one with the largest variance inflation above a bound leaves."""
    keep = [j for j in range(x.shape[1]) if x[:, j].std() > 0]
    while len(keep) > 1:
        vif = np.diag(np.linalg.pinv(np.corrcoef(x[:, keep].T)))
        # A column that others give exactly has no finite inflation; the pseudo-inverse hides it.
        rank = np.linalg.matrix_rank(np.corrcoef(x[:, keep].T), tol=1e-8)
        if rank < len(keep):
            r2 = [linear(np.column_stack([np.ones(len(x)), x[:, [k for k in keep if k != j]]]), x[:, j])["r2"] for j in keep]
            vif = np.array([1 / max(1e-12, 1 - r) for r in r2])
        if vif.max() <= most_vif:
            break
        keep.pop(int(np.flatnonzero(vif >= vif.max() - 1e-9)[-1]))
    return keep


def vif_prune(g: DataFrame, v: DataFrame, window: int = 50, most_vif: float = 2.0) -> DataFrame:
    """vid, kept: pruning by variance inflation in windows of consecutive variants, missing calls at their mean."""
    w = Window.partitionBy("chr").orderBy("bp", "vid")
    groups = v.withColumn("grp", F.floor((F.row_number().over(w) - 1) / window)).select("vid", "chr", "grp")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="sample_id", columns="vid", values="dosage").astype(float)
        wide = wide.fillna(wide.mean()).fillna(0.0)
        keep = {wide.columns[j] for j in prune_collinear(wide.to_numpy(), most_vif)}
        return pd.DataFrame({"vid": [int(c) for c in wide.columns], "kept": [c in keep for c in wide.columns]})

    return g.join(groups, "vid").groupBy("chr", "grp").applyInPandas(run, "vid int, kept boolean")


def gene_pair_test(g: DataFrame, sets: DataFrame, s: DataFrame, pairs: DataFrame) -> DataFrame:
    """set1, set2, r_aff, r_unaff, z: first canonical correlation of two sets in cases and controls, and their difference."""
    a = pairs.join(sets.withColumnRenamed("set_name", "set1"), "set1").select("set1", "set2", F.lit(1).alias("side"), "vid")
    b = pairs.join(sets.withColumnRenamed("set_name", "set2"), "set2").select("set1", "set2", F.lit(2).alias("side"), "vid")
    x = g.join(a.unionByName(b), "vid").join(s.select("sample_id", "aff"), "sample_id")

    def first(p: np.ndarray, q: np.ndarray) -> float:
        if len(p) <= max(p.shape[1], q.shape[1]) + 1:
            return np.nan
        u, v = (np.linalg.qr(m - m.mean(axis=0))[0] for m in (p, q))
        return float(min(1.0, np.linalg.svd(u.T @ v, compute_uv=False)[0]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="sample_id", columns=["side", "vid"], values="dosage").dropna().astype(float)
        aff = pdf.drop_duplicates("sample_id").set_index("sample_id")["aff"].loc[wide.index].to_numpy(bool)
        r = [first(wide[1].to_numpy()[m], wide[2].to_numpy()[m]) for m in (aff, ~aff)]
        n = [int(aff.sum()), int((~aff).sum())]
        z = np.nan
        if min(n) > 3 and all(np.isfinite(r)) and max(r) < 1:
            z = float((np.arctanh(r[0]) - np.arctanh(r[1])) / np.sqrt(1 / (n[0] - 3) + 1 / (n[1] - 3)))
        return pd.DataFrame([(pdf["set1"].iloc[0], pdf["set2"].iloc[0], r[0], r[1], z)], columns=["set1", "set2", "r_aff", "r_unaff", "z"])

    return x.groupBy("set1", "set2").applyInPandas(run, "set1 string, set2 string, r_aff double, r_unaff double, z double")


def generic_variant_tests(gv: DataFrame, s: DataFrame, kind: str = "logistic") -> DataFrame:
    """name, p_allelic, p_copies, p_joint: allele difference, copy number, and both, by nested models.

    gv is (sample_id, name, dose1, dose2): copies of two alleles.
    """
    y = "aff" if kind == "logistic" else "pheno"
    x = gv.join(s.select("sample_id", F.col(y).cast("double").alias("y")), "sample_id").where("dose1 is not null and dose2 is not null and y is not null")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, t = (pdf[c].to_numpy(float) for c in ("dose1", "dose2", "y"))
        fit = linear if kind == "linear" else logistic
        one = np.ones(len(t))
        total, diff = a + b, a - b
        models_ = {"none": np.column_stack([one])}
        cols = [c for c in (total, diff) if c.std() > 0]
        models_["copies"] = np.column_stack([one, *([total] if total.std() > 0 else [])])
        models_["allelic"] = np.column_stack([one, *([diff] if diff.std() > 0 else [])])
        models_["both"] = np.column_stack([one, *cols])
        fits = {k: fit(m, t) for k, m in models_.items()}

        def p(full, part):
            k, j = models_[full].shape[1], models_[part].shape[1]
            return nested_p(fits[full], fits[part], k, j) if k > j and fits[full]["ok"] else np.nan

        return pd.DataFrame([(pdf["name"].iloc[0], p("both", "copies"), p("both", "allelic"), p("both", "none"))], columns=["name", "p_allelic", "p_copies", "p_joint"])

    return x.groupBy("name").applyInPandas(run, "name string, p_allelic double, p_copies double, p_joint double")


def generalised_mh(tables: list[np.ndarray]) -> tuple[float, int, float]:
    """Chi-square, degrees and p of no association in any of several I x J tables."""
    diff, cov = None, None
    for t in tables:
        n, r, c = t.sum(), t.sum(axis=1), t.sum(axis=0)
        if n < 2:
            continue
        d = (t - np.outer(r, c) / n)[:-1, :-1].ravel()
        vr, vc = np.diag(r / n) - np.outer(r, r) / n**2, np.diag(c / n) - np.outer(c, c) / n**2
        v = n * n / (n - 1) * np.kron(vr[:-1, :-1], vc[:-1, :-1])
        diff, cov = (d, v) if diff is None else (diff + d, cov + v)
    if diff is None:
        return np.nan, 0, np.nan
    df = int(np.linalg.matrix_rank(cov))
    stat = float(diff @ np.linalg.pinv(cov) @ diff)
    return stat, df, float(chi2_sf(stat, df)) if df else np.nan


def genotype_mh(g: DataFrame, s: DataFrame) -> DataFrame:
    """vid, chisq, df, p of genotype by affection over clusters."""
    c = g.where("dosage is not null").join(s.select("sample_id", "aff", "cluster"), "sample_id").groupBy("vid", "cluster", "dosage", "aff").agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tables = []
        for _, p in pdf.groupby("cluster"):
            t = np.zeros((2, 3))
            for a, d, n in zip(p["aff"], p["dosage"], p["n"], strict=True):
                t[int(a), int(d)] = n
            tables.append(t)
        return pd.DataFrame([(int(pdf["vid"].iloc[0]), *generalised_mh(tables))], columns=["vid", "chisq", "df", "p"])

    return c.groupBy("vid").applyInPandas(run, "vid int, chisq double, df int, p double")
