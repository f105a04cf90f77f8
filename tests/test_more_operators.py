import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.operators import haplotypes as H
from strandflow.operators import pairs
from strandflow.operators import relatives as R
from strandflow.operators import sets as S


def linked(spark, n=150, seed=3, missing=0.05):
    """Samples of two copies of three haplotypes over four variants, with some calls missing."""
    rng = np.random.default_rng(seed)
    haps = np.array([[1, 1, 0, 0], [0, 0, 1, 1], [1, 0, 0, 1]])
    a, b = haps[rng.choice(3, n, p=[0.5, 0.3, 0.2])], haps[rng.choice(3, n, p=[0.5, 0.3, 0.2])]
    d, gone = a + b, rng.random((n, 4)) < missing
    g = spark.createDataFrame([(i, v, None if gone[i, v] else int(d[i, v])) for i in range(n) for v in range(4)], "sample_id long, vid int, dosage int")
    s = spark.createDataFrame([(i, bool(d[i, 0] > 0), float(d[i, 0]) + 0.1 * float(rng.standard_normal()), i % 2) for i in range(n)], "sample_id long, aff boolean, pheno double, cluster int")
    w = spark.createDataFrame([(v, 0) for v in range(4)], "vid int, window int")
    return g, s, w, d, gone


def test_phase_tests_and_imputation(spark):
    g, s, w, d, gone = linked(spark)
    ph = H.phase(g, w)
    sums = ph.groupBy("sample_id").agg(F.sum("posterior").alias("p")).collect()
    assert len(sums) == 150 and all(r.p == pytest.approx(1, abs=1e-4) for r in sums)
    cc = {r.hap: r.chisq for r in H.haplotype_case_control(ph, s).collect()}
    assert cc["0011"] == max(cc.values()) > 50
    q = {r.hap: r.beta for r in H.haplotype_quantitative(ph, s).collect()}
    assert q["0011"] == pytest.approx(-1, abs=0.15)
    dose = H.impute(g, w).collect()
    assert len(dose) == gone.sum() and np.mean([abs(r.dose - d[r.sample_id, r.vid]) for r in dose]) < 0.15


def test_blocks_and_intervals(spark):
    g, _, _, _, _ = linked(spark, 300, missing=0)
    v = spark.createDataFrame([(k, 1, 1000 * k) for k in range(4)], "vid int, chr int, bp int")
    assert [(r.chr, r.n) for r in H.blocks(g, v).collect()] == [(1, 4)]
    assert all(np.isnan(x) for x in H.dprime_interval(np.array([[9, 0, 0], [0, 0, 0], [0, 0, 0]], float)))
    lo, hi = H.dprime_interval(np.outer([25, 50, 25], [25, 50, 25]) / 100)
    assert lo < 0.2 and hi < 0.6


def test_mishap_sees_missingness_that_follows_flanks(spark):
    rng = np.random.default_rng(1)
    left = rng.integers(0, 3, 300)
    rows = [(i, v, int(x) if x >= 0 else None) for i, l in enumerate(left) for v, x in ((1, l), (2, -1 if l == 2 and rng.random() < 0.8 else 1), (3, rng.integers(0, 3)))]
    v = spark.createDataFrame([(k, 1, k) for k in (1, 2, 3)], "vid int, chr int, bp int")
    out = H.mishap(spark.createDataFrame(rows, "sample_id long, vid int, dosage int"), v).collect()
    assert {r.vid for r in out} == {2} and max(r.chisq for r in out) > 30


def test_sets(spark):
    res = spark.createDataFrame([(1, 9.0, 0.003), (2, 8.0, 0.005), (3, 4.0, 0.04), (4, 1.0, 0.3)], "vid int, chisq double, p double")
    r2 = spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.1)], "v1 int, v2 int, r2 double")
    st = spark.createDataFrame([("a", k) for k in (1, 2, 3, 4)] + [("b", 4)], "set_name string, vid int")
    got = {r.set_name: (r.n, r.stat, r.chosen) for r in S.ld_set_test(res, r2, st, 0.5, most=2).collect()}
    assert got == {"a": (4, 6.5, [1, 3]), "b": (1, 1.0, [4])}
    p = {r.set_name: r.p for r in S.set_screen(res, r2, st).collect()}
    assert p["a"] < 0.01 and p["b"] == pytest.approx(0.3)


def test_models_of_sets(spark):
    g, s, _, _, _ = linked(spark, missing=0)
    st = spark.createDataFrame([("x", 0), ("x", 1), ("y", 2), ("y", 3)], "set_name string, vid int")
    first = {r.set_name: (r.step, r.vid) for r in S.stepwise(g, st, s).where("step = 1").collect()}
    assert first["x"] == (1, 0)
    todo = spark.createDataFrame([("x", "y")], "set1 string, set2 string")
    r = S.gene_pair_test(g, st, s, todo).first()
    assert 0.5 < r.r_aff <= 1
    v = spark.createDataFrame([(k, 1, k) for k in range(4)], "vid int, chr int, bp int")
    kept = {r.vid: r.kept for r in S.vif_prune(g, v, 4, 1.5).collect()}
    assert len(kept) == 4 and 1 <= sum(kept.values()) < 4
    assert S.prune_collinear(np.column_stack([np.arange(9.0), np.arange(9.0), np.ones(9)])) == [0]
    m = S.genotype_mh(g, s).collect()
    assert {r.vid for r in m} == {0, 1, 2, 3} and next(r for r in m if r.vid == 0).p < 1e-6


def test_mh_of_one_2x2_table_is_the_known_one():
    t = np.array([[30.0, 70.0], [20.0, 80.0]])
    stat, df, _ = S.generalised_mh([t])
    assert df == 1 and stat == pytest.approx(200 * (30 * 80 - 70 * 20) ** 2 / (100 * 100 * 50 * 150) * 199 / 200)
    assert np.isnan(S.generalised_mh([])[0])


def test_generic_variants(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "cn", float(rng.integers(0, 3)), float(rng.integers(0, 3))) for i in range(200)]
    s = spark.createDataFrame([(i, a + b + 0.3 * float(rng.standard_normal())) for i, _, a, b in rows], "sample_id int, pheno double")
    r = S.generic_variant_tests(spark.createDataFrame(rows, "sample_id int, name string, dose1 double, dose2 double"), s, "linear").first()
    assert r.p_copies < 1e-20 and r.p_allelic > 1e-4 and r.p_joint < 1e-20


def test_relatives(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (4, 5, 0.9), (1, 5, 0.1), (6, 7, 0.9), (7, 8, 0.9), (8, 9, 0.9)], "i long, j long, dst double")
    assert {r.id: r.grp for r in R.groups(pairs, 0.5, "dst").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6}
    s = spark.createDataFrame([(k, k < 4) for k in range(1, 10)], "sample_id long, aff boolean")
    assert {r.grp: r.n for r in R.ibs_groups(pairs, s).collect()} == {"AFF/AFF": 2, "UNAFF/UNAFF": 4, "AFF/UNAFF": 1}
    assert 0 < R.ibs_test(pairs, s, 20).first().p <= 1
    al = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("x", "A"), ("x", "B")], "alias string, id string")
    assert [r.alias for r in R.conflicting_ids(al).collect()] == ["x"]
    m = R.match_ids(spark.createDataFrame([("a1", 1)], "id string, p int"), spark.createDataFrame([("a2", 2), ("q", 3)], "id string, q int"), ["id"], al.where("alias <> 'x'")).orderBy("id").collect()
    assert [(r.id, r.p, r.q, r.in_a, r.in_b) for r in m] == [("A", 1, 2, True, True), ("q", None, 3, False, True)]


def test_multipoint_ibd(spark):
    rng = np.random.default_rng(0)
    n = 120
    f = rng.uniform(0.3, 0.7, n)
    a = (rng.random(n) < f).astype(int) + (rng.random(n) < f)
    b = (rng.random(n) < f).astype(int) + (rng.random(n) < f)
    b[40:80] = a[40:80]
    z = R.ibd_posteriors(a, b, f, np.arange(n) * 1.0, np.array([0.5, 0.25, 0.25]))
    assert np.allclose(z.sum(axis=1), 1) and z[45:75, 2].mean() > 0.9 and z[:30, 2].mean() < 0.2
    g = spark.createDataFrame([(w, v, int(x)) for w, d in ((1, a), (2, b)) for v, x in enumerate(d)], "sample_id long, vid int, dosage int")
    v = spark.createDataFrame([(k, 1, float(k)) for k in range(n)], "vid int, chr int, cm double")
    fr = spark.createDataFrame([(k, float(x)) for k, x in enumerate(f)], "vid int, freq double")
    out = R.multipoint_ibd(g, v, spark.createDataFrame([(1, 2, 0.5, 0.25, 0.25)], "i long, j long, z0 double, z1 double, z2 double"), fr).orderBy("vid").collect()
    assert np.allclose([r.z2 for r in out], z[:, 2])


def test_gene_drop(spark):
    g = spark.createDataFrame([(1, 1, 0), (2, 1, 2), (3, 1, 1), (1, 2, 0), (2, 2, 1), (3, 2, 1)], "sample_id long, vid int, dosage int")
    t = spark.createDataFrame([(1, 2, 3)], "kid long, father long, mother long")
    seen = set()
    for rep in range(8):
        d = {(r.sample_id, r.vid): r.dosage for r in R.gene_drop(g, t, rep).collect()}
        assert d[1, 1] in (1, 2) and d[1, 2] in (0, 1, 2) and d[2, 1] == 2
        seen.add((d[1, 1], d[1, 2]))
    assert len(seen) > 1


def test_missingness_of_cases_and_controls_is_exact(spark):
    from strandflow.functions.stats import fisher_exact
    from strandflow.operators import summaries

    rng = np.random.default_rng(2)
    gone = rng.random((60, 3)) < np.array([0.1, 0.4, 0.0])
    gone[:20, 1] = True
    g = spark.createDataFrame([(i, v, None if gone[i, v] else 1) for i in range(60) for v in range(3)], "sample_id long, vid int, dosage int")
    s = spark.createDataFrame([(i, i < 25) for i in range(60)], "sample_id long, aff boolean")
    rows = {r.vid: r for r in summaries.missing_fisher(g, s).collect()}
    for v in range(3):
        a, u = int(gone[:25, v].sum()), int(gone[25:, v].sum())
        assert rows[v].p == pytest.approx(fisher_exact([[a, 25 - a], [u, 35 - u]]))
    assert rows[1].p < 0.01 < 0.05 < rows[0].p


def test_bands_of_variants_lose_no_pair(spark):
    from strandflow.operators import pairs

    g = linked(spark)[0].unionByName(linked(spark, seed=4)[0].withColumn("vid", F.col("vid") + 5))
    every = {(r.v1, r.v2): r.r for r in pairs.ld(g).collect()}
    for band in (1, 2, 3, 5, 20):
        got = {(r.v1, r.v2): r.r for r in pairs.ld(g, band).collect()}
        assert got == pytest.approx({k: x for k, x in every.items() if k[1] - k[0] < band}, nan_ok=True)
    assert "CartesianProduct" not in pairs.ld(g, 3)._jdf.queryExecution().toString()


def test_products_over_many_blocks_and_chunks(spark, monkeypatch):
    from strandflow.operators import products

    monkeypatch.setattr(products, "BLOCK", 5)
    monkeypatch.setattr(products, "CHUNK", 7)
    g = np.random.default_rng(4)
    cells = {(i, t): (None if g.random() < 0.2 else float(g.integers(0, 3))) for i in range(0, 46, 2) for t in range(31) if g.random() < 0.9}
    x = spark.createDataFrame([(t % 2 == 0, i, t, v) for (i, t), v in cells.items()], "even boolean, item long, place int, v double")
    want = {}
    for (i, t), a in cells.items():
        for j in range(i, 46, 2):
            b = cells.get((j, t))
            if a is not None and b is not None:
                s = want.setdefault((t % 2 == 0, i, j), np.zeros(6))
                s += (1, a, b, a * a, b * b, a * b)
    got = products.moments(x, "item", "place", "v", ("even",), diagonal=True).collect()
    assert {(r.even, r.i, r.j): (r.n, r.sa, r.sb, r.saa, r.sbb, r.sab) for r in got} == {k: tuple(v) for k, v in want.items()} and len(got) == len(want)
    assert not products.moments(x.limit(0), "item", "place", "v").collect()
    y = x.where("v is not null").select(F.col("item").cast("int").alias("vid"), F.col("place").alias("sample_id"), F.col("v").cast("int").alias("dosage"))
    pairs_ = products.cells_of(products.genotype_pairs(y), "a", "b", "n").collect()
    brute = {}
    for (i, t), a in cells.items():
        for j in range(i + 2, 46, 2):
            b = cells.get((j, t))
            if a is not None and b is not None:
                brute[i, j, int(a), int(b)] = brute.get((i, j, int(a), int(b)), 0) + 1
    assert {(r.v1, r.v2, r.a, r.b): r.n for r in pairs_} == brute


def test_running_over_many_ranges(spark):
    from strandflow.operators.ordered import in_ranges, running

    g = np.random.default_rng(9)
    rows = [(int(k), float(g.integers(0, 40)), int(g.integers(-5, 9))) for k in g.permutation(300)]
    # Ranges as several tasks make them, whatever the session would join into one.
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        x = in_ranges(spark.createDataFrame(rows, "k long, p double, v int"), "p", "k")
        assert x.select("_range").distinct().count() > 1
        out = running(x, ["p", "k"], {"place": ("sum", F.lit(1)), "top": ("max", F.col("v"))}, {"low": ("min", F.col("v")), "left": ("sum", F.col("v"))}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    rows.sort(key=lambda r: (r[1], r[0]))
    v = [r[2] for r in rows]
    assert {r.k: (r.place, r.top, r.low, r.left) for r in out} == {r[0]: (i + 1, max(v[: i + 1]), min(v[i:]), sum(v[i:])) for i, r in enumerate(rows)}
    assert not running(in_ranges(spark.createDataFrame([], "k long"), "k"), ["k"], {"n": ("sum", F.lit(1))}).collect()


def test_label_sums_over_many_blocks_and_chunks(spark, monkeypatch):
    from strandflow.operators import products

    monkeypatch.setattr(products, "BLOCK", 4)
    monkeypatch.setattr(products, "CHUNK", 6)
    g = np.random.default_rng(5)
    calls = [(v, s, int(g.integers(0, 3)) if g.random() < 0.8 else None) for v in range(17) for s in range(29)]
    labels = [(r, s, None if r == 2 and s == 3 else bool(g.random() < 0.5)) for r in range(3) for s in range(25)]
    got = products.label_sums(spark.createDataFrame(calls, "vid int, sample_id long, dosage int"), spark.createDataFrame(labels, "rep int, sample_id long, label boolean")).collect()
    on = {(r, s): bool(x) for r, s, x in labels}
    want = {}
    for v, s, d in calls:
        for r in range(3):
            if d is not None and s < 25:
                w = want.setdefault((r, v), np.zeros(4))
                w += (d * on[r, s], on[r, s], d, 1)
    assert {(r.rep, r.vid): (r.x, r.n, r.all_x, r.all_n) for r in got} == {k: tuple(v) for k, v in want.items()}


@pytest.mark.parametrize("chunk", [4096, 5])
def test_pairs_without_rows_are_those_of_all_rows(spark, monkeypatch, chunk):
    from strandflow.operators import products

    rng = np.random.default_rng(8)
    rows = [(i * 3, v, None if rng.random() < 0.1 else int(rng.integers(0, 3))) for i in range(50) for v in range(12)]
    g = spark.createDataFrame(rows, "sample_id int, vid int, dosage int")
    s = spark.createDataFrame([(i * 3, None if i == 7 else i % 3 == 0) for i in range(50)], "sample_id int, aff boolean")
    table = pairs.ibs(g).cache()
    want = [R.ibs_groups(table, s), R.ibs_test(table, s, 12), table.where("dst >= 0.6").select("i", "j", "dst"), pairs.neighbours(table, 1, 4)]
    want = [sorted(map(tuple, x.collect()), key=str) for x in want]
    monkeypatch.setattr(products, "BLOCK", 6)
    monkeypatch.setattr(products, "CHUNK", chunk)
    monkeypatch.setattr(products, "WIDEST", 2)
    if chunk > 12:
        # A row for each pair is refused.
        monkeypatch.setattr(pairs, "products", lambda *_: pytest.fail("rows for pairs"))
    got = [R.similar_groups(g, s), R.similar_test(g, s, 12), pairs.close(g, 0.6), pairs.nearest_neighbours(g, 1, 4)]
    for x, w in zip(got, want, strict=True):
        have = sorted(map(tuple, x.collect()), key=str)
        assert len(have) == len(w)
        for p, q in zip(have, w, strict=True):
            assert p == pytest.approx(q, abs=1e-9) if not isinstance(p[0], str) else (p[:2], p[2:]) == (q[:2], pytest.approx(q[2:], abs=1e-9))


def test_pairs_over_one_chunk_are_not_shuffled_again(spark):
    g = spark.createDataFrame([(i, v, (i * v) % 3) for i in range(8) for v in range(5)], "sample_id int, vid int, dosage int")
    for x in (pairs.ibs(g), pairs.missing_identity(g)):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 2 and x.count() == 28
    assert pairs.ibd(g).count() == 28


@pytest.mark.parametrize(("places", "kind"), [(5, "int"), (64, "string"), (65, "long"), (257, "int")])
def test_pairs_by_words_are_those_by_hand(spark, places, kind):
    rng = np.random.default_rng(places)
    d = rng.integers(0, 3, (70, places)).astype(float)
    d[rng.random(d.shape) < 0.1] = np.nan
    d[3] = np.nan
    name = (lambda i: f"s{i:03d}") if kind == "string" else (lambda i: i * 7 - 100)
    g = spark.createDataFrame([(name(i), v * 11 - 5, None if np.isnan(d[i, v]) else int(d[i, v])) for i in range(70) for v in range(places)], f"sample_id {kind}, vid int, dosage int")
    x = pairs.ibs(g)
    # Up to four words, pairs take no Python and no cells are sent once a block.
    assert ("Pandas" in x._jdf.queryExecution().executedPlan().toString()) == (places > 256)
    got = {(r.i, r.j): (r.ibs0, r.ibs1, r.ibs2, r.dst, r.ppc) for r in x.collect()}
    want = {}
    for i in range(70):
        for j in range(i + 1, 70):
            apart = np.abs(d[i] - d[j])
            n0, n1, n2 = (int((apart == k).sum()) for k in (2, 1, 0))
            if n0 + n1 + n2:
                het = int(((d[i] == 1) & (d[j] == 1)).sum())
                z = (het / (n0 + het) - 2 / 3) / math.sqrt(2 / 9 / (n0 + het)) if n0 + het else None
                want[name(i), name(j)] = n0, n1, n2, (0.5 * n1 + n2) / (n0 + n1 + n2), None if z is None else 0.5 * math.erfc(-z / math.sqrt(2))
    assert set(got) == set(want) and 69 * 68 // 2 - 30 < len(want)
    for k, w in want.items():
        assert got[k][:3] == w[:3] and got[k][3] == pytest.approx(w[3]) and (got[k][4] is None if w[4] is None else got[k][4] == pytest.approx(w[4], abs=1e-9))


def test_ibd_takes_no_python_and_no_decimals_for_each_pair(spark):
    from strandflow.plans.registry import rounded

    g = spark.createDataFrame([(i, v, (i * v + i) % 3) for i in range(20) for v in range(9)], "sample_id int, vid int, dosage int")
    x = pairs.ibd(g)
    quick = rounded(x, 5, many=True)
    plan = quick._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "rint" in plan.lower()
    assert sorted(map(tuple, quick.collect()), key=str) == sorted(map(tuple, rounded(x, 5).collect()), key=str)


def test_fisher_takes_large_counts():
    import time

    from strandflow.functions.stats import fisher_2x2

    began = time.time()
    assert fisher_2x2(50_000, 50_200, 49_900, 50_100) == pytest.approx(0.9929, abs=1e-2)
    assert fisher_2x2(0, 0, 0, 0) != fisher_2x2(0, 0, 0, 0) and time.time() - began < 5
