import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.operators import assoc, family, filters, joins, models, network, pairs, permutation, ranking, recodes, segments, summaries


def calls(spark, rows):
    return spark.createDataFrame(rows, "sample_id int, vid int, dosage int")


def by_counts(spark, aff, unaff):
    """A variant's genotypes from counts of dosages 2, 1, 0."""
    g, s, k = [], [], 0
    for flag, counts in ((True, aff), (False, unaff)):
        for d, n in zip((2, 1, 0), counts, strict=True):
            for _ in range(n):
                g.append((k, 1, d))
                s.append((k, flag, float(d), k % 2, 1, True))
                k += 1
    return calls(spark, g), spark.createDataFrame(s, "sample_id int, aff boolean, pheno double, cluster int, sex int, founder boolean")


def test_allelic_by_hand(spark):
    g, s = by_counts(spark, (10, 10, 30), (5, 10, 35))
    r = assoc.allelic(g, s).first()
    assert (r.a1_aff, r.a2_aff, r.a1_unaff, r.a2_unaff) == (30, 70, 20, 80)
    assert r.chisq == pytest.approx(8 / 3) and r.odds_ratio == pytest.approx(30 * 80 / (70 * 20)) and r.l95 < r.odds_ratio < r.u95


def test_hwe_by_hand(spark):
    g, s = by_counts(spark, (25, 50, 25), (0, 0, 0))
    r = summaries.hwe(g, s).where("grp = 'ALL'").first()
    assert (r.e_het, r.o_het, r.chisq) == (0.5, 0.5, 0)


def test_no_calls_are_null_not_errors(spark):
    g = calls(spark, [(1, 1, None), (2, 1, None), (1, 2, 2), (2, 2, 2)])
    s = spark.createDataFrame([(1, True, 1.0, 0, 1, True), (2, False, 2.0, 0, 2, True)], "sample_id int, aff boolean, pheno double, cluster int, sex int, founder boolean")
    f = {r.vid: r.freq for r in summaries.allele_freq(g).collect()}
    assert f == {1: None, 2: 1.0}
    for x in (assoc.allelic(g, s), assoc.quantitative(g, s), assoc.model_tests(g, s), assoc.cmh(g, s), assoc.gxe(g, s), summaries.hwe(g, s), summaries.heterozygosity(g), pairs.ld(g), pairs.fast_epistasis(g, s), assoc.fisher(g, s)):
        x.collect()
    empty = g.limit(0)
    for x in (assoc.allelic(empty, s), summaries.hwe(empty, s), pairs.ibs(empty), filters.qc(empty, s, 0.1, 0.1, 0.01, 10)):
        assert x.count() == 0


def test_filters_by_hand(spark):
    g = calls(spark, [(1, 1, 0), (1, 2, None), (2, 1, 1), (2, 2, 1), (3, 1, None), (3, 2, None)])
    assert {r.sample_id for r in filters.mind(g, 0.5).collect()} == {1, 2} and {r.vid for r in filters.geno(g, 0.4).collect()} == {1}
    q = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    assert filters.floor_quantile(q, "x", 0.25).first().cut == 2 and filters.floor_quantile(q, "x", 1.0).first().cut == 9
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["y", "z"]), (3, [])], "k int, t array<string>")
    assert [r.k for r in filters.has_attributes(a, F.col("t"), "y,-z").collect()] == [1] and [r.k for r in filters.has_attributes(a, F.col("t"), "-z").orderBy("k").collect()] == [1, 3]
    assert filters.thin(g, "vid", 1.0).count() == 6 and filters.duplicates(g, "vid").count() == 2


def test_recodes(spark):
    r = spark.range(1).select(recodes.complement(F.lit("A")).alias("a"), recodes.complement(F.lit("0")).alias("b"), recodes.to_numbers(F.lit("G")).alias("c"), recodes.to_letters(F.lit("4")).alias("d")).first()
    assert tuple(r) == ("T", "0", "3", "T")
    s = spark.createDataFrame([("f", "k", "p", "m"), ("f", "p", "0", "0")], "fid string, iid string, pat string, mat string")
    assert {r.iid: r.founder for r in recodes.make_founders(s).collect()} == {"k": False, "p": True}
    assert [(r.iid, r.sex) for r in recodes.missing_parents(s).collect()] == [("m", 2)]
    p = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (-9.0,)], "x double").select(recodes.affection(F.col("x")).alias("a"), recodes.affection(F.col("x"), True).alias("b")).collect()
    assert [(r.a, r.b) for r in p] == [(None, False), (False, True), (True, False), (None, None)]


def test_range_and_overlap_joins_equal_plain_loops(spark):
    rng = np.random.default_rng(1)
    pts = [(int(c), int(b), i) for i, (c, b) in enumerate(zip(rng.integers(1, 3, 60), rng.integers(0, 1000, 60), strict=True))]
    rs = [(int(c), int(a), int(a + w), f"r{i}") for i, (c, a, w) in enumerate(zip(rng.integers(1, 3, 40), rng.integers(0, 900, 40), rng.integers(0, 400, 40), strict=True))]
    p, r = spark.createDataFrame(pts, "chr int, bp int, k int"), spark.createDataFrame(rs, "chr int, start int, stop int, name string")
    got = sorted((x.k, x.name) for x in joins.range_join(p, r, width=70, border=5).collect())
    assert got == sorted((k, n) for c, b, k in pts for d, a, z, n in rs if c == d and a - 5 <= b <= z + 5)
    seg = spark.createDataFrame([(c, a, z, n) for c, a, z, n in rs], "chr int, bp1 int, bp2 int, seg_id string")
    got = sorted((x.seg_id, x.b_seg_id, x.meet) for x in joins.overlap_join(seg, seg, width=70).collect())
    assert got == sorted((n, m, min(z, y) - max(a, b) + 1) for c, a, z, n in rs for d, b, y, m in rs if c == d and a <= y and b <= z)


def test_merge_modes(spark):
    a, b = calls(spark, [(1, 1, 0), (1, 2, None), (1, 3, 1), (1, 4, None)]), calls(spark, [(1, 1, 1), (1, 2, 2), (1, 3, None), (1, 5, 2)])
    get = lambda m: {r.vid: r.dosage for r in joins.merge(a, b, m).collect()}
    assert get(1) == {1: None, 2: 2, 3: 1, 4: None, 5: 2} and get(2) == {1: 0, 2: 2, 3: 1, 4: None, 5: 2}
    assert get(3) == {1: 1, 2: 2, 3: 1, 4: None, 5: 2} and get(4) == {1: 0, 2: None, 3: 1, 4: None, 5: 2} and get(5) == {1: 1, 2: 2, 3: None, 4: None, 5: 2}
    assert joins.merge_diff(a, b, False).count() == 3 and joins.merge_diff(a, b, True).count() == 1


def test_mendel_and_tdt_by_hand(spark):
    # kid, father, mother by variant: code expected
    cases = [(1, 2, 2, 1), (1, 0, 0, 2), (2, 0, 1, 3), (2, 1, 0, 4), (2, 0, 0, 5), (0, 2, 1, 6), (0, 1, 2, 7), (0, 2, 2, 8), (1, 1, 1, 0), (2, 1, 1, 0), (1, 1, 0, 0), (1, 2, 1, 0)]
    rows = [(w, v, d) for v, (k, f, m, _) in enumerate(cases) for w, d in ((1, k), (2, f), (3, m))]
    g, t = calls(spark, rows), spark.createDataFrame([(1, 2, 3)], "kid int, father int, mother int")
    s = spark.createDataFrame([(1, True), (2, False), (3, False)], "sample_id int, aff boolean")
    assert {r.vid: r.code for r in family.mendel(g, t).collect()} == {v: c[3] for v, c in enumerate(cases) if c[3]}
    got = {r.vid: (r.t, r.u) for r in family.tdt(g, t, s).collect()}
    assert got == {8: (1.0, 1.0), 9: (2.0, 0.0), 10: (1.0, 0.0), 11: (0.0, 1.0)}
    clean = {(r.sample_id, r.vid): r.dosage for r in family.mendel_clean(g, t).collect()}
    assert clean[1, 2] is None and clean[2, 2] is None and clean[3, 2] == 1 and clean[1, 4] is None and clean[2, 4] == 0


def test_ancestors(spark):
    s = spark.createDataFrame([("f", "c", "b", "0"), ("f", "b", "a", "0"), ("f", "a", "0", "0")], "fid string, iid string, pat string, mat string")
    assert {(r.iid, r.ancestor, r.meioses) for r in family.ancestors(s).collect()} == {("c", "b", 1), ("b", "a", 1), ("c", "a", 2)}


def test_ibs_by_hand(spark):
    rows = [(i, v, d) for i, ds in ((1, [0, 1, 1, 2, 2, 2, 0, 0, 1, 1]), (2, [2, 0, 2, 2, 2, 2, 0, 0, 1, 1])) for v, d in enumerate(ds)]
    r = pairs.ibs(calls(spark, rows)).first()
    assert (r.ibs0, r.ibs1, r.ibs2, r.dst) == (1, 2, 7, pytest.approx(0.8))


def test_prune_and_clump(spark):
    rng = np.random.default_rng(0)
    base, other = rng.integers(0, 3, 80), rng.integers(0, 3, 80)
    g = calls(spark, [(i, v, int(d)) for v, col in ((1, base), (2, base), (3, other), (4, other)) for i, d in enumerate(col)])
    v = spark.createDataFrame([(k, 1, k * 10) for k in (1, 2, 3, 4)], "vid int, chr int, bp int")
    assert {r.vid: r.kept for r in pairs.ld_prune(g, v, 4, 1, 0.5).collect()} == {1: True, 2: False, 3: True, 4: False}
    res = spark.createDataFrame([(1, 1e-6), (2, 1e-3), (3, 1e-5), (4, 0.5)], "vid int, p double")
    assert [(c["index"], c["members"]) for c in pairs.clump(res, pairs.ld(g))] == [(1, [2]), (3, [])]


def test_multiple_testing_by_hand(spark):
    from strandflow.functions.stats import chi2_isf

    rows = [(i, float(chi2_isf(p, 1))) for i, p in enumerate((0.01, 0.02, 0.04))]
    got = sorted((r.vid, round(r.bonf, 4), round(r.holm, 4), round(r.fdr_bh, 4)) for r in permutation.multiple_testing(spark.createDataFrame(rows, "vid int, chisq double")).collect())
    assert got == [(0, 0.03, 0.03, 0.03), (1, 0.06, 0.04, 0.03), (2, 0.12, 0.04, 0.04)]


def test_permutation_keeps_labels_within_clusters(spark):
    s = spark.createDataFrame([(i, i % 3 == 0, i % 2) for i in range(40)], "sample_id int, aff boolean, c int")
    reps = spark.range(1, 4).selectExpr("cast(id as int) as rep")
    x = permutation.shuffled(s, "aff", reps, within="c").join(s.drop("aff"), "sample_id").groupBy("rep", "c").agg(F.sum(F.col("label").cast("int")).alias("n"), F.count("*").alias("m")).collect()
    assert {(r.rep, r.c, r.n, r.m) for r in x} == {(k, c, 7, 20) for k in (1, 2, 3) for c in (0, 1)}


def test_adaptive_stops_early(spark):
    g, s = by_counts(spark, (30, 0, 0), (0, 0, 30))
    stat = lambda g, lab: g.join(lab, "sample_id").groupBy("rep", "vid").agg(F.abs(F.sum(F.when(F.col("label"), F.col("dosage")).otherwise(-F.col("dosage")))).cast("double").alias("stat"))
    seen = spark.createDataFrame([(1, 60.0)], "vid int, stat double")
    labels = lambda first, n: permutation.shuffled(s, "aff", spark.range(first, first + n).selectExpr("cast(id as int) as rep"))
    r = permutation.adaptive(g, stat, labels, seen, batch=100, most=300).first()
    assert r.n < 300 and r.emp1 < 0.05


def test_meta_by_hand(spark):
    r = assoc.meta_analysis(spark.createDataFrame([(1, 0.2, 0.1), (1, 0.4, 0.2)], "vid int, effect double, se double")).first()
    assert r.fixed == pytest.approx(0.24) and r.n == 2 and r.q == pytest.approx(100 * 0.04**2 + 25 * 0.16**2)


def test_models_against_numpy():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(200), rng.standard_normal((200, 2))])
    y = x @ [1.0, 2.0, 0.0] + rng.standard_normal(200)
    f = models.linear(x, y)
    assert f["beta"] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0]) and f["p"][1] < 1e-20 and f["p"][2] > 1e-4
    b = (rng.random(200) < 1 / (1 + np.exp(-x[:, 1]))).astype(float)
    lg = models.logistic(x, b)
    p = 1 / (1 + np.exp(-x @ lg["beta"]))
    assert lg["ok"] and np.abs(x.T @ (b - p)).max() < 1e-6
    assert not models.logistic(np.column_stack([np.ones(20), np.arange(20) > 9.5]), (np.arange(20) > 9.5) * 1.0)["ok"]
    assert not models.linear(np.column_stack([np.ones(9), np.ones(9)]), np.arange(9.0))["ok"]
    stat, df, pv = models.joint_test(f, np.eye(3)[1:])
    assert df == 2 and pv < 1e-20 and stat > f["stat"][1] ** 2 * 0.9
    assert models.nested_p(f, models.linear(x[:, :1], y), 3, 1) < 1e-20
    assert models.linear(x, y, np.arange(200) % 20)["beta"] == pytest.approx(f["beta"])


def test_haplotypes():
    rng = np.random.default_rng(4)
    haps, freq = np.array([[1, 1, 0], [0, 0, 1], [1, 0, 0]]), [0.5, 0.3, 0.2]
    c = haps[rng.choice(3, 400, p=freq)] + haps[rng.choice(3, 400, p=freq)]
    c[:5, 1] = -1
    f = models.haplotype_em(c)
    assert sum(f.values()) == pytest.approx(1) and all(abs(f[tuple(h)] - p) < 0.05 for h, p in zip(haps.tolist(), freq, strict=True))


def test_clustering_and_mds():
    x = np.array([0.0, 0.1, 5.0, 5.1, 9.0])
    d = np.abs(x[:, None] - x)
    assert models.hierarchical(-d, 3).tolist() == [0, 0, 1, 1, 2] and models.hierarchical(-d, 3, group_average=True).tolist() == [0, 0, 1, 1, 2]
    assert models.hierarchical(-d, 1, least=-1.0).max() == 2 and models.hierarchical(-d, 1, most=2).max() >= 2
    m = models.classical_mds(d, 1)[:, 0]
    assert np.abs(np.abs(m[:, None] - m) - d).max() < 1e-8


def test_network_methods():
    a = np.zeros((6, 6))
    for i, j in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)):
        a[i, j] = a[j, i] = 1
    q, m = network.modularity(a)
    assert q == pytest.approx(5 / 14) and len(set(m[:3])) == 1 and len(set(m[3:])) == 1 and m[0] != m[3]
    assert network.homophily(a, m).min() > 0.8 and network.modularity(np.zeros((3, 3)))[0] == 0
    g = a + np.diag(np.arange(6.0))
    r, p = network.snprank(g), network.snprank(g, power=True, tolerance=1e-12)
    assert r.sum() == pytest.approx(1) and r == pytest.approx(p, abs=1e-8) and network.snprank(g, gamma=None).sum() == pytest.approx(1)
    # Without gamma each attribute hands on by its own share: a plain solve, cell by cell.
    weights = np.array([[0.5, 0.2, 0.7], [0.2, 0.1, 0.4], [0.7, 0.4, 0.3]])
    off, n = weights - np.diag(np.diag(weights)), 3
    col = [sum(off[i][j] for i in range(n)) for j in range(n)]
    share = [sum(off[i]) / sum(col[j] for j in range(n) if off[i][j]) for i in range(n)]
    system = np.array([[(i == j) - share[j] * off[i][j] / col[j] for j in range(n)] for i in range(n)])
    want = np.linalg.solve(system, [(1 - share[i]) / n + weights[i][i] / (n * np.trace(weights)) for i in range(n)])
    for power in (False, True):
        assert network.snprank(weights, gamma=None, power=power, tolerance=1e-13) == pytest.approx(want / want.sum(), abs=1e-9)
    d = network.deconvolve(a)
    assert d.shape == a.shape and 0 <= d.min() and d.max() <= 1
    assert len(set(network.ripm(a, 3, 2).tolist())) == 2


def test_relief_finds_the_attribute_that_matters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [float(i % 2) + 0.1 * rng.standard_normal(), *rng.random(3).tolist()]) for i in range(60)]
    x = spark.createDataFrame(rows, "id long, cls int, values array<double>")
    for scores in (ranking.relieff(x, 5), ranking.reliefseq(x, 5), ranking.best_k(x, [3, 5]), ranking.forest_scores(x, 10, 3)):
        assert scores.orderBy(F.desc("score")).first().attribute == 0
    assert ranking.turf(x, 5)[0][0] == 0 and ranking.evaporative_cooling(x, 5, 2, trees=5)[0][0] == 0
    out = ranking.private_cooling(x.where("id < 30"), x.where("id >= 30"), 3, 2)
    assert len(out["attributes"]) == 2 and len(out["told"]) == 2
    best = {r.attribute: r.score for r in ranking.best_k(x, [5]).collect()}
    assert best == pytest.approx({r.attribute: r.score for r in ranking.relieff(x, 5).collect()})


def test_segments(spark):
    seg = spark.createDataFrame([(1, 1, 1, 10, 20, 1, 5.0, 3), (2, 2, 1, 15, 25, 3, 1.0, 9), (3, 3, 2, 10, 20, 3, 9.0, 1)], "seg_id int, sample_id int, chr int, bp1 int, bp2 int, type int, score double, sites int")
    assert [r.seg_id for r in segments.cnv_filter(seg, least_score=2, kind="dup").collect()] == [3]
    assert {r.seg_id: r.n for r in segments.cnv_frequency(seg, 0.3).collect()} == {1: 2, 2: 2, 3: 1}
    pools = [(r.chr, r.start, r.stop, r.n) for r in segments.run_pools(seg.selectExpr("chr", "bp1 as start", "bp2 as stop")).collect()]
    assert pools == [(1, 15, 20, 2)]
    reg = spark.createDataFrame([(1, 12, 14, "r")], "chr int, bp1 int, bp2 int, name string")
    assert [r.seg_id for r in segments.cnv_intersect(seg, reg).collect()] == [1] and segments.cnv_intersect(seg, reg, exclude=True).count() == 2
    p = spark.createDataFrame([(1, i, float(i in (2, 3, 4, 7))) for i in range(9)], "pair int, idx int, post double")
    assert [(r.start, r.stop, r.n) for r in segments.ibd_segments(p).collect()] == [(2, 4, 3)]


def test_kendall(spark):
    a = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "attribute string, score double")
    b = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "attribute string, score double")
    assert ranking.kendall_tau(a, b).first().tau == pytest.approx(1 / 3)


def _segments(n, seed, places=300, longest=60):
    rng = np.random.default_rng(seed)
    a, w = rng.integers(0, places, n), rng.integers(0, longest, n)
    return [(i, i % 5, int(c), int(b), int(b + z)) for i, (c, b, z) in enumerate(zip(rng.integers(1, 3, n), a, w, strict=True))]


SEG = "seg_id int, sample_id int, chr int, bp1 int, bp2 int"


def _no_rows_for_pairs(monkeypatch):
    """Segments of these tests may not be joined by pairs of what is single."""
    def fail(*_, **__):
        raise AssertionError("a join by pairs")

    for name in ("overlap_join", "range_join"):
        monkeypatch.setattr(segments, name, fail)


@pytest.mark.parametrize("least", [0.3, 0.5, 0.1, 0.7, 1.0])
def test_segments_that_meet_by_a_share_are_counted_without_pairs(spark, monkeypatch, least):
    rows = _segments(150, 3) + [(1000 + i, 1, 1, 50, 70) for i in range(20)]
    want = {}
    for k, _, c, p, q in rows:
        m = [(min(q, s) - max(p, r) + 1, q - p + s - r + 2) for _, _, e, r, s in rows if c == e]
        want[k] = sum(x > 0 and x / (t - x) >= least for x, t in m)
    _no_rows_for_pairs(monkeypatch)
    assert {r.seg_id: r.n for r in segments.cnv_frequency(spark.createDataFrame(rows, SEG), least).collect()} == want


def test_genes_hit_are_counted_without_pairs(spark, monkeypatch):
    rows, genes = _segments(80, 4), [(int(c), b, b + 5, f"g{b}") for b in range(0, 300, 7) for c in (1, 2)]
    _no_rows_for_pairs(monkeypatch)
    got = segments.genes_hit(spark.createDataFrame(rows, SEG), spark.createDataFrame(genes, "chr int, start int, stop int, name string"))
    want = {k: n for k, _, c, p, q in rows if (n := sum(e == c and p <= b <= q for e, b, _, _ in genes))}
    assert {r.seg_id: r.genes for r in got.collect()} == want


def test_region_counts_join_only_what_occurs_twice(spark, monkeypatch):
    rows = _segments(90, 5)
    rows += [(0, 0, 1, 100, 120), (0, 0, 2, 10, 250)]
    regions = [(c, b, b + 30, f"r{c}.{b}") for b in range(0, 300, 25) for c in (1, 2)] + [(1, 10, 40, "twice"), (1, 30, 90, "twice")]
    aff, joined, plain = {k: k < 3 for k in range(4)}, [], segments.overlap_join
    monkeypatch.setattr(segments, "overlap_join", lambda a, b: joined.append((a.count(), b.count())) or plain(a, b))
    r, s = spark.createDataFrame(regions, "chr int, bp1 int, bp2 int, name string"), spark.createDataFrame(list(aff.items()), "sample_id int, aff boolean")
    got = {x.name: (x.aff, x.unaff) for x in segments.cnv_region_counts(spark.createDataFrame(rows, SEG), r, s).collect()}
    met = {(n, k, i) for c, a, z, n in regions for k, i, e, p, q in rows if c == e and p <= z and a <= q and i in aff}
    assert got == {n: (sum(m == n and aff[i] for m, _, i in met), sum(m == n and not aff[i] for m, _, i in met)) for n in {m for m, _, _ in met}}
    assert joined == [(92, 2), (3, 24)]


def test_equal_and_inner_regions_are_joined_once(spark, monkeypatch):
    rows = _segments(60, 6)
    regions = [(1, b, b + 40, str(k)) for k in range(30) for b in range(0, 300, 60)] + [(1, b + 5, b + 9, "in") for b in range(0, 300, 60)]
    want = {k for k, _, c, p, q in rows if not any(c == e and p <= z and a <= q and (min(q, z) - max(p, a) + 1) / (q - p + 1) >= 0.3 for e, a, z, _ in regions)}
    sizes, plain = [], segments.overlap_join
    monkeypatch.setattr(segments, "overlap_join", lambda a, b: sizes.append(b.count()) or plain(a, b))
    got = segments.cnv_intersect(spark.createDataFrame(rows, SEG), spark.createDataFrame(regions, "chr int, bp1 int, bp2 int, name string"), 0.3, exclude=True)
    assert {r.seg_id for r in got.collect()} == want and sizes == [5]


@pytest.mark.parametrize("by_class", [True, False])
def test_nearest_instances_of_blocks_are_those_of_all_rows(spark, monkeypatch, by_class):
    rng = np.random.default_rng(9)
    x = spark.createDataFrame([(int(i) * 2, int(i) % 3, [float(v) for v in rng.integers(0, 3, 4)]) for i in range(60)], "id long, cls int, values array<double>")
    columns = ["id", "cls", "oid", "ocls", "dist", "rank", "u", "v"]
    want = sorted(map(tuple, ranking._nearest_of_rows(x, 4, by_class, "manhattan").select(columns).collect()))
    monkeypatch.setattr(ranking, "BLOCK", 13)
    monkeypatch.setattr(ranking, "_nearest_of_rows", lambda *_: pytest.fail("rows for pairs"))
    assert sorted(map(tuple, ranking.nearest(x, 4, by_class).select(columns).collect())) == want
