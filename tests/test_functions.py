import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandflow.functions import distance, stats


def test_distributions_at_known_points():
    assert stats.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_sf(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.binom_sf(8, 10, 0.5) == pytest.approx(56 / 1024)
    assert stats.poisson_sf(2, 1.0) == pytest.approx(1 - 2 / math.e)
    assert stats.norm_sf(1.959964) == pytest.approx(0.025, abs=1e-7)
    assert stats.chi2_isf(0.05, 1) == pytest.approx(3.841459, abs=1e-5) and stats.norm_isf(0.025) == pytest.approx(1.959964, abs=1e-5) and stats.t_isf2(0.05, 10) == pytest.approx(2.228139, abs=1e-5)
    assert np.isnan(stats.chi2_sf(-1, 1)) and stats.chi2_sf(0, 3) == 1


@given(st.floats(0.01, 200), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_chi2_is_a_special_gamma_and_falls(x, k):
    a, b = float(stats.chi2_sf(x, k)), float(stats.chi2_sf(x + 1, k))
    assert 0 <= b <= a <= 1
    if k == 2:
        assert a == pytest.approx(math.exp(-x / 2), rel=1e-9)


@given(st.integers(0, 12), st.integers(0, 12), st.integers(0, 12), st.integers(0, 12))
@settings(max_examples=60, deadline=None)
def test_fisher_against_plain_sum(a, b, c, d):
    if a + b + c + d == 0:
        return
    r, k, n = a + b, a + c, a + b + c + d
    prob = lambda x: math.comb(r, x) * math.comb(n - r, k - x) / math.comb(n, k)
    every = [prob(x) for x in range(max(0, k - (n - r)), min(r, k) + 1)]
    assert stats.fisher_2x2(a, b, c, d) == pytest.approx(min(1, sum(p for p in every if p <= prob(a) * (1 + 1e-7))), rel=1e-6)


@given(st.integers(0, 30), st.integers(0, 30), st.integers(0, 30))
@settings(max_examples=60, deadline=None)
def test_hwe_exact_against_plain_sum(het, a, b):
    n = het + a + b
    if not n:
        assert math.isnan(stats.hwe_exact(het, a, b))
        return
    p = 2 * a + het
    ways = {h: 2**h * math.factorial(n) // (math.factorial(h) * math.factorial((p - h) // 2) * math.factorial(n - h - (p - h) // 2)) for h in range(p % 2, min(p, 2 * n - p) + 1, 2)}
    want = sum(w for w in ways.values() if w <= ways[het]) / sum(ways.values())
    assert stats.hwe_exact(het, a, b) == pytest.approx(want, rel=1e-6)


def test_fisher_2x3_is_a_distribution():
    assert stats.fisher_exact([[3, 2, 1], [1, 2, 3]]) == pytest.approx(stats.fisher_exact([[1, 2, 3], [3, 2, 1]]))
    assert stats.fisher_exact([[5, 5, 5], [5, 5, 5]]) == pytest.approx(1.0)


def test_columns_equal_functions(spark):
    df = spark.createDataFrame([(0.5, 3.0), (4.0, 10.0), (None, 2.0), (9.0, 1.0)], "x double, k double")
    rows = df.select("x", "k", stats.chi2_sf1(F.col("x")).alias("c"), stats.chi2_p(F.col("x"), F.col("k")).alias("p"), stats.norm_cdf(-F.col("x")).alias("n"), stats.t_p(F.col("x"), F.col("k")).alias("t")).collect()
    for r in rows:
        if r.x is None:
            assert r.c is None
            continue
        assert r.c == pytest.approx(float(stats.chi2_sf(r.x, 1)), abs=2e-7) and r.p == pytest.approx(float(stats.chi2_sf(r.x, r.k))) and r.n == pytest.approx(float(stats.norm_sf(r.x)), abs=1e-7) and r.t == pytest.approx(float(stats.t_sf2(r.x, r.k)))


def test_tails_hold_however_small(spark):
    xs = [i / 8 for i in range(300)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.upper_tail(-F.col("x")).alias("p"), stats.chi2_sf1(F.col("x") * F.col("x")).alias("c")).collect()
    for r in rows:
        want = math.erfc(r.x / math.sqrt(2))
        assert r.p == pytest.approx(want / 2, rel=1e-9) and r.c == pytest.approx(want, rel=1e-9)
    assert 0 < rows[-1].p < 1e-300


def test_small_helpers():
    assert stats.mcnemar_bowker(np.array([[1, 5], [3, 2]])) == (0.5, 1)
    assert stats.bh_adjust(np.array([0.01, 0.02, 0.04])) == pytest.approx([0.03, 0.03, 0.04])
    assert stats.entropy([1, 1]) == 1 and distance.jukes_cantor(0.0) == 0 and distance.jukes_cantor(0.8) == math.inf
    assert distance.kimura(0.1, 0.05) > distance.jukes_cantor(0.15)


def test_distances(spark):
    r = spark.createDataFrame([([0.0, 1.0, 2.0], [2.0, 1.0, None])], "a array<double>, b array<double>").select(distance.genotype_mismatch(F.col("a"), F.col("b")).alias("gm"), distance.allele_mismatch(F.col("a"), F.col("b")).alias("am"), distance.euclidean(F.slice("a", 1, 2), F.slice("b", 1, 2)).alias("e")).first()
    assert (r.gm, r.am, r.e) == (pytest.approx(1 + 2 / 3), pytest.approx(1 + 2 / 3), 2.0)


def test_six_digits_round_the_double_and_not_its_shortest_form(spark):
    import duckdb

    values = [0.2550625, 0.2467915, 1.000005e-9, 0.1234565, 0.25, 0.0, 1e-300, None]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "x double").select(stats.six_digits(F.col("x")).alias("v")).collect()]
    assert got == [duckdb.sql(f"SELECT printf('%.5e', {v!r}::DOUBLE)::DOUBLE").fetchall()[0][0] if v is not None else None for v in values]


@pytest.mark.parametrize("name", ["p_value_filter", "result_files"])
def test_p_values_are_those_of_sql_to_the_last_digit(spark, name):
    import duckdb

    from strandflow.plans import registry

    c, sf = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("part", "embeddings", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.SQL[name]})").fetchall())


def test_quick_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(4)
    values = [*rng.random(3000).tolist(), *(rng.standard_normal(500) * 1e4).tolist(), *(k / 128 for k in range(-129, 129)), *(k / 200000 for k in range(-999, 999, 7)), 0.0, -0.0, 1e-9, -1e-9, 123456.000005, 1e15 / 3, 1e300, float("nan"), float("inf"), None]
    x = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (5, 6):
        r = x.select((stats.quick_round(F.col("x"), digits) + 0.0).alias("q"), (F.round("x", digits) + 0.0).alias("r"))
        assert r.where("not (q <=> r)").count() == 0
    assert "rint" in r._jdf.queryExecution().executedPlan().toString().lower()
