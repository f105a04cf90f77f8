"""Distribution functions: as columns where they have a closed form, and as vectorised functions on arrays.

``norm_cdf`` and ``chi2_sf1`` are column expressions and stay in generated code.  The rest (t, F, chi-square of any degrees,
exact tests) are numpy functions; ``arrow_udf`` makes an Arrow-batched column function of each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def _scaled_erfc(z: float) -> float:
    """exp(z * z) * erfc(z) for z >= 0, beyond 4 by its continued fraction."""
    if z <= 4:
        return math.exp(z * z) * math.erfc(z)
    f = z
    for k in range(120, 0, -1):
        f = z + k / 2 / f
    return 1 / (f * math.sqrt(math.pi))


def _fit(degree: int = 24) -> list[float]:
    """Coefficients in u = 2 t - 1 of log(exp(z * z) erfc(z) / t), t = 2 / (2 + z), which is smooth down to t = 0."""
    def log_of(u):
        t = (np.atleast_1d(u) + 1) / 2
        return np.array([math.log(_scaled_erfc(2 / x - 2) / x) for x in t])

    c = np.polynomial.chebyshev.chebinterpolate(log_of, degree)
    return np.polynomial.chebyshev.cheb2poly(c).tolist()


_TAIL = _fit()


def upper_tail(x: Column) -> Column:
    """P(Z > |x|) of a standard normal, to about ten digits however small it is."""
    z = F.abs(x) / math.sqrt(2)
    u = 4.0 / (2.0 + z) - 1.0
    poly = F.lit(_TAIL[-1])
    for c in reversed(_TAIL[:-1]):
        poly = poly * u + F.lit(c)
    return F.exp(poly - z * z) / (2.0 + z)


def norm_cdf(x: Column) -> Column:
    return F.when(x >= 0, 1.0 - upper_tail(x)).otherwise(upper_tail(x))


def chi2_sf1(x: Column) -> Column:
    """P(X > x) of a chi-square of one degree; null outside its domain."""
    return F.when(x >= 0, 2.0 * upper_tail(F.sqrt(x)))


def div(a: Column, b: Column) -> Column:
    """a / b as doubles, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def quick_round(x: Column, digits: int) -> Column:
    """F.round of a double without decimals: a quotient of whole numbers is the same double; near a tie, and where large, F.round itself."""
    y = x * 10.0**digits
    k = F.rint(y)
    return F.when((F.abs(y - k) < 0.499999) & (F.abs(y) < 1e9), k / 10.0**digits).otherwise(F.round(x, digits))


def n_if(cond: Column) -> Column:
    """How many rows fulfil a condition, as a long."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def sum_if(cond: Column, x: Column) -> Column:
    return F.sum(F.when(cond, x).otherwise(0))


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def gamma_q(a, x):
    """Regularised upper incomplete gamma function, by series and continued fraction."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    low, high = ok & (x < a + 1), ok & (x >= a + 1)
    with np.errstate(all="ignore"):
        if low.any():
            s, v = a[low], x[low]
            term = 1 / s
            total = term.copy()
            for n in range(1, 1000):
                term = term * v / (s + n)
                total += term
                if (np.abs(term) < np.abs(total) * 1e-16).all():
                    break
            out[low] = 1 - np.where(v == 0, 0, total * np.exp(-v + s * np.log(np.where(v > 0, v, 1)) - _lgamma(s)))
        if high.any():
            s, v = a[high], x[high]
            b = v + 1 - s
            c, d = np.full(s.shape, 1e300), 1 / b
            h = d.copy()
            for n in range(1, 1000):
                an = -n * (n - s)
                b = b + 2
                d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
                c = b + an / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                step = d * c
                h = h * step
                if (np.abs(step - 1) < 1e-15).all():
                    break
            out[high] = np.exp(-v + s * np.log(v) - _lgamma(s)) * h
    return out


def beta_i(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    if not ok.any():
        return out
    a, b, x = a[ok], b[ok], x[ok]
    swap = x > (a + 1) / (a + b + 2)
    p, q, v = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(v) + q * np.log1p(-v))
        c, d = np.ones(p.shape), 1 - (p + q) * v / (p + 1)
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        h = d.copy()
        for m in range(1, 1000):
            last = h.copy()
            for num in (m * (q - m) * v / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * v / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                h = h * d * c
            if (np.abs(h - last) <= np.abs(h) * 1e-15).all():
                break
        value = np.where(v <= 0, 0.0, front * h / p)
    out[ok] = np.where(swap, 1 - value, value)
    return out


def chi2_sf(x, df):
    return gamma_q(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def t_sf2(t, df):
    """Two-sided p of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_i(df / 2, 0.5, df / (df + t * t))


def f_sf(f, df1, df2):
    f, df1, df2 = (np.asarray(x, float) for x in (f, df1, df2))
    return beta_i(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def binom_sf(k, n, p):
    """P(X >= k)."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    return np.where(k <= 0, 1.0, np.where(k > n, 0.0, beta_i(np.maximum(k, 1e-9), np.maximum(n - k + 1, 1e-9), p)))


def poisson_sf(k, mean):
    """P(X >= k)."""
    k, mean = np.broadcast_arrays(np.asarray(k, float), np.asarray(mean, float))
    return np.where(k <= 0, 1.0, 1 - gamma_q(np.maximum(k, 1e-9), mean))


def norm_sf(x):
    """P(Z > x) by the error function's complement."""
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(np.asarray(x, float) / math.sqrt(2))


def _solve(f: Callable, p, low, high, rounds: int = 200):
    """Where a falling function has the value p, by halving."""
    p = np.asarray(p, float)
    low, high = np.full(p.shape, float(low)), np.full(p.shape, float(high))
    for _ in range(rounds):
        mid = (low + high) / 2
        above = f(mid) > p
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


def chi2_isf(p, df):
    return _solve(lambda x: chi2_sf(x, df), p, 0, 1e4)


def norm_isf(p):
    return _solve(norm_sf, p, -40, 40)


def t_isf2(p, df):
    return _solve(lambda x: t_sf2(x, df), p, 0, 1e6)


def hwe_exact(het: int, hom1: int, hom2: int) -> float:
    """Exact Hardy-Weinberg p: the share of heterozygote counts, given the alleles, that are as unlikely as the observed."""
    n, rare = het + hom1 + hom2, 2 * min(hom1, hom2) + het
    if n == 0:
        return math.nan
    hets = np.arange(rare % 2, rare + 1, 2)
    r, c = (rare - hets) / 2, n - hets - (rare - hets) / 2
    logs = hets * math.log(2) - _lgamma(hets + 1) - _lgamma(r + 1) - _lgamma(c + 1)
    prob = np.exp(logs - logs.max())
    prob /= prob.sum()
    seen = prob[hets == het][0]
    return float(min(1.0, prob[prob <= seen * (1 + 1e-12)].sum()))


def fisher_2x2(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2x2 table: all tables with its margins that are no likelier."""
    if a + b + c + d == 0:
        return math.nan
    x = np.arange(max(0, a - d), min(a + b, a + c) + 1)
    logs = -(_lgamma(x + 1) + _lgamma(a + b - x + 1) + _lgamma(a + c - x + 1) + _lgamma(d - a + x + 1))
    margins = sum(math.lgamma(m + 1) for m in (a + b, c + d, a + c, b + d)) - math.lgamma(a + b + c + d + 1)
    return float(min(1.0, np.exp(logs[logs <= logs[a - x[0]] + 1e-9] + margins).sum()))


def fisher_exact(table: list[list[int]]) -> float:
    """Two-sided exact p of an r x c table, by a walk over its columns that keeps what the rows have left."""
    rows, cols = [sum(r) for r in table], [sum(c) for c in zip(*table, strict=True)]
    n = sum(rows)
    if n == 0:
        return math.nan
    lf = _lgamma(np.arange(n + 1) + 1.0)
    margins = sum(lf[r] for r in rows) + sum(lf[c] for c in cols) - lf[n]
    seen = margins - sum(lf[x] for r in table for x in r)

    def fill(left: tuple[int, ...], need: int):
        if len(left) == 1:
            if need <= left[0]:
                yield (need,)
            return
        for x in range(min(left[0], need) + 1):
            for rest in fill(left[1:], need - x):
                yield (x, *rest)

    # Rows that are left -> log weights of the ways to get there.
    states: dict[tuple[int, ...], list[float]] = {tuple(rows): [0.0]}
    for c in cols:
        nxt: dict[tuple[int, ...], list[float]] = {}
        for left, weights in states.items():
            for x in fill(left, c):
                cost = sum(lf[v] for v in x)
                nxt.setdefault(tuple(a - v for a, v in zip(left, x, strict=True)), []).extend(w - cost for w in weights)
        states = nxt
    logs = np.array(next(iter(states.values()))) + margins
    return float(min(1.0, np.exp(logs[logs <= seen + 1e-9]).sum()))


def arrow_udf(f: Callable, returns: str = "double") -> Callable[..., Column]:
    """A column function, in Arrow batches, of a function on arrays."""

    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(f(*(c.to_numpy(dtype=float, na_value=np.nan) for c in cols)), float))

    return F.pandas_udf(run, returns)


def six_digits(x: Column) -> Column:
    """Six significant digits of the double itself, as C and SQL's printf round; the JVM's formatter rounds its shortest decimal form."""
    return arrow_udf(lambda a: [float(f"{v:.5e}") for v in a])(x)


def _each(f: Callable) -> Callable:
    return lambda *xs: [f(*(int(v) for v in row)) if not np.isnan(row).any() else math.nan for row in np.stack(xs, axis=1)]


def chi2_p(x: Column, df: Column) -> Column:
    return arrow_udf(lambda a, b: chi2_sf(a, b))(x, df)


def t_p(t: Column, df: Column) -> Column:
    return arrow_udf(lambda a, b: t_sf2(a, b))(t, df)


def f_p(f: Column, df1: Column, df2: Column) -> Column:
    return arrow_udf(lambda a, b, c: f_sf(a, b, c))(f, df1, df2)


def hwe_p(het: Column, hom1: Column, hom2: Column) -> Column:
    return arrow_udf(lambda a, b, c: _each(hwe_exact)(a, b, c))(het, hom1, hom2)


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    return arrow_udf(lambda p, q, r, s: _each(fisher_2x2)(p, q, r, s))(a, b, c, d)


def welch_t(m1, v1, n1, m2, v2, n2):
    """Welch's t from two groups' means, variances and sizes."""
    return (m1 - m2) / np.sqrt(v1 / n1 + v2 / n2)


def entropy(counts) -> float:
    """Shannon entropy in bits."""
    p = np.asarray(counts, float)
    p = p[p > 0] / p.sum()
    return float(-(p * np.log2(p)).sum())


def mcnemar_bowker(table: np.ndarray) -> tuple[float, int]:
    """Chi-square of symmetry of a square table, and its degrees."""
    a, b = np.triu_indices(len(table), 1)
    x, y = table[a, b].astype(float), table[b, a].astype(float)
    ok = x + y > 0
    return float(((x - y)[ok] ** 2 / (x + y)[ok]).sum()), int(ok.sum())


def bh_adjust(p: np.ndarray) -> np.ndarray:
    """Benjamini-Hochberg adjusted p values."""
    order = np.argsort(p, kind="stable")
    ranked = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(1, np.minimum.accumulate(ranked[::-1])[::-1])
    return out
