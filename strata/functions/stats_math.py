"""Small closed-form distributions for p-values (no scipy in the image).

These run on tiny per-test tables (one row per column or model pair), via
Arrow-batched pandas UDFs; the rank work that feeds them is done in Spark.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x) (series / continued fraction)."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = 1.0 / a
        s = term
        n = 0
        while abs(term) > abs(s) * 1e-16 and n < 10_000:
            n += 1
            term *= x / (a + n)
            s += term
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b = x + 1 - a
    c = 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-16:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, dof: float) -> float:
    if x is None or dof is None or (isinstance(x, float) and math.isnan(x)) or dof <= 0:
        return float("nan")
    return _gammaincc(dof / 2.0, x / 2.0)


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def wilcoxon_exact_p(n: int, stat: float) -> float:
    """Two-sided exact p of the signed-rank statistic min(W+, W-) for n
    untied, non-zero differences: DP over the 2^n sign patterns."""
    if n <= 0:
        return float("nan")
    max_sum = n * (n + 1) // 2
    counts = [0] * (max_sum + 1)
    counts[0] = 1
    for r in range(1, n + 1):
        for s in range(max_sum, r - 1, -1):
            counts[s] += counts[s - r]
    k = int(math.floor(stat + 1e-9))
    cdf = sum(counts[: k + 1]) / float(2 ** n)
    return min(1.0, 2.0 * cdf)


def wilcoxon_normal_p(n: int, stat: float, tie_term: float) -> float:
    """Normal approximation with tie correction (no continuity correction)."""
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0
    if var <= 0:
        return float("nan")
    z = (stat - mean) / math.sqrt(var)
    return min(1.0, 2.0 * norm_sf(abs(z)))


@F.pandas_udf(T.DoubleType())
def chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) for a, b in zip(x, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def wilcoxon_p_udf(n: pd.Series, stat: pd.Series, tie_term: pd.Series, has_ties: pd.Series) -> pd.Series:
    out = []
    for k, s, t, tied in zip(n, stat, tie_term, has_ties):
        if k is None or pd.isna(k) or k == 0:
            out.append(float("nan"))
        elif k <= 50 and not tied:
            out.append(wilcoxon_exact_p(int(k), float(s)))
        else:
            out.append(wilcoxon_normal_p(int(k), float(s), float(t)))
    return pd.Series(out, dtype="float64")
