"""Occupancy statistics: expected breadth and the p-value of an observed one.

Spark has neither the error function nor the incomplete beta function nor ln-gamma, so the p-value is a
pandas UDF over the few rows that a profile has.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT_MAX_N, EXACT_MAX_READS = 3000, 100


def expected_breadth(depth: Column, reads: Column, clamp: bool = False) -> Column:
    """1 - (1 - depth / reads) ^ reads; NaN for a depth above one a read unless clamped."""
    miss = 1 - depth / reads
    if clamp:
        miss = F.greatest(F.least(miss, F.lit(1.0)), F.lit(0.0))
    return F.when(reads == 0, F.lit(0.0)).otherwise(1 - F.pow(miss, reads))


def genome_length(maplen: Column, depth: Column) -> Column:
    return F.when(depth <= 2.220446049250313e-16, F.lit(0.0)).otherwise(maplen / depth)


def flex_chunks(length: Column) -> Column:
    return F.when(length <= 0, F.lit(1)).otherwise(F.greatest(F.floor(F.sqrt(length) / 2), F.lit(1))).cast("long")


def expected_flex(chunks: Column, reads: Column) -> Column:
    return 1 - F.pow(1 - 1 / chunks, reads)


def cells_from_depth(reads: int, depth: float | None) -> int | None:
    if not reads or depth is None or not math.isfinite(depth) or depth <= 0:
        return None
    return max(1, math.floor(reads / depth + 0.5))


def cells_from_breadth(reads: int, p: float) -> int | None:
    if not reads:
        return None
    if p <= 0 or p >= 1:
        return max(reads, 1)
    low = math.log1p(-p) if 1 - p == 1 else math.log(1 - p)
    return max(1, math.floor(-reads / low + 0.5)) if low else None


def occupied(breadth: float, cells: int) -> int | None:
    if not math.isfinite(breadth) or not 0 <= breadth <= 1:
        return None
    return min(max(math.floor(breadth * cells + 0.5), 0), cells)


@lru_cache(maxsize=256)
def log_stirling2(balls: int) -> np.ndarray:
    """ln S(balls, k) for k = 0 .. balls, by the recurrence in logarithms."""
    row = np.array([0.0])
    for m in range(1, balls + 1):
        k = np.arange(1, m + 1)
        keep = np.append(row[1:], -np.inf) + np.log(k)
        row = np.concatenate(([-np.inf], np.logaddexp(keep, row)))
    return row


def log_pmf(cells: int, balls: int) -> np.ndarray:
    """ln P(K = k), k = 0 .. min(cells, balls): how many of ``cells`` hold a ball after ``balls`` throws."""
    top = min(cells, balls)
    k = np.arange(top + 1)
    choose = np.array([math.lgamma(cells + 1) - math.lgamma(cells - i + 1) for i in k])  # C(n, k) k!
    return choose + log_stirling2(balls)[: top + 1] - balls * math.log(cells)


def p_exact(cells: int, balls: int, k: int, upper: bool) -> float:
    top = min(cells, balls)
    k = min(k, top)
    if k == 0:
        return 1.0 if upper else 0.0
    pmf = np.exp(log_pmf(cells, balls))
    if upper:
        return float(min(1.0, max(0.0, 1 - pmf[:k].sum())))
    return 1.0 if k >= top else float(min(1.0, pmf[: k + 1].sum()))


def beta_regularized(a: float, b: float, x: float) -> float:
    """I_x(a, b) by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_regularized(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    away = lambda v: v if abs(v) > 1e-300 else 1e-300
    c, d = 1.0, 1 / away(1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / away(1 + step * d)
            c = away(1 + step / c)
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def p_binomial(n: int, p: float, k: int, upper: bool) -> float:
    def cdf(j: int) -> float:
        return 0.0 if j < 0 else 1.0 if j >= n else beta_regularized(n - j, j + 1, 1 - p)

    return min(1.0, max(0.0, 1 - cdf(k - 1) if upper else cdf(k)))


def p_normal(n: int, p: float, k: int, upper: bool) -> float | None:
    var = n * p * (1 - p)
    if var <= 0:
        return None
    z = (k + (-0.5 if upper else 0.5) - n * p) / math.sqrt(var)
    low = 0.5 * (1 + math.erf(z / math.sqrt(2)))
    return min(1.0, max(0.0, 1 - low if upper else low))


def breadth_pvalue(reads: int, depth: float | None, breadth: float, expected: float | None, upper: bool | None) -> float | None:
    """Exact for few reads and cells, else normal where it holds, else binomial. None where undefined. ``upper``: the upper or
    the lower tail, or None for both (twice the smaller one)."""
    if upper is None:
        tails = [breadth_pvalue(reads, depth, breadth, expected, u) for u in (False, True)]
        return None if None in tails else min(1.0, 2 * min(tails))
    if not reads or not math.isfinite(breadth) or not 0 <= breadth <= 1:
        return None
    if expected is None:
        expected = 1 - math.exp(-depth) if depth and depth > 0 else None
    if expected is None or math.isnan(expected):
        return None
    p = 1 - 1e-12 if expected >= 1 else max(expected, 0.0)
    if p <= 0 or p >= 1:
        return None
    n = cells_from_depth(reads, depth) or cells_from_breadth(reads, p)
    k = occupied(breadth, n) if n else None
    if k is None:
        return None
    if n <= EXACT_MAX_N and reads <= EXACT_MAX_READS:
        return p_exact(n, reads, k, upper)
    if min(n * p, n * (1 - p)) >= 20 and 0.05 <= p <= 0.95:
        value = p_normal(n, p, k, upper)
        if value is not None:
            return value
    return p_binomial(n, p, k, upper)


@F.pandas_udf(T.DoubleType())
def pvalue_udf(reads: pd.Series, depth: pd.Series, breadth: pd.Series, expected: pd.Series, upper: pd.Series) -> pd.Series:
    none = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else x
    return pd.Series([breadth_pvalue(int(r), none(d), b, none(e), bool(u)) for r, d, b, e, u in zip(reads, depth, breadth, expected, upper)], dtype="float64")


def tested_probability(reads: Column, depth: Column | None, observed: Column, expected: Column, taxa: Column, is_species: Column) -> Column:
    """1 where the ratio is within [0.9, 1.2], else the p-value times the number of taxa, capped at 1;
    null where it can't be said."""
    ratio = observed / expected
    asked = is_species & (expected > 0) & ~F.isnan(expected) & ~F.isnan(ratio) & (F.abs(ratio) != float("inf"))
    p = pvalue_udf(F.floor(reads + 0.5).cast("long"), F.lit(None).cast("double") if depth is None else depth, observed, expected, observed >= expected)
    p = F.when(F.isnan(p), None).otherwise(p)
    same = F.abs(observed - expected) <= 2.220446049250313e-16
    value = F.when((ratio >= 0.9) & (ratio <= 1.2), F.lit(1.0)).when(same, F.least(taxa * 1.0, F.lit(1.0))).otherwise(F.least(p * taxa, F.lit(1.0)))
    return F.when(asked, value)
