import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeflow.functions import render, stats
from cladeflow.functions.cigar import cigar_stats

CIGARS = {"80=5I5=10X5H": (85 / 96, 85, 1.0), "50=50X": (0.5, 50, 1.0), "100M": (1.0, 100, 1.0), "70=30S": (1.0, 70, 0.7), "10M2I3I10M": (20 / 21, 20, 1.0), "10M2I3D10M": (20 / 22, 20, 1.0), "10M2I5N3I10M": (20 / 22, 20, 1.0), "10M2I0N3I10M": (20 / 21, 20, 1.0), "5M90=10S": (1.0, 90, 95 / 105), "*": (0, 0, 0), "": (0, 0, 0), "M": (0, 0, 0)}


def test_cigars(spark):
    df = spark.createDataFrame([(c,) for c in CIGARS] + [(None,)], "c string").select("c", cigar_stats(F.col("c")).alias("s"))
    got = {r["c"]: r["s"] for r in df.collect()}
    assert got.pop(None) is None
    for c, want in CIGARS.items():
        assert tuple(got[c]) == pytest.approx(want), c
    bases = spark.createDataFrame([("10M2I3I10M",)], "c string").select(cigar_stats(F.col("c"), gap_compressed=False)["identity"].alias("x")).first()["x"]
    assert bases == pytest.approx(20 / 25)


@pytest.mark.parametrize(("n", "m"), [(4, 3), (10, 5), (3, 6), (1, 4), (6, 1)])
def test_occupancy_by_enumeration(n, m):
    counts = np.zeros(min(n, m) + 1)
    for way in itertools.product(range(n), repeat=m):
        counts[len(set(way))] += 1
    pmf = counts / n**m
    assert np.exp(stats.log_pmf(n, m)) == pytest.approx(pmf)
    for k in range(1, min(n, m) + 1):
        assert stats.p_exact(n, m, k, False) == pytest.approx(pmf[: k + 1].sum())
        assert stats.p_exact(n, m, k, True) == pytest.approx(pmf[k:].sum())
    assert stats.p_exact(n, m, 0, False) == 0 and stats.p_exact(n, m, 0, True) == 1


def test_known_occupancies():
    assert np.exp(stats.log_pmf(4, 3))[1:] == pytest.approx([0.0625, 0.5625, 0.375])
    assert np.exp(stats.log_pmf(10, 5))[1:] == pytest.approx([0.0001, 0.0135, 0.18, 0.504, 0.3024])


@pytest.mark.parametrize(("n", "p"), [(10, 0.3), (57, 0.02), (200, 0.9), (1000, 0.5)])
def test_binomial_against_sums(n, p):
    pmf = np.array([math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)) for k in range(n + 1)])
    for k in {0, 1, n // 3, n // 2, n - 1, n}:
        assert stats.p_binomial(n, p, k, False) == pytest.approx(pmf[: k + 1].sum(), abs=1e-10)
        assert stats.p_binomial(n, p, k, True) == pytest.approx(pmf[k:].sum(), abs=1e-10)


def test_normal_is_close_to_binomial():
    for k in (450, 480, 500, 530):
        assert stats.p_normal(1000, 0.5, k, False) == pytest.approx(stats.p_binomial(1000, 0.5, k, False), abs=2e-3)


def test_dispatch_and_edges():
    assert 0 <= stats.breadth_pvalue(5, 10.0, 0.8, 1.0, True) <= 1
    assert stats.breadth_pvalue(0, 1.0, 0.5, 0.5, False) is None
    assert stats.breadth_pvalue(5, 1.0, 1.5, 0.5, False) is None and stats.breadth_pvalue(5, 1.0, math.nan, 0.5, False) is None
    assert stats.breadth_pvalue(5, 1.0, 0.5, 0.0, False) is None and stats.breadth_pvalue(5, None, 0.5, None, False) is None
    both = [stats.breadth_pvalue(30, 0.5, 0.3, 0.4, u) for u in (False, True, None)]
    assert both[2] == pytest.approx(min(1, 2 * min(both[:2]))) and stats.breadth_pvalue(0, 1.0, 0.5, 0.5, None) is None
    # 56 cells, 3 balls, 2 occupied
    assert stats.p_exact(56, 3, 2, False) == pytest.approx(1 - 55 * 54 / 56**2)


def test_rendering(spark):
    values = [0.0, 1.0, 0.123456, 1.5e-7, -2e-5, 1e-13, 9.99e-5, math.nan, math.inf, None, 1.5e-10]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(render.probability(F.col("x")).alias("p"), render.round5(F.col("x")).alias("r"))
    assert [r["p"] for r in df.collect()] == ["0.00000", "1.00000", "0.12346", "1.500000e-7", "-2.000000e-5", "0.00000", "9.990000e-5", "NA", "NA", "NA", "1.500000e-10"]
    halves = spark.createDataFrame([(0.125,), (-0.125,)], "x double").select(render.round5(F.col("x") / 1e4 * 8 * 5).alias("r")).collect()
    assert [h["r"] for h in halves] == [0.0005, -0.0005]
