import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from cladeflow.operators import run_bitmaps as rb

runs = st.lists(st.tuples(st.integers(0, rb.SHARD - 1), st.integers(1, 3000)), max_size=60)


def bitmap(pairs):
    bits = np.zeros(rb.SHARD + 2, bool)
    for a, n in pairs:
        bits[a : min(a + n, rb.SHARD)] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([0], bits.astype(int), [0]))))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


@given(runs)
def test_union_and_container_round_trip(pairs):
    a = np.array([p[0] for p in pairs], np.int64)
    b = np.array([min(p[0] + p[1], rb.SHARD) for p in pairs], np.int64)
    _, s, e = rb.unite_runs(np.zeros(len(a), np.int64), a, b)
    assert list(zip(s.tolist(), e.tolist())) == bitmap(pairs)
    s2, e2 = rb.decode_container(rb.encode_container(s, e))
    assert s2.tolist() == s.tolist() and e2.tolist() == e.tolist()


def test_dense_container_becomes_bits():
    a = np.arange(0, rb.SHARD, 2)
    data = rb.encode_container(a, a + 1)
    assert data[:1] == b"B" and len(data) == rb.SHARD // 8 + 1
    s, e = rb.decode_container(data)
    assert (s == a).all() and (e == a + 1).all()


def brute(rows):
    covered, lengths = {}, {}
    for k, length, s, e in rows:
        if length is None or length < 1:
            continue
        lengths[k] = length
        bits = covered.setdefault(k, np.zeros(length + 2, bool))
        if s is not None and e is not None and s < e:
            bits[max(s, 1) : max(min(e, length + 1), 1)] = True
    gaps, periods = set(), set()
    for k, bits in covered.items():
        for want, out in ((False, gaps), (True, periods)):
            line = (bits[1 : lengths[k] + 1] == want).astype(int)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], line, [0]))))
            out |= {(k, int(x) + 1, int(y) + 1) for x, y in zip(edge[0::2], edge[1::2])}
    return gaps, periods


@pytest.mark.parametrize(("seed", "batch"), [(1, 10_000), (2, 7), (3, 1)])
def test_gaps_and_periods_against_bitmaps(spark, seed, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        check_against_bitmaps(spark, seed)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def check_against_bitmaps(spark, seed):
    r = np.random.default_rng(seed)
    length = {"a": 300_000, "b": 65_536, "c": 65_537, "d": 10, "e": 5, None: 131_072, "none": None, "zero": 0}
    rows = []
    for k, n in length.items():
        for _ in range(300 if k == "a" else 12):
            s = int(r.integers(-50, (n or 100) + 50))
            rows.append((k, n, s, s + int(r.integers(-20, 4000 if k != "d" else 4))))
    rows += [("a", 300_000, None, 5), ("a", 300_000, 5, None), ("c", 65_537, 65_536, 65_537), ("c", 65_537, 65_537, 65_538), ("e", 5, 9, 4), ("a", 300_000, 60_000, 200_000)]
    rows += rows[:40]  # repeated rows
    # a clashing extra column
    df = spark.createDataFrame([(*x, "x") for x in rows], "k string, length long, s long, e long, first string").drop("first")
    gaps, periods = brute(rows)
    assert {tuple(x) for x in rb.gaps(df, ["k"]).collect()} == gaps
    got = [tuple(x) for x in rb.periods(df, ["k"]).collect()]
    assert len(got) == len(set(got)) and set(got) == periods


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, length long, s long, e long")
    assert rb.gaps(df, ["k"]).count() == 0 and rb.periods(df, ["k"]).count() == 0


def test_huge_bounds_are_clipped(spark):
    df = spark.createDataFrame([("a", 100, -(2**60), 2**60), ("b", 100, 2**50, 2**60)], "k string, length long, s long, e long")
    assert [tuple(x) for x in rb.gaps(df, ["k"]).collect()] == [("b", 1, 101)]
