import math
import random

import pytest

from cladeflow.llm import mixing as mx

TARGETS = [("big", 0.5, 1), ("Mid-Size", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 2)]


def mixed(spark, docs, targets=TARGETS):
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, source string, n_tokens long, rate string")
    m = mx.mix(d, t)
    return m.collect(), {r["source"]: r for r in mx.shares(m, t).collect()}


def test_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mx, "DOCS_PER_RUN", 300)
    r = random.Random(2)
    docs = [(i, r.choice(["big", "BIG ", "big"]), r.randrange(1, 2000)) for i in range(4000)]
    docs += [(5000 + i, r.choice(["mid_size", "mid size"]), r.randrange(1, 2000)) for i in range(700)]
    docs += [(7000 + i, "small", r.randrange(1, 900)) for i in range(200)] + [(9000, None, 5), (9001, "other", 5), (9002, "big", 0), (9003, "big", None)]
    rows, shares = mixed(spark, docs)
    assert shares["absent"]["actual_share"] == 0
    for s, share in (("big", 0.5 / 0.95), ("mid_size", 0.3 / 0.95), ("small", 0.15 / 0.95)):
        assert shares[s]["actual_share"] == pytest.approx(share, abs=0.005)
    caps = {"big": 1, "mid_size": 2, "small": 4}
    ids = [x["doc_id"] for x in rows]
    assert len(ids) == len(set(ids)) == 4900
    for x in rows:
        assert 0 <= x["copies"] <= caps[x["source"]] and abs(x["copies"] - x["rate"]) < 1 + 1e-6 and 0 < x["rate"] <= caps[x["source"]]


def test_rates_meet_the_constraints(spark):
    docs = [(i, "a", 10 + i % 7) for i in range(500)] + [(1000 + i, "b", 100) for i in range(50)]
    rows, _ = mixed(spark, docs, [("a", 0.4, 3), ("b", 0.6, 2)])
    mass = {s: sum(x["rate"] * x["n_tokens"] for x in rows if x["source"] == s) for s in ("a", "b")}
    assert mass["a"] / mass["b"] == pytest.approx(0.4 / 0.6, rel=1e-6)


def test_nothing_to_mix(spark):
    rows, shares = mixed(spark, [(1, "other", 5)])
    assert rows == [] and all(x["actual_share"] == 0 for x in shares.values())
    assert mixed(spark, [])[0] == []


def test_sources_that_are_solved_stay_solved(spark):
    """Ten sources that take different numbers of steps; none leaves its solution while others are under way."""
    r = random.Random(0)
    lengths = {f"s{k}": [r.randrange(20, 4000) for _ in range(r.randrange(3, 40))] for k in range(10)}
    hist = spark.createDataFrame([(s, n, v.count(n)) for s, v in lengths.items() for n in set(v)], "source string, n_tokens long, n long")
    caps = {s: r.randrange(1, 5) for s in lengths}
    targets = {s: sum(v) * caps[s] * r.uniform(0.1, 0.95) for s, v in lengths.items()}
    means = {s: sum(v) / len(v) for s, v in lengths.items()}
    x = mx.solve_tilts(hist, targets, caps, means, steps=15)
    for s, v in lengths.items():
        got = sum(n * caps[s] / (1 + math.exp(-x[s] * n / means[s])) for n in v)
        assert abs(got - targets[s]) < 1e-6 * targets[s]
