import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cladeflow.llm import packing as pk


def padding(counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in enumerate(counts) if n)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=8, max_size=10), st.integers(1, 4))
def test_boundaries_are_optimal(counts, k):
    counts = np.array([0, *counts])
    used = np.flatnonzero(counts)
    bounds = pk.choose_boundaries(counts, k)
    if len(used) == 0:
        assert bounds == []
        return
    choices = itertools.chain(*(itertools.combinations(used[:-1], j) for j in range(min(k, len(used)))))
    assert len(bounds) <= k and padding(counts, bounds) == min(padding(counts, [*c, used[-1]]) for c in choices)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), max_size=12))
def test_plan_holds_everything_once_within_capacity(amounts):
    bounds = sorted(amounts)
    plan, containers = pk.plan_containers(bounds, [amounts[b] for b in bounds], 100)
    load, seen = [0] * containers, {k: [] for k in range(len(bounds))}
    for r in plan:
        for number in range(r.first, r.stop):
            load[r.container + (number - r.first) // r.each] += bounds[r.bucket]
            seen[r.bucket].append(number)
    assert all(0 < x <= 100 for x in load)
    assert all(sorted(v) == list(range(amounts[bounds[k]])) for k, v in seen.items())


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(pk, "ITEMS_PER_SALT", 100)
    r = random.Random(1)
    sizes = [(i, r.choice([r.randrange(1, 300), r.randrange(1, 3000), 1024, 1025])) for i in range(1500)]
    sizes += [(2000, 0), (2001, None), (2002, 2048), (2003, 4096), (2004, 9000)]
    df = spark.createDataFrame([(*x, "z") for x in sizes], "doc_id long, n_tokens long, bucket string")
    rows = pk.pack(df).collect()
    by_doc, load = {}, {}
    for x in rows:
        by_doc.setdefault(x["doc_id"], []).append((x["piece"], x["start"], x["length"]))
        if x["container"] is not None:
            load[x["container"]] = load.get(x["container"], 0) + x["length"]
    assert max(load.values()) <= 2048
    for i, n in sizes:
        pieces = sorted(by_doc[i])
        assert len(pieces) == max(1, -(-(n or 0) // 2048)) and sum(p[2] for p in pieces) == (n or 0)
        assert [p[1] for p in pieces] == [2048 * k for k in range(len(pieces))]
    report = pk.report(df).first()
    lengths = [x["length"] for x in rows if x["container"] is not None]
    least = max(sum(n > 1024 for n in lengths) + -(-sum(n == 1024 for n in lengths) // 2), -(-sum(lengths) // 2048))
    assert report["containers"] == len(load) and report["tokens"] == sum(lengths) and len(load) <= 1.03 * least
    assert report["containers"] <= report["containers_within_buckets"]


def test_nothing_to_pack(spark):
    df = spark.createDataFrame([(1, 0)], "doc_id long, n_tokens long")
    assert [x["container"] for x in pk.pack(df).collect()] == [None]
    assert pk.pack(df.limit(0)).count() == 0
