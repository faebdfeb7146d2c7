import numpy as np

from cladeflow.operators import hierarchy, orphans


def chase(merged, x):
    seen = set()
    while x in merged:
        if x in seen:
            return None
        seen.add(x)
        x = merged[x]
    return x


def test_resolve_chains_and_circles(spark):
    merged = {1: 2, 2: 3, 3: 4, 10: 11, 11: 12, 12: 10, 20: 20, 30: 1, 40: 10}
    merged |= {1000 + i: 1001 + i for i in range(70)}
    df = spark.createDataFrame([*merged.items(), (1, 2), (None, 5)], "old_taxid long, new_taxid long")
    got = {r["old_id"]: r["final_id"] for r in hierarchy.resolve_merged(df).collect()}
    assert got == {k: chase(merged, k) for k in merged}
    assert hierarchy.resolve_merged(df.limit(0)).count() == 0


def brute_tree(parent):
    paths, cyc = {}, {}
    for n in parent:
        way, x = [], n
        while x is not None and x not in way:
            way.append(x)
            x = parent[x]
        if x is None:
            paths[n] = way[::-1]
        else:
            cyc[n] = min(way[way.index(x) :])
    return paths, cyc


def test_hierarchy_against_walks(spark):
    r = np.random.default_rng(3)
    parent = {n: (None if n % 41 == 0 else int(r.integers(0, n))) for n in range(1, 300)}
    parent = {n: (p if p != 0 else None) for n, p in parent.items()}
    parent |= {1000 + i: (1000 + i - 1 if i else 5) for i in range(20)}  # a chain
    parent |= {2000: 2002, 2001: 2000, 2002: 2001, 2003: 2001, 2004: 2003, 3000: 3001, 3001: 3000}
    df = spark.createDataFrame(list(parent.items()), "node long, parent long")
    reached, unreached = hierarchy.build_hierarchy(df)
    paths, cyc = brute_tree(parent)
    rows = reached.collect()
    assert {x["node"]: x["path"] for x in rows} == paths and len(rows) == len(paths)
    assert all(x["depth"] == len(x["path"]) - 1 and x["root"] == x["path"][0] for x in rows)
    assert {x["node"]: x["cycle_id"] for x in hierarchy.find_cycles(unreached).collect()} == cyc
    below = {n: sum(n in p for p in paths.values()) - 1 for n in paths}
    assert {x["node"]: x["descendants"] for x in hierarchy.descendant_counts(reached).collect()} == below
    assert hierarchy.descendants(reached).count() == sum(below.values())


def test_long_chain_and_a_star_below_it(spark):
    n = 3000
    parent = {i: (i - 1 if i else None) for i in range(n)} | {10_000 + i: n - 1 for i in range(500)} | {20_000: 20_001, 20_001: 20_000}
    df = spark.createDataFrame(list(parent.items()), "node long, parent long")
    reached, unreached = hierarchy.reach(df)
    rows = {r["node"]: (r["root"], r["depth"]) for r in reached.collect()}
    assert rows == {i: (0, i) for i in range(n)} | {10_000 + i: (0, n) for i in range(500)}
    assert {r["node"] for r in unreached.collect()} == {20_000, 20_001}
    only_cycle, left = hierarchy.reach(df.where("node >= 20000"))
    assert only_cycle.count() == 0 and left.count() == 2


def test_cycles_of_any_length_with_tails(spark):
    r = np.random.default_rng(9)
    parent, at = {}, 0
    for length in (1, 2, 3, 4, 7, 16, 33):
        ids = [int(x) for x in r.permutation(length)]
        parent |= {at + ids[k]: at + ids[(k + 1) % length] for k in range(length)}
        parent |= {at + 1000 + k: at + (1000 + k - 1 if k else 0) for k in range(length * 3)}
        at += 10_000
    df = spark.createDataFrame(list(parent.items()), "node long, parent long")
    _, cyc = brute_tree(parent)
    assert {x["node"]: x["cycle_id"] for x in hierarchy.find_cycles(df).collect()} == cyc


def test_parent_links_rules(spark):
    nodes = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 99, "x"), (4, None, "x"), (5, 50, "x"), (6, 60, "x"), (7, 2, "x"), (None, 1, "x")], "taxid long, parent_taxid long, parent string")
    merged = spark.createDataFrame([(50, 2), (60, 61), (61, 60), (7, 2)], "old_taxid long, new_taxid long")
    links = hierarchy.parent_links(nodes, hierarchy.resolve_merged(merged))
    assert {r["node"]: r["parent"] for r in links.collect()} == {1: None, 2: 1, 3: None, 4: None, 5: 2, 6: None}
    empty_reached, empty_left = hierarchy.build_hierarchy(links.limit(0))
    assert empty_reached.count() == 0 and hierarchy.find_cycles(empty_left).count() == 0


def test_orphans_every_reason(spark):
    refs = spark.createDataFrame([(1, 100, 5, "a"), (2, 101, 5, "b"), (3, 102, 5, "c"), (4, 103, 5, "d"), (5, 104, 5, "e"), (6, 105, 5, "f"), (7, 0, 5, "g"), (8, None, 5, "h"), (9, 100, None, "i"), (10, -1, 5, "j")] + [(100 + i, 100, 5, "hot") for i in range(500)], "id long, ref_id long, loaded_at long, reason string").drop("reason")
    parents = spark.createDataFrame([(100, 1), (100, 9), (101, 7), (102, 1), (200, 1), (None, 1)], "taxid long, loaded_at long")
    deleted = spark.createDataFrame([(102,), (102,), (300,)], "taxid long")
    merged = spark.createDataFrame([(103, 200), (104, 105), (105, 104)], "old_taxid long, new_taxid long")
    out = orphans.find_orphans(refs, parents, deleted, hierarchy.resolve_merged(merged))
    assert {r["id"]: r["reason"] for r in out.collect()} == {2: "late", 3: "deleted", 5: "missing", 6: "missing", 10: "missing"}
    assert orphans.find_orphans(refs.limit(0), parents, deleted, hierarchy.resolve_merged(merged)).count() == 0
    assert orphans.find_orphans(refs, parents.limit(0), deleted, hierarchy.resolve_merged(merged)).count() == 508


def test_bloom_never_denies_a_parent(spark):
    parents = spark.range(0, 40_000, 2).withColumnRenamed("id", "taxid")
    table, words = orphans.build_bloom(parents, "taxid")
    probed = orphans.bloom_split(spark.range(40_000).withColumnRenamed("id", "k"), "k", table, words)
    denied = [r["k"] for r in probed.where("not _maybe").select("k").collect()]
    assert all(k % 2 for k in denied) and len(denied) > 0.95 * 20_000
