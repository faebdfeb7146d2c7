from collections import Counter

from pyspark.sql import functions as F

from cladeflow.operators import fragment_replicate as fr


def skewed(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i % 97}", i) for i in range(1500)] + [(None, i) for i in range(900)] + [("", 1), ("", 1)]
    return rows, spark.createDataFrame(rows, "k string, v long")


def test_aggregate_equals_counter(spark):
    rows, df = skewed(spark)
    right = spark.createDataFrame([("hot", "H"), ("k1", "one"), ("absent", "x"), (None, "null")], "k string, label string")
    out = fr.balanced_aggregate(df, ["k"], {"n": F.count(F.lit(1)), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")}, right=right)
    got = {r["k"]: (r["n"], r["s"], r["label"]) for r in out.collect()}
    count = Counter(k for k, _ in rows)
    total = {k: sum(v for x, v in rows if x == k) for k in count}
    assert got == {k: (count[k], total[k], {"hot": "H", "k1": "one"}.get(k)) for k in count}


def test_no_task_holds_much_more_than_its_share(spark):
    rows, df = skewed(spark)
    plan = fr.plan_fragments(df, ["k"], tasks=8)
    sizes = fr.fragment(df, plan).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in sizes) == len(rows)
    assert max(r["count"] for r in sizes) < 1.5 * len(rows) / 8


def test_large_keys_alone_are_replicated(spark):
    _, df = skewed(spark)
    plan = fr.plan_fragments(df, ["k"], tasks=8)
    right = df.select("k").distinct()
    counts = {r["k"]: r["count"] for r in fr.replicate(right, plan).groupBy("k").count().collect()}
    assert counts["hot"] > 8 and counts["k1"] == 1


def test_joins_match_spark_joins(spark):
    _, df = skewed(spark)
    right = spark.createDataFrame([("hot", "H"), ("k1", "a"), ("k1", "b"), (None, "n")], "k string, label string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = Counter(map(tuple, df.join(right, "k", how).collect()))
        assert Counter(map(tuple, fr.balanced_join(df, right, ["k"], how).collect())) == want


def test_empty_sides(spark):
    empty = spark.createDataFrame([], "k string, v long")
    right = spark.createDataFrame([], "k string, label string")
    assert fr.balanced_join(empty, right, ["k"], "left").count() == 0
    assert fr.balanced_aggregate(empty, ["k"], {"n": F.count(F.lit(1))}, {"n": F.sum("n")}).count() == 0


def test_packing_takes_largest_first():
    where = fr.pack([(10, "a"), (9, "b"), (2, "c"), (1, "d")], 2)
    assert where["a"] != where["b"] and where["c"] == where["b"]


def test_spread_join_matches_spark_joins(spark):
    _, df = skewed(spark)
    right = spark.createDataFrame([("hot", "H"), ("k1", "a"), ("k1", "b"), (None, "n")], "k string, label string")
    for rows in (df, df.where("k <> 'hot'").distinct(), df.limit(0)):
        for how in ("inner", "left"):
            want = Counter(map(tuple, rows.join(right, "k", how).collect()))
            assert Counter(map(tuple, fr.spread_join(rows, right, "k", how).collect())) == want
