import math
import random

import pytest
from pyspark.sql import functions as F

from cladeflow.llm.topn import HELD_ROWS, _local_bounds, top_n

ORDER = [("score", True), ("len", True), ("id", False)]
SCHEMA = "g string, score double, len long, id long, rank string"


def brute(rows, n):
    best = {}
    for g, score, length, i, _ in rows:
        if score is not None and not math.isnan(score) and length is not None and i is not None:
            best.setdefault(g, []).append((-score, -length, i))
    return {(g, i) for g, v in best.items() for *_, i in sorted(v)[:n]}


@pytest.mark.parametrize("batch", ["50", "10000"])
def test_against_sorting(spark, batch):
    r = random.Random(5)
    rows = [("hot", r.choice([0.5, 0.9, 1.0]), r.randrange(4), i, "x") for i in range(3000)]
    rows += [(f"g{r.randrange(300)}", r.choice([None, float("nan"), 0.1, 0.7, 1.0]), r.choice([None, 1, 2]), i, "x") for i in range(3000, 5000)]
    rows += [(None, 0.5, 1, 6000 + i, "x") for i in range(7)] + [("", 0.5, 1, 7000, "x"), ("few", -1.0, 0, 7001, "x"), ("nan", float("nan"), 1, 7002, "x")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for n in (1, 3):
            out = top_n(spark.createDataFrame(rows, SCHEMA), "g", ORDER, n).collect()
            got = [(x["g"], x["id"]) for x in out]
            assert len(got) == len(set(got)) and set(got) == brute(rows, n)
            assert {x["rank"] for x in out} <= set(range(1, n + 1))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 1, 1, "")] * 5, SCHEMA)
    assert top_n(df, "g", ORDER, 3).count() == 3
    assert top_n(df.limit(0), "g", ORDER, 3).count() == 0
    with pytest.raises(ValueError):
        top_n(df, "g", ORDER, 0)


def test_a_partition_keeps_no_more_than_n_rows_a_group(spark):
    """5,000 groups of 400 rows spread over all batches of two partitions: nowhere N rows of a group in one batch."""
    rows = spark.range(2_000_000, numPartitions=2).selectExpr("cast(id % 5000 as string) AS g", "cast(hash(id) as double) AS score", "id % 7 AS len", "id")
    local = rows.mapInArrow(_local_bounds("g", ORDER, 3, HELD_ROWS), "g string, score double, len long, id long, _bound boolean")
    by = local.groupBy(F.spark_partition_id().alias("p"), "g").agg(F.count(F.lit(1)).alias("n"), F.count_if("_bound").alias("b"))
    assert by.agg(F.count(F.lit(1)), F.max("n"), F.min("b"), F.max("b")).first() == (10_000, 3, 1, 1)


@pytest.mark.parametrize("held", [1, 500])
def test_what_a_partition_hands_on_early_changes_nothing(spark, held):
    r = random.Random(2)
    rows = [(f"g{r.randrange(4000)}", float(r.randrange(50)), r.randrange(3), i, "x") for i in range(150_000)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert {(x["g"], x["id"]) for x in top_n(df, "g", ORDER, 3, held_rows=held).collect()} == brute(rows, 3)
