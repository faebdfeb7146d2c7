"""Per-key work and joins without hot tasks, by fragment and replicate (problem 2).

1. *Estimated load*: rows per hash bucket of the keys, ``BUCKETS_PER_TASK`` buckets a task, counted over all rows; only
   the keys of buckets that could hold a large one are counted one by one. So the estimate shuffles a few numbers,
   not every key.
2. *Plan*, on the driver, of bounded size: keys above a fraction of a task's fair share are *large*
   (at most ``tasks / HEAVY_SHARE`` of them can exist) and are split into shards in proportion to
   their load; all others stay in their bucket. Shards and buckets are packed into tasks, largest first into the
   least loaded task.
3. *Fragment*: a row goes to the task of its key's bucket, or of the shard that its salt picks,
   by direct partition number, so no hash collision undoes the packing. Results per key don't move rows: each input
   partition combines its rows of a (shard, key) first, and only those values are sent.
4. *Replicate*: a row of the matching side goes to the bucket's task, or to each shard of its key -
   and nowhere else. The join of both sides then needs no further shuffle.

Null keys: they match nothing in a join but keep their rows and are spread like any key.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is large from this fraction of a task's fair share of the rows.
HEAVY_SHARE = 0.25
#: Light keys share so many hash buckets a task.
BUCKETS_PER_TASK = 64


@dataclass(frozen=True)
class FragmentPlan:
    keys: tuple[str, ...]
    tasks: int
    buckets: int
    #: (key..., shards, task of each shard); at most tasks / HEAVY_SHARE rows.
    heavy: DataFrame
    #: (bucket, task); BUCKETS_PER_TASK * tasks rows.
    light: DataFrame
    total: int


def _bucket(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def pack(sizes: list[tuple[int, object]], tasks: int) -> dict[object, int]:
    """Largest first into the least loaded task."""
    heap = [(0, t) for t in range(tasks)]
    heapq.heapify(heap)
    where: dict[object, int] = {}
    for size, item in sorted(sizes, key=lambda x: (-x[0], str(x[1]))):
        load, task = heapq.heappop(heap)
        where[item] = task
        heapq.heappush(heap, (load + size, task))
    return where


def large_keys(df: DataFrame, keys: list[str], tasks: int, buckets: int) -> tuple[list, dict[int, int]]:
    """(rows (key..., _load, _bucket) of the keys above HEAVY_SHARE of a task's fair share, rows of each bucket)."""
    bucket = _bucket(tuple(keys), buckets)
    load = {r["_b"]: r["n"] for r in df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `buckets` rows
    least = max(1.0, sum(load.values()) / tasks) * HEAVY_SHARE
    suspect = [b for b, n in load.items() if n > least]
    if not suspect:
        return [], load
    counted = df.where(bucket.isin(suspect)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_load"))
    return counted.where(F.col("_load") > F.lit(least)).withColumn("_bucket", bucket).collect(), load  # at most tasks / HEAVY_SHARE rows


def plan_fragments(df: DataFrame, keys: list[str], tasks: int | None = None) -> FragmentPlan:
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = tasks * BUCKETS_PER_TASK
    names = tuple(keys)
    large, load = large_keys(df, keys, tasks, buckets)
    total = sum(load.values())
    share = max(1.0, total / tasks)
    for r in large:
        load[r["_bucket"]] -= r["_load"]
    piece = share * HEAVY_SHARE
    items: list[tuple[int, object]] = [(n, ("light", b)) for b, n in load.items()]
    shards = [max(1, round(r["_load"] / piece)) for r in large]
    items += [(large[i]["_load"] // n, ("heavy", i, j)) for i, n in enumerate(shards) for j in range(n)]
    where = pack(items, tasks)
    schema = df.select(*keys).schema
    for name, kind in (("_shards", T.IntegerType()), ("_tasks", T.ArrayType(T.IntegerType()))):
        schema = schema.add(name, kind)
    heavy = spark.createDataFrame([(*[r[k] for k in keys], n, [where[("heavy", i, j)] for j in range(n)]) for i, (r, n) in enumerate(zip(large, shards))], schema)
    light = spark.createDataFrame([(b, where.get(("light", b), b % tasks)) for b in range(buckets)], "_bucket int, _task int")
    return FragmentPlan(names, tasks, buckets, heavy, light, total)


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def assign(df: DataFrame, plan: FragmentPlan, salt: Column | None = None) -> DataFrame:
    """``df`` with ``_shard`` and ``_task``. ``salt`` (an integer column) picks the shard of a large key; by default the row's
    number in its input partition. That is the same when a lost task runs again only for inputs read from files or
    checkpoints: give a salt made of the row for others."""
    salted = df.withColumn("_salt", (F.monotonically_increasing_id() if salt is None else salt).cast("long"))
    heavy = plan.heavy
    rows = salted.join(F.broadcast(heavy), _same(salted, heavy, plan.keys), "left").drop(*[heavy[k] for k in plan.keys])
    rows = rows.withColumn("_shard", F.coalesce(F.pmod(F.col("_salt"), F.col("_shards")).cast("int"), F.lit(0)))
    rows = rows.withColumn("_bucket", _bucket(plan.keys, plan.buckets))
    rows = rows.join(F.broadcast(plan.light.withColumnRenamed("_task", "_light_task")), "_bucket", "left")
    rows = rows.withColumn("_task", F.coalesce(F.get("_tasks", F.col("_shard")), F.col("_light_task")))
    return rows.drop("_salt", "_bucket", "_light_task", "_shards", "_tasks")


def fragment(df: DataFrame, plan: FragmentPlan, salt: Column | None = None) -> DataFrame:
    """``df`` with ``_shard`` and ``_task`` (see ``assign``), each row in its task's partition."""
    return assign(df, plan, salt).repartitionById(plan.tasks, F.col("_task"))


def replicate(df: DataFrame, plan: FragmentPlan) -> DataFrame:
    """``df`` (the matching side) with each row once for every shard of its key, in that shard's partition."""
    heavy = plan.heavy
    rows = df.join(F.broadcast(heavy), _same(df, heavy, plan.keys), "left").drop(*[heavy[k] for k in plan.keys])
    rows = rows.withColumn("_bucket", _bucket(plan.keys, plan.buckets))
    rows = rows.join(F.broadcast(plan.light.withColumnRenamed("_task", "_light_task")), "_bucket", "left")
    rows = rows.withColumn("_tasks", F.coalesce(F.col("_tasks"), F.array("_light_task")))
    columns = [c for c in df.columns]
    rows = rows.select(*columns, F.posexplode("_tasks").alias("_shard", "_task"))
    return rows.repartitionById(plan.tasks, F.col("_task"))


def balanced_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salt: Column | None = None, plan: FragmentPlan | None = None) -> DataFrame:
    """Equi-join of a skewed ``left`` with ``right`` (which must be the smaller side per key), ``how``
    being inner, left, left_semi or left_anti. Other columns of the two sides must differ in name."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how}: the replicated side can't be preserved")
    plan = plan or plan_fragments(left, keys)
    a, b = fragment(left, plan, salt), replicate(right, plan)
    return a.join(b, ["_task", "_shard", *keys], how).drop("_task", "_shard")


def key_loads(df: DataFrame, key: str) -> tuple[list, dict[int, int]]:
    """``large_keys`` of one column for as many tasks as run at once; the loads add up to the rows of ``df``."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return large_keys(df, [key], tasks, tasks * BUCKETS_PER_TASK)


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salt: Column | None = None, loads: tuple[list, dict[int, int]] | None = None) -> DataFrame:
    """Like ``balanced_join`` on one column, for the steps of an iteration: large keys are split and replicated alike, all
    else is left to a plain join, whose partitions adaptive execution fits to the size. ``loads``: ``key_loads`` of ``left``, if known."""
    tasks = left.sparkSession.sparkContext.defaultParallelism
    large, load = key_loads(left, key) if loads is None else loads
    if not large:
        return left.join(right, key, how)
    piece = max(1.0, sum(load.values()) / tasks) * HEAVY_SHARE
    shards = F.lit(1)
    for r in large:  # at most tasks / HEAVY_SHARE
        shards = F.when(F.col(key) == r[key], max(1, round(r["_load"] / piece))).otherwise(shards)
    a = left.withColumn("_shard", F.pmod((F.monotonically_increasing_id() if salt is None else salt).cast("long"), shards.cast("long")))
    b = right.withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), shards.cast("long") - 1)))
    return a.join(b, [key, "_shard"], how).drop("_shard")


def balanced_aggregate(df: DataFrame, keys: list[str], partial: dict[str, Column], final: dict[str, Column], right: DataFrame | None = None, salt: Column | None = None, plan: FragmentPlan | None = None) -> DataFrame:
    """Per-key results. ``partial`` is computed for every shard, combined in each input partition before anything is
    sent; ``final`` merges the shards' values (columns named as in ``partial``), a few rows a key. ``right`` is left-joined to
    the shards' values by replication; its columns come out as the key's (one row a key)."""
    plan = plan or plan_fragments(df, keys)
    pieces = assign(df, plan, salt).groupBy("_task", "_shard", *keys).agg(*[v.alias(k) for k, v in partial.items()])
    extra: list[Column] = []
    if right is not None:
        pieces = pieces.repartitionById(plan.tasks, F.col("_task")).join(replicate(right, plan), ["_task", "_shard", *keys], "left")
        extra = [F.first(c, ignorenulls=True).alias(c) for c in right.columns if c not in keys]
    return pieces.groupBy(*keys).agg(*[v.alias(k) for k, v in final.items()], *extra)
