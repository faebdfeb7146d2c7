"""Filling containers of fixed capacity (problem 8).

1. Items longer than the capacity are split into full pieces and a rest; nothing else is split.
2. The *global histogram* of lengths (at most ``capacity`` bins, whatever the number of items) goes to the driver.
   *Dynamic programming* over it chooses ``BUCKETS`` boundaries such that rounding every item up to its bucket's
   boundary pads as little as possible. No bucket spans a half, third, .. eighth of the capacity.
3. *Token-budget batches*: what containers hold is planned by bucket, not by item. Buckets are taken from the
   longest boundary down; items of a bucket fill the containers with the least room that still fits
   (best fit), then new ones. A plan is a list of ranges: items number a .. b of a bucket go to
   containers from c on, t in each.
4. Items are numbered within their bucket (salted windows and offsets per salt, so a bucket holding most items
   is spread) and find their container in the plan.

Batches that never leave their bucket waste the rest that a boundary leaves of the capacity (nearly half
of a container for items just over half of it); ``within_bucket_containers`` gives that figure for
comparison. Planning over buckets keeps the method's cost and its distribution, and packs tighter.

Defined results: items of null or no length go to no container (null). Equal items differ by their id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.session import cut_lineage

CAPACITY = 2048
BUCKETS = 128
#: A length that fits so often into the capacity is never rounded up beyond it.
EVEN_PARTS = range(2, 9)
ITEMS_PER_SALT = 50_000


def _layer(best: np.ndarray, cost, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(least of best[i] + cost(i, j) over i < j, the i that gives it) for j = first .. last, all of which can be reached. The best
    i never falls as j grows, so the middle j of a stretch bounds the i of both halves: all stretches of a level are done at
    once, in about n steps a level."""
    least, choice = np.full(len(best), np.inf), np.zeros(len(best), np.int64)
    left, right, low, high = (np.array([x]) for x in (first, last, first - 1, last - 1))
    while len(left):
        mid = (left + right) // 2
        size = np.minimum(high, mid - 1) - low + 1
        at = np.cumsum(size) - size
        i = np.repeat(low, size) + np.arange(int(size.sum())) - np.repeat(at, size)
        value = best[i] + cost(i, np.repeat(mid, size))
        smallest = np.minimum.reduceat(value, at)
        hit = np.flatnonzero(value == np.repeat(smallest, size))
        taken = i[hit[np.searchsorted(hit, at)]]
        least[mid], choice[mid] = smallest, taken
        left, right, low, high = np.concatenate((left, mid + 1)), np.concatenate((mid - 1, right)), np.concatenate((low, taken)), np.concatenate((taken, high))
        some = left <= right
        left, right, low, high = left[some], right[some], low[some], high[some]
    return least, choice


def choose_boundaries(counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, ascending, the last one being the longest length. ``counts[l]``: items of length l. With more buckets than
    twice the even parts, bounds stand at each of them that a length lies beyond."""
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return []
    n, amount = len(used), counts[used].astype(float)
    items, size = np.concatenate(([0.0], np.cumsum(amount))), np.concatenate(([0.0], np.cumsum(amount * used)))
    walls = np.array(sorted({int(np.searchsorted(used, (len(counts) - 1) // k, side="right")) for k in EVEN_PARTS}) if buckets > 2 * len(EVEN_PARTS) else [], np.int64)

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Padding of lengths i .. j-1 in one bucket."""
        padded = used[j - 1] * (items[j] - items[i]) - (size[j] - size[i])
        return np.where(np.searchsorted(walls, i, side="right") < np.searchsorted(walls, j, side="left"), np.inf, padded)

    best = np.concatenate(([0.0], np.full(n, np.inf)))
    choices = []
    inner = walls[(walls > 0) & (walls < n)]
    for k in range(1, min(buckets, n) + 1):
        best, choice = _layer(best, cost, k, int(inner[k - 1]) if k <= len(inner) else n)
        choices.append(choice)
    bounds, at = [], n
    for choice in reversed(choices):
        bounds.append(int(used[at - 1]))
        at = int(choice[at])
        if at == 0:
            break
    return bounds[::-1]


@dataclass(frozen=True)
class Range:
    bucket: int
    first: int
    stop: int
    container: int
    each: int


def plan_containers(bounds: list[int], amounts: list[int], capacity: int = CAPACITY) -> tuple[list[Range], int]:
    """Best fit by bucket, longest first. Containers with equal contents are one group: a range of numbers."""
    groups: list[list[int]] = []  # room, first container, how many
    plan: list[Range] = []
    containers = 0
    for bucket in sorted(range(len(bounds)), key=lambda k: -bounds[k]):
        size, left, done = bounds[bucket], amounts[bucket], 0
        while left:
            fitting = [g for g in groups if g[0] >= size]
            if fitting:
                group = min(fitting)
                groups.remove(group)
            else:
                group = [capacity, containers, -(-left // (capacity // size))]
                containers += group[2]
            room, first, many = group
            each = min(room // size, left)
            take = min(many, left // each)
            plan.append(Range(bucket, done, done + take * each, first, each))
            groups.append([room - each * size, first, take])
            if many > take:
                groups.append([room, first + take, many - take])
            done, left = done + take * each, left - take * each
    return plan, containers


def within_bucket_containers(bounds: list[int], amounts: list[int], capacity: int = CAPACITY) -> int:
    return sum(-(-n // (capacity // b)) for b, n in zip(bounds, amounts))


def to_items(sizes: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(item, piece, start, length): the pieces of items with units."""
    n = F.col(size)
    cut = sizes.where(n > 0).select(item, n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / capacity))).alias("piece"))
    return cut.select(item, "piece", (F.col("piece") * capacity).alias("start"), F.least(F.col("_n") - F.col("piece") * capacity, F.lit(capacity)).alias("length"))


def length_histogram(items: DataFrame, capacity: int) -> np.ndarray:
    counts = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    return counts


def bucket_amounts(counts: np.ndarray, bounds: list[int]) -> list[int]:
    total = np.cumsum(counts)
    return [int(total[b] - (total[bounds[k - 1]] if k else 0)) for k, b in enumerate(bounds)]


def pack(sizes: DataFrame, item: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """(item, piece, start, length, bucket_bound, container): every piece of every item with its container.
    ``sizes`` is read three times; give it checkpointed if it is costly. Items without units have null."""
    spark = sizes.sparkSession
    items = to_items(sizes, item, size, capacity)
    counts = length_histogram(items, capacity)
    bounds = choose_boundaries(counts, buckets)
    amounts = bucket_amounts(counts, bounds)
    plan, _ = plan_containers(bounds, amounts, capacity)
    salts = max(1, -(-int(counts.sum()) // ITEMS_PER_SALT))
    of_length = spark.createDataFrame([(int(x), int(np.searchsorted(bounds, x))) for x in np.flatnonzero(counts)], "length long, bucket int")
    salt = F.pmod(F.xxhash64(item, "piece"), F.lit(salts)).cast("int").alias("_salt")
    placed = items.join(F.broadcast(of_length), "length").select(item, "piece", "start", "length", "bucket", salt)
    by_salt = placed.groupBy("bucket", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("bucket").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_salt.select("bucket", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_k", F.row_number().over(Window.partitionBy("bucket", "_salt").orderBy(F.col("length").desc(), item, "piece")) - 1)
    ranked = ranked.join(offsets, ["bucket", "_salt"]).withColumn("_rank", F.col("_k") + F.col("_before"))
    ranges = spark.createDataFrame([(r.bucket, r.first, r.stop, r.container, r.each, bounds[r.bucket]) for r in plan], "bucket int, _first long, _stop long, _container long, _each long, bucket_bound int")
    there = ranked.join(F.broadcast(ranges), "bucket").where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_stop")))
    container = (F.col("_container") + F.floor((F.col("_rank") - F.col("_first")) / F.col("_each"))).alias("container")
    full = there.select(item, "piece", "start", "length", "bucket_bound", container)
    empty = sizes.where(F.col(size).isNull() | (F.col(size) <= 0)).select(item, F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("int").alias("bucket_bound"), F.lit(None).cast("long").alias("container"))
    return full.unionByName(empty)


def report(sizes: DataFrame, item: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """One row: what the packing uses and leaves, and what batches within buckets would need."""
    packed = pack(sizes, item, size, capacity, buckets).where(F.col("container").isNotNull())
    by = packed.groupBy("container").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("n"))
    counts = length_histogram(to_items(sizes, item, size, capacity), capacity)
    bounds = choose_boundaries(counts, buckets)
    inside = within_bucket_containers(bounds, bucket_amounts(counts, bounds), capacity)
    return by.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.max("used").alias("fullest"),
        F.round(1 - F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("unused_share"),
        F.lit(inside).cast("long").alias("containers_within_buckets"),
    )
