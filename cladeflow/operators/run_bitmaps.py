"""Merging overlapping intervals and listing gaps, by run bitmaps per entity and shard (problem 1).

The axis of an entity is cut into shards of ``SHARD`` units. An interval becomes a run of set bits in
each shard that it touches; a shard of an entity is a *run container*: the sorted, disjoint runs of
set bits, two unsigned 16-bit numbers (first, last) a run, or the plain bit array of ``SHARD / 8``
bytes once that is smaller. So a container never exceeds 8 KB, however many rows went into it.

1. map side: every Arrow batch unites its own rows into containers (a hot entity shrinks here, before
   any shuffle);
2. one shuffle by (entity, shard): containers are united in a stream over the sorted partition, the
   open shard is carried from batch to batch, so memory is bounded by a batch;
3. set runs and clear runs within a shard come out of its own container; what crosses shards is
   stitched over the shards' first and last set unit only, never over the runs of an entity.

Results, defined:
* a row covers [s, e) clipped to [1, length + 1); null bounds, s >= e and intervals wholly outside
  cover nothing, but their entity is still reported (one gap over its whole length);
* touching intervals join into one period; rows with null length are taken out; length < 1: no rows;
* null entity columns form an entity of their own; repeated rows change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_BITS = 16
SHARD = 1 << SHARD_BITS
#: Runs from which the bit array (SHARD / 8 bytes) is smaller than 4 bytes a run.
MAX_RUNS = SHARD // 32


def encode_container(first: np.ndarray, stop: np.ndarray) -> bytes:
    """Sorted, disjoint, non-touching runs [first, stop) within a shard to a container."""
    if len(first) == 0:
        return b""
    if len(first) <= MAX_RUNS:
        return b"R" + np.stack([first, stop - 1], axis=1).astype("<u2").tobytes()
    edge = np.zeros(SHARD + 1, np.int8)
    edge[first] = 1
    edge[stop] = -1
    return b"B" + np.packbits(np.cumsum(edge[:-1]).astype(bool)).tobytes()


def decode_container(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if data[:1] == b"R":
        runs = np.frombuffer(data, "<u2", offset=1).reshape(-1, 2).astype(np.int64)
        return runs[:, 0], runs[:, 1] + 1
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=1)).astype(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], bits, [0]))))
    return edge[0::2].astype(np.int64), edge[1::2].astype(np.int64)


def encode_all(first: np.ndarray, stop: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A container of each stretch at[i] .. at[i + 1] of the runs."""
    pairs = np.stack([first, stop - 1], axis=1).astype("<u2").tobytes()
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        out.append(b"" if i == j else b"R" + pairs[4 * i : 4 * j] if j - i <= MAX_RUNS else encode_container(first[i:j], stop[i:j]))
    return out


def decode_all(containers: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of runs of each container, first, stop) of them all, in order."""
    if any(x[:1] == b"B" for x in containers):
        parts = [decode_container(x) for x in containers]
        return np.array([len(a) for a, _ in parts], np.int64), np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    counts = np.array([len(x) // 4 for x in containers], np.int64)
    runs = np.frombuffer(b"".join(x[1:] for x in containers), "<u2").reshape(-1, 2).astype(np.int64)
    return counts, runs[:, 0], runs[:, 1] + 1


def unite_runs(group: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of runs within each group (0 .. n-1): sorted, disjoint, touching runs joined."""
    keep = stop > first
    group, first, stop = group[keep], first[keep], stop[keep]
    if len(first) == 0:
        return group, first, stop
    order = np.lexsort((first, group))
    group, first, stop = group[order], first[order], stop[order]
    base = group * (SHARD + 2)  # groups don't touch each other on this axis
    reach = np.maximum.accumulate(base + stop)
    new = np.ones(len(first), bool)
    new[1:] = base[1:] + first[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(first)) - 1
    return group[heads], first[heads], reach[ends] - base[heads]


def _group_ids(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Dense group number of each row and the row at which each group is first seen; nulls are values."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        enc = c.dictionary_encode(null_encoding="encode")
        code = code * max(1, len(enc.dictionary)) + enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(code, return_inverse=True)
    _, seen, ids = np.unique(code, return_index=True, return_inverse=True)
    return ids.astype(np.int64), seen


def _batch(table: pa.Table, names: list[str], ids: np.ndarray, seen: np.ndarray, first: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """One row per group: its key columns and the container of its united runs."""
    g, a, b = unite_runs(ids, first, stop)
    at = np.searchsorted(g, np.arange(len(seen) + 1))
    runs = encode_all(a, b, at)
    keys = table.select(names).take(pa.array(seen)).combine_chunks()
    columns = [keys.column(n).combine_chunks() if isinstance(keys.column(n), pa.ChunkedArray) else keys.column(n) for n in names]
    return pa.RecordBatch.from_arrays([*columns, pa.array(runs, pa.binary())], [*names, "runs"])


def _to_containers(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                ids, seen = _group_ids([t.column(n).combine_chunks() for n in names])
                lo, hi = (t.column(n).to_numpy() for n in ("_lo", "_hi"))
                yield _batch(t, names, ids, seen, lo, hi)

    return run


def _unite_containers(names: list[str]):
    """Rows come sorted by their keys; the last group of a batch waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)  # without the input's not-null marks
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            ids, seen = _group_ids([t.column(n).combine_chunks() for n in names])
            counts, first, stop = decode_all(t.column("runs").to_pylist())
            out = _batch(t, names, np.repeat(ids, counts), seen, first, stop)
            last = int(ids[-1])  # groups are numbered as they stand in the batch's rows of `out`
            held = out.slice(last, 1)
            rest = [i for i in range(out.num_rows) if i != last]
            if rest:
                yield out.take(pa.array(rest))
        if held is not None:
            yield held

    return run


def _pairs(counts: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["s", "e"]))


def _extract(names: list[str]):
    """Per shard: first and last set unit (1-based, half-open), its set runs and the clear runs between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            counts, a, b = decode_all(column("runs").to_pylist())
            base = np.repeat((column("shard").to_numpy(zero_copy_only=False).astype(np.int64) << SHARD_BITS) + 1, counts)
            a, b = a + base, b + base
            ends = np.cumsum(counts)
            some = counts > 0
            edge = lambda v, i: pa.array(np.where(some, v[np.where(some, i, 0)], 0) if len(v) else np.zeros(len(counts), np.int64), mask=~some)
            inner = np.ones(len(a), bool)
            inner[ends[some] - 1] = False  # the last run of a shard has no clear run after it
            after = np.flatnonzero(inner)
            clear = _pairs(np.maximum(counts - 1, 0), b[after], a[after + 1])
            yield pa.RecordBatch.from_arrays([*[column(n) for n in names], edge(a, ends - counts), edge(b, ends - 1), _pairs(counts, a, b), clear], [*names, "first", "last", "set_runs", "clear_runs"])

    return run


def shard_containers(rows: DataFrame, entity: list[str], start: str, end: str, length: str) -> DataFrame:
    """(entity..., length, shard, runs): the united run container of each shard that holds a set unit,
    and an empty one in shard 0 for entities without any."""
    names = [*entity, "length", "shard"]
    lo, hi = F.greatest(F.col(start), F.lit(1)), F.least(F.col(end), F.col(length) + 1)
    good = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) < F.col(end)) & (lo < hi)
    clipped = rows.where(F.col(length) >= 1).select(
        *entity, F.col(length).cast("long").alias("length"), F.when(good, lo - 1).otherwise(F.lit(0)).cast("long").alias("_a"), F.when(good, hi - 1).otherwise(F.lit(0)).cast("long").alias("_b")
    )
    first, last = F.shiftright("_a", SHARD_BITS), F.shiftright(F.greatest(F.col("_b") - 1, F.col("_a")), SHARD_BITS)
    cut = clipped.withColumn("shard", F.explode(F.sequence(first, last)))
    base = F.shiftleft("shard", SHARD_BITS)
    cut = cut.select(*names, F.greatest(F.col("_a") - base, F.lit(0)).alias("_lo"), F.least(F.col("_b") - base, F.lit(SHARD)).alias("_hi"))
    schema = T.StructType([*(f for f in cut.schema.fields if f.name in names), T.StructField("runs", T.BinaryType())])
    partial = cut.mapInArrow(_to_containers(names), schema)
    together = partial.repartition(*entity, "shard").sortWithinPartitions(*entity, "length", "shard")
    return together.mapInArrow(_unite_containers(names), schema)


def shard_runs(rows: DataFrame, entity: list[str], start: str, end: str, length: str) -> DataFrame:
    containers = shard_containers(rows, entity, start, end, length)
    names = [*entity, "length", "shard"]
    pair = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))
    schema = T.StructType([*(f for f in containers.schema.fields if f.name in names), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("set_runs", pair), T.StructField("clear_runs", pair)])
    return containers.mapInArrow(_extract(names), schema)


def gaps(rows: DataFrame, entity: list[str], start: str = "s", end: str = "e", length: str = "length") -> DataFrame:
    """(entity..., gap_start, gap_end): every maximal stretch of [1, length + 1) that no row covers."""
    shards = shard_runs(rows, entity, start, end, length)
    inner = shards.select(*entity, F.explode("clear_runs").alias("_g")).select(*entity, F.col("_g.s").alias("gap_start"), F.col("_g.e").alias("gap_end"))
    # one narrow row a shard goes through the window; the clear runs between a shard's set runs never do
    edges = shards.select(*entity, "length", "shard", "first", "last")
    by = Window.partitionBy(*entity).orderBy("shard")
    before = F.coalesce(F.last("last", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1).cast("long"))
    edges = edges.select(*entity, "length", "first", "last", before.alias("_before"), F.lead("shard").over(by).isNull().alias("_is_last"))
    pair = lambda ok, s, e: F.when(ok, F.struct(s.cast("long").alias("s"), e.cast("long").alias("e")))
    lead = pair(F.col("first") > F.col("_before"), F.col("_before"), F.col("first"))
    tail_from = F.coalesce(F.col("last"), F.col("_before"))
    tail = pair(F.col("_is_last") & (tail_from < F.col("length") + 1), tail_from, F.col("length") + 1)
    outer = edges.select(*entity, F.explode(F.filter(F.array(lead, tail), lambda g: g.isNotNull())).alias("_g"))
    return inner.unionByName(outer.select(*entity, F.col("_g.s").alias("gap_start"), F.col("_g.e").alias("gap_end")))


def periods(rows: DataFrame, entity: list[str], start: str = "s", end: str = "e", length: str = "length") -> DataFrame:
    """(entity..., period_start, period_end): the maximal covered stretches. Only the first and the last
    run of a shard can continue in another shard; those alone go through the ordered window."""
    shards = shard_runs(rows, entity, start, end, length)
    runs = shards.select(*entity, F.posexplode("set_runs").alias("_i", "_r"), F.size("set_runs").alias("_n"), "shard").select(*entity, F.col("_r.s").alias("s"), F.col("_r.e").alias("e"), "shard")
    base = F.shiftleft("shard", SHARD_BITS) + 1
    at_edge = (F.col("s") == base) | (F.col("e") == base + SHARD)
    inner = runs.where(~at_edge).select(*entity, F.col("s").alias("period_start"), F.col("e").alias("period_end"))
    by = Window.partitionBy(*entity).orderBy("s")
    edge = runs.where(at_edge).withColumn("_new", F.coalesce((F.lag("e").over(by) != F.col("s")).cast("int"), F.lit(1)))
    edge = edge.withColumn("_island", F.sum("_new").over(by))
    joined = edge.groupBy(*entity, "_island").agg(F.min("s").alias("period_start"), F.max("e").alias("period_end")).drop("_island")
    return inner.unionByName(joined)
