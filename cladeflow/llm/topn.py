"""The N best items of every group, by partition lower bounds (problem 4).

1. Every partition keeps, over all of its Arrow batches, the N best items of each of its groups. The N-th best of a group there
   is a lower bound: the group's N-th best item is at least that good. What is beneath it is dropped, so a group of
   millions leaves N rows a partition. What is kept is cut down again whenever as many new rows have come in, and handed
   on once it exceeds ``HELD_ROWS``, so memory is bounded however many groups there are. The result is checkpointed, as
   both next steps read it.
2. The highest bound of each group is joined to the rows that are left, and those beneath it are dropped.
3. The survivors are ranked.

The order is total: score descending, further keys in their directions, the last of which must be
unique within a group up to repeated rows. Bounds compare in the full order, so ties don't let a
group through.

Defined results: rows with a null or NaN score, or a null in an order key, have no rank and don't come out;
null groups form one group; fewer than N rows: all come out; rows equal in all keys are
ranked in arbitrary order, each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.session import cut_lineage

#: Rows that a partition waits for at least before it cuts down what it holds, and rows from which it hands that on.
LEAST_ROWS, HELD_ROWS = 1 << 16, 1 << 19


def _cut(rows: pa.Table, group: str, keys: list[tuple[str, bool]], n: int) -> tuple[pa.Table, np.ndarray]:
    """(the n best rows of each group, which of them are the n-th)."""
    rows = rows.combine_chunks()
    column = lambda name: rows.column(name).combine_chunks() if isinstance(rows.column(name), pa.ChunkedArray) else rows.column(name)
    code = column(group).dictionary_encode(null_encoding="encode")
    code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sort = []
    for name, down in reversed(keys):
        v = column(name).to_numpy(zero_copy_only=False)
        sort.append(-v if down else v)
    order = np.lexsort((*sort, code))
    sorted_code = code[order]
    new = np.ones(len(code), bool)
    new[1:] = sorted_code[1:] != sorted_code[:-1]
    start = np.flatnonzero(new)
    rank = np.arange(len(code)) - np.repeat(start, np.diff(np.append(start, len(code)))) + 1
    kept = rank <= n
    return rows.take(pa.array(order[kept])), rank[kept] == n


def _local_bounds(group: str, keys: list[tuple[str, bool]], n: int, held_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        fresh: list[pa.RecordBatch] = []
        waiting = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            table, bound = _cut(pa.Table.from_batches([*(best.to_batches() if best is not None else []), *fresh]), group, keys, n)
            yield from table.append_column("_bound", pa.array(bound)).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)  # without the input's not-null marks
            fresh.append(batch)
            waiting += batch.num_rows
            if waiting >= max(LEAST_ROWS, best.num_rows if best is not None else 0):
                best, _ = _cut(pa.Table.from_batches([*(best.to_batches() if best is not None else []), *fresh]), group, keys, n)
                fresh, waiting = [], 0
                if best.num_rows > held_rows:
                    yield from hand_on()
                    best = None
        if waiting or best is not None:
            yield from hand_on()

    return run


def top_n(rows: DataFrame, group: str, order: list[tuple[str, bool]], n: int, held_rows: int = HELD_ROWS) -> DataFrame:
    """``rows`` (its group, order keys and whatever else) reduced to the ``n`` first of each group, with ``rank``.
    ``order``: (numeric column, descending?) from the most to the least significant."""
    if n < 1:
        raise ValueError("n must be at least 1")
    names = [c for c, _ in order]
    ranked = rows.drop("rank", "_bound")
    for c in names:
        ranked = ranked.where(F.col(c).isNotNull())
        if isinstance(rows.schema[c].dataType, (T.DoubleType, T.FloatType)):
            ranked = ranked.where(~F.isnan(c))
    schema = T.StructType([*ranked.schema.fields, T.StructField("_bound", T.BooleanType())])
    local = cut_lineage(ranked.mapInArrow(_local_bounds(group, order, n, held_rows), schema))
    place = F.struct(*[F.negative(F.col(c)).alias(c) if down else F.col(c) for c, down in order])
    bounds = local.where("_bound").groupBy(F.col(group).alias("_g")).agg(F.min(place).alias("_lowest"))
    joined = local.join(bounds, F.col(group).eqNullSafe(F.col("_g")), "left")
    alive = joined.where(F.col("_lowest").isNull() | (place <= F.col("_lowest"))).drop("_g", "_lowest", "_bound")
    by = Window.partitionBy(group).orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c, down in order])
    return alive.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
