"""Splitting long items at natural boundaries (problem 6).

An item (a contig) longer than ``limit`` is cut into pieces of at most ``limit``; consecutive pieces of an
item share ``overlap`` units. From the start of a piece its cut is chosen within the window of the last
``1 - MIN_FILL`` of the permitted length:

* a run of N is a natural boundary: the cut falls in the middle of the longest run in the window, else within a
  run that reaches into it;
* else a run before the window is taken, the last one that no cut has used and that leaves more than the overlap;
* only without any of these the *lexical cohesion* decides. Words are K-mers; blocks of ``BLOCK`` words slide in steps of ``STEP`` over
  the item, and the similarity of the blocks left and right of each step is the cosine of their word
  counts. A valley is deep where the similarity on both sides rises far above it; the deepest valley in
  the window is the cut.

Small items of a group (contigs of a genome) are put together, in order, into pieces of at most
``limit``, which end at the ends of items. That needs lengths only. In groups over the limit, runs of ``ITEMS_PER_BLOCK`` items are
put together on their own, so that a group of any size is spread over tasks; a piece more than needed may end there.

Only letters count as units; case doesn't matter. Null and empty items have no units and make no piece.
Repeated rows are the caller's to reduce.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 10_000
OVERLAP = 200
K = 3
BLOCK = 256
STEP = 64
MIN_FILL = 0.5
ITEMS_PER_BLOCK = 4096
#: Steps whose similarities are computed at a time.
CHUNK = 4096

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True
_BASE = np.full(256, 4, np.int64)
for _i, _c in enumerate("ACGT"):
    _BASE[ord(_c)] = _i

SEGMENT = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("cut", T.StringType())])


def letters(text: str | None) -> np.ndarray:
    """The units of an item, as upper-case bytes; letters beyond ASCII are no bases."""
    if not text:
        return np.empty(0, np.uint8)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return raw[_IS_LETTER[raw]] & 0xDF


def _similarities(units: np.ndarray) -> np.ndarray:
    """Cosine of the word counts of the blocks left and right of each inner step, a stretch of the item at a time."""
    steps, w, size = (len(units) - K + 1) // STEP, BLOCK // STEP, 5**K
    parts = []
    for a in range(0, steps - 2 * w + 1, CHUNK):
        b = min(a + CHUNK + 2 * w - 1, steps)  # steps whose counts this stretch needs
        code = _BASE[units[a * STEP : b * STEP + K - 1]]
        word = np.zeros((b - a) * STEP, np.int64)
        for k in range(K):
            word = word * 5 + code[k : k + len(word)]
        cells = np.bincount((np.arange(len(word)) // STEP) * size + word, minlength=(b - a) * size).reshape(b - a, size)
        sums = np.zeros((b - a + 1, size), np.float32)
        np.cumsum(cells, axis=0, dtype=np.float32, out=sums[1:])
        at = np.arange(w, b - a - w + 1)
        left, right = sums[at] - sums[at - w], sums[at + w] - sums[at]
        norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
        parts.append((left * right).sum(1) / np.maximum(norm, 1e-9))
    return np.concatenate(parts)


def depths(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, depth of the valley there) along the units: how far the similarity climbs to either side
    before it falls again."""
    w = BLOCK // STEP
    if (len(units) - K + 1) // STEP < 2 * w:
        return np.empty(0, np.int64), np.empty(0)
    similarity = _similarities(units)
    depth = _climb(similarity) + _climb(similarity[::-1])[::-1] - 2 * similarity
    return (np.arange(len(similarity)) + w) * STEP, depth


def _climb(s: np.ndarray) -> np.ndarray:
    """For each place the value that is reached going left for as long as values don't fall."""
    starts = np.ones(len(s), bool)
    starts[1:] = s[:-1] < s[1:]
    return s[np.maximum.accumulate(np.where(starts, np.arange(len(s)), 0))]


def n_runs(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (units == 78).astype(np.int8), [0]))))
    return edge[0::2], edge[1::2]


def split_item(units: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """[start, stop) of each piece and the kind of its end: n_run, valley, limit or end."""
    n = len(units)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n, "end")]
    lo, hi = n_runs(units)
    places, depth = depths(units)
    middle = (lo + hi) // 2
    pieces, start, before = [], 0, 0
    while n - start > limit:
        least = start + overlap + 1
        first, last = max(least, start + int(limit * MIN_FILL)), start + limit
        inside = np.flatnonzero((middle >= first) & (middle <= last))
        reaching = np.flatnonzero((lo <= last) & (hi >= first))
        earlier = np.flatnonzero((lo >= before) & (hi >= least) & (hi < first))
        valleys = np.flatnonzero((places >= first) & (places <= last))
        if len(inside):
            best = inside[np.lexsort((-middle[inside], -(hi - lo)[inside]))[0]]
            cut, kind = int(middle[best]), "n_run"
        elif len(reaching):
            cut, kind = min(int(hi[reaching[-1]]), last), "n_run"
        elif len(earlier):
            cut, kind = max(int(middle[earlier[-1]]), least), "n_run"
        elif len(valleys):
            best = valleys[np.lexsort((-places[valleys], -depth[valleys]))[0]]
            cut, kind = int(places[best]), "valley"
        else:
            cut, kind = last, "limit"
        pieces.append((start, cut, kind))
        start, before = cut - overlap, cut
    return [*pieces, (start, n, "end")]


def _split_batches(text_col: int, limit: int, overlap: int, with_text: bool):
    kind = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("cut", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, segments, texts = [], [], []
            for value in batch.column(text_col):
                units = letters(value.as_py())
                pieces = split_item(units, limit, overlap)
                sizes.append(len(units))
                segments.append([{"start": a, "stop": b, "cut": c} for a, b, c in pieces])
                if with_text:
                    whole = units.tobytes().decode("ascii")
                    texts.append([whole[a:b] for a, b, _ in pieces])
            keep = [i for i in range(batch.num_columns) if i != text_col]
            columns = [batch.column(i) for i in keep] + [pa.array(sizes, pa.int64()), pa.array(segments, pa.list_(kind))]
            names = [batch.schema.names[i] for i in keep] + ["_size", "_segments"]
            if with_text:
                columns.append(pa.array(texts, pa.list_(pa.string())))
                names.append("_texts")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def split_items(rows: DataFrame, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = False) -> DataFrame:
    """``rows`` without ``text``, with ``_size`` (units) and ``_segments`` (start, stop, cut), for ``with_text`` also ``_texts``."""
    if not 0 <= overlap < limit // 4:
        raise ValueError("the overlap must be under a quarter of the limit")
    at = rows.columns.index(text)
    fields = [f for f in rows.schema.fields if f.name != text]
    fields += [T.StructField("_size", T.LongType()), T.StructField("_segments", T.ArrayType(SEGMENT))]
    if with_text:
        fields.append(T.StructField("_texts", T.ArrayType(T.StringType())))
    return rows.mapInArrow(_split_batches(at, limit, overlap, with_text), T.StructType(fields))


def group_pieces(split: DataFrame, group: str, index: str, limit: int = LIMIT) -> DataFrame:
    """Pieces of whole groups: (group, piece_block, piece, index, start, stop), a row for each stretch of an item
    that a piece holds. Items within the limit fill pieces in order; longer ones bring their own pieces."""
    some = split.where(F.col("_size") > 0)
    large = some.groupBy(F.col(group).alias("_g")).agg(F.sum("_size").alias("_total")).where(F.col("_total") > limit)
    some = some.join(large, F.col(group).eqNullSafe(F.col("_g")), "left")
    block = F.when(F.col("_total").isNull(), F.lit(0).cast("long")).otherwise(F.floor(F.col(index) / ITEMS_PER_BLOCK)).alias("piece_block")
    parts = some.select(group, block, index, F.posexplode("_segments").alias("_k", "_s"), (F.size("_segments") > 1).alias("_own"))
    parts = parts.select(group, "piece_block", index, "_k", "_own", F.col("_s.start").alias("start"), F.col("_s.stop").alias("stop"))
    packed = parts.repartition(group, "piece_block").sortWithinPartitions(group, "piece_block", index, "_k")
    schema = T.StructType([*packed.schema.fields, T.StructField("piece", T.LongType())])
    return packed.mapInArrow(_next_fit(group, limit), schema).drop("_k", "_own")


def _next_fit(group: str, limit: int):
    """Rows come ordered within their block; what a block has filled is carried from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        piece = used = 0
        for batch in batches:
            get = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            pieces = []
            for key, own, start, stop in zip(zip(get[group], get["piece_block"]), get["_own"], get["start"], get["stop"]):
                size = stop - start
                if key != at:
                    at, piece, used = key, 0, size
                elif own or used + size > limit:
                    piece, used = piece + 1, size
                else:
                    used += size
                if own:
                    used = limit  # nothing else joins a piece of a longer item
                pieces.append(piece)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], [*batch.schema.names, "piece"])

    return run


def oversized(split: DataFrame, group: str, index: str, limit: int = LIMIT) -> DataFrame:
    """(group, index) of the items that came out in more than one piece, and (group, -1) of such groups. ``split`` is read three
    times; give it checkpointed."""
    items = split.where(F.size("_segments") > 1).select(group, F.col(index).cast("int").alias(index))
    place = F.struct("piece_block", "piece")
    groups = group_pieces(split, group, index, limit).groupBy(group).agg(F.min(place).alias("_a"), F.max(place).alias("_b")).where(F.col("_a") != F.col("_b"))
    return items.unionByName(groups.select(group, F.lit(-1).cast("int").alias(index)))
