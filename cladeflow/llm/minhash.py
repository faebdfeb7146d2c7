"""MinHash bands of word shingles over growing beginnings of whole texts, a batch at a time.

A text that was cut resembles its whole only as far as it goes, so whole texts are not compared: each text has the
bands of its first ``W`` words for the widths 6, 12, 24, 48 .. up to its own length. The widest one of a short text, at least half of it, meets the
same beginning of the long one whatever share the cut left.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
BANDS = 3
ROWS = 2
#: Of so many neighbouring shingles at least one is picked as an anchor.
ANCHORS = 8
#: Texts whose shingles are hashed at a time; keeps the arrays within a core's cache.
CHUNK = 128

_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 / golden ratio
_rng = np.random.default_rng(20240607)
_MULTIPLIERS = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


WIDTHS = (WORDS + 1) * 2 ** np.arange(29)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


@dataclass(frozen=True)
class Words:
    """The words of texts by line: what white space separates."""

    vocabulary: list[str]
    #: Of every word: its place in the vocabulary.
    codes: np.ndarray
    #: Where each line's words begin (one more than lines), where each text's lines begin (one more than texts).
    lines: np.ndarray
    texts: np.ndarray
    #: The lines themselves.
    raw: pa.Array

    @property
    def by_text(self) -> np.ndarray:
        return self.lines[self.texts]

    def hashes(self) -> np.ndarray:
        unique = np.fromiter(((zlib.crc32(b := w.encode()) << 32) | zlib.adler32(b) for w in self.vocabulary), np.uint64, len(self.vocabulary))
        return _scramble(unique)[self.codes] if len(self.codes) else np.empty(0, np.uint64)


def split(texts: pa.Array) -> Words:
    """Null texts have no words; a text without a line break is one line."""
    lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    at = np.concatenate(([0], np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False)))).astype(np.int64)
    raw = lines.flatten()
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(raw))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten()
    blank = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    if blank.any():  # a line without words gives one empty word
        owner = np.repeat(np.arange(len(counts)), counts)[~blank]
        flat = flat.filter(pa.array(~blank))
        counts = np.bincount(owner, minlength=len(counts))
    enc = flat.dictionary_encode()
    return Words(enc.dictionary.to_pylist(), enc.indices.to_numpy(), np.concatenate(([0], np.cumsum(counts))).astype(np.int64), at, raw)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle of WORDS words, offsets); a text of fewer words has none."""
    count = np.maximum(np.diff(offsets) - WORDS + 1, 0)
    rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled += words[k : k + len(rolled)] * _POWERS[k]
    starts = np.repeat(offsets[:-1], count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    return _scramble(rolled[starts]), np.concatenate(([0], np.cumsum(count)))


def band_keys(shingles: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): of each text BANDS keys for every width up to its number of words, the widest last."""
    stops = WIDTHS - WORDS + 1  # shingles within each width
    n = np.diff(off)
    widths = np.searchsorted(stops, n, side="right")
    out = np.concatenate(([0], np.cumsum(widths))) * BANDS
    keys = np.empty(int(out[-1]), np.uint64)
    begins = np.concatenate(([0], stops))
    for a in range(0, len(n), CHUNK):
        some = np.flatnonzero(widths[a : a + CHUNK]) + a
        if len(some) == 0:
            continue
        w = widths[some]
        # a stretch of shingles between neighbouring widths, and what is behind the widest one
        parts = w + (n[some] > stops[w - 1])
        row = np.repeat(np.arange(len(some)), parts)
        col = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        low, high = off[some[0]], off[some[-1] + 1]
        start = off[some][row] + begins[col] - low
        real = col < w[row]
        part = shingles[low:high]
        lows = np.full((len(some), int(w.max())), np.iinfo(np.uint64).max, np.uint64)
        for band in range(BANDS):
            key = np.repeat((np.arange(int(w.max())).astype(np.uint64) * np.uint64(BANDS) + np.uint64(band + 1))[None, :] * _MIX, len(some), axis=0)
            for r in range(ROWS):
                mins = np.minimum.reduceat(part * _MULTIPLIERS[band * ROWS + r], start)
                lows[:] = np.iinfo(np.uint64).max
                lows[row[real], col[real]] = mins[real]
                key = _scramble(key ^ np.minimum.accumulate(lows, axis=1)) * _MIX
            keys[out[some][row[real]] + col[real] * BANDS + band] = key[row[real], col[real]]
    return keys.view(np.int64), out


def anchors(shingles: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places of the shingles that are the smallest of some ANCHORS neighbours of their text, or of all those at its beginning;
    of equal ones the first. Equal stretches of ANCHORS shingles have equal anchors wherever they stand."""
    picked = np.zeros(len(shingles), bool)
    n = np.diff(off)
    if len(shingles) >= ANCHORS:
        first = np.repeat(off[:-1], np.maximum(n - ANCHORS + 1, 0))
        k = np.arange(len(first)) - np.repeat(np.cumsum(np.maximum(n - ANCHORS + 1, 0)) - np.maximum(n - ANCHORS + 1, 0), np.maximum(n - ANCHORS + 1, 0))
        at = first + k
        stretch = np.lib.stride_tricks.sliding_window_view(shingles, ANCHORS)
        for a in range(0, len(at), 1 << 18):
            some = at[a : a + (1 << 18)]
            picked[some + stretch[some].argmin(axis=1)] = True
    least = np.full(len(n), np.iinfo(np.uint64).max, np.uint64)
    for k in range(ANCHORS):
        there = np.flatnonzero(n > k)
        here = shingles[off[there] + k]
        new = here < least[there]
        picked[off[there][new] + k] = True
        least[there[new]] = here[new]
    return np.flatnonzero(picked)


def anchor_before(shingles: np.ndarray, begin: int, stop: int) -> int | None:
    """The place of the anchor of the last ANCHORS shingles of [begin, stop)."""
    if stop <= begin:
        return None
    a = max(begin, stop - ANCHORS)
    return a + int(shingles[a:stop].argmin())
