"""Texts that were cut off (problem 10).

1. One pass over the whole texts gives, for each, the MinHash bands of its growing beginnings (``minhash``) and its closing word,
   and, for the corpus, how often each word closes a line (``terminality``).
2. Exact copies form a class; its member with the smallest id stands for all of them.
3. *Near-copies*: the bands of a text's widest beginning meet those of any text that begins alike, so the share that a cut
   left doesn't matter. Bands that no other text has go first. Within such a bucket a text is paired with every longer one that
   goes on behind its last shingle, without which no alignment ends early; the longest of them is tried first, and only what it
   doesn't settle meets the others. One that is complete by its own counts (6.) meets only those that go on inside its last word.
   Only texts in buckets are read again.
4. *Alignment*: a pair is verified if at least ``CONTAINED`` of the shorter text's shingles (without its last,
   perhaps broken word or a mark) stand in the part of the longer text that it aligns to. The shorter one ends early
   if the longer one goes on behind its last shingle.
5. *Closing-word terminality* for all others: the share at which the closing word closes lines of its kind. A word never
   seen takes its shape's share, next to nothing if it is the beginning of a word that was seen. What the lengths say comes
   before the word: where far more texts of a source have one exact length than its neighbours let expect, they were
   cut by a field limit, whatever they close with.
6. An *exact check* may follow (``check``; for commit records ``closing.state_of``): it acquits texts that are complete by
   their own counts, and lets a word convict at ``DOUBTFUL`` already where the record lacks something. It convicts no text that
   steps 4 and 5 pass over.

Defined results: null and blank texts are no cases; sources are compared like in ``mixing``; without ``source`` all texts
are of one source.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.llm import closing, minhash
from cladeflow.llm.mixing import source_name
from cladeflow.llm.terminality import OPAQUE, close_of, count_tokens, strip_mark
from cladeflow.operators.fragment_replicate import spread_join
from cladeflow.session import broadcast_if_small, cut_lineage

CONTAINED = 0.8
#: Below this share of closings a closing word speaks for a cut, and below that one together with an exact check.
TERMINAL, DOUBTFUL = 0.05, 0.5
#: Weight of the shape's share against that of the word itself, in occurrences; what is left of it for a beginning of a word.
PRIOR_WEIGHT, BEGUN = 3.0, 0.05
#: Neighbouring lengths on either side that tell how many texts of a length to expect; chance of a field limit seen in error.
AROUND, CHANCE = 16, 1e-6

#: Text that is taken apart at a time, in bytes; rows that are handed on at a time.
PART_BYTES, ROWS = 24 << 20, 1 << 16
#: Words at a text's end among which its last complete shingle is: a broken word and a mark may follow.
WORDS_BEHIND = minhash.WORDS + 2

_SCAN = "doc_id long, source string, h1 long, h2 long, size long, keys array<long>, state string, region string, token string, seen long, closed long"
_TYPES = [("doc_id", pa.int64()), ("source", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64())), ("state", pa.string()), ("region", pa.string()), ("token", pa.string()), ("seen", pa.int64()), ("closed", pa.int64())]


def _complete_words(text: str, n_words: int) -> int:
    """Words before the last one, which may be broken, a mark aside."""
    shown = strip_mark(text)
    whole_mark = len(shown) < len(text) and (not shown or shown[-1].isspace() or text[len(shown)].isspace())
    return max(0, n_words - 1 - whole_mark)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about PART_BYTES of text (in column 1) at most, or of one text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _scan(check: Callable[[str], str | None] | None):
    """A row per text (seen is null) and a row per word and kind of line of the batch (doc_id is null)."""
    schema = pa.schema(_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            n = batch.num_rows
            texts = batch.column(1)
            plain = [t or "" for t in texts.to_pylist()]
            words = minhash.split(texts)
            grams, off = minhash.shingle_hashes(words.hashes(), words.by_text)
            keys, key_at = minhash.band_keys(grams, off)
            closes = [close_of(t) if t.strip() else None for t in plain]
            columns = {
                "doc_id": batch.column(0), "source": batch.column(2), "h1": batch.column(3), "h2": batch.column(4),
                "size": pa.array([len(t) if t.strip() else None for t in plain], pa.int64()),
                "keys": pa.ListArray.from_arrays(key_at.astype(np.int32), pa.array(keys)),
                "state": pa.array([check(t) if check and t.strip() else None for t in plain], pa.string()),
                "region": pa.array([c and c[0] for c in closes], pa.string()), "token": pa.array([c and c[1] for c in closes], pa.string()),
            }
            yield _filled(columns, n, schema)
            counts = count_tokens(words)
            columns = {
                "region": pa.array([c[0] for c in counts], pa.string()), "token": pa.array([c[1] for c in counts], pa.string()),
                "seen": pa.array([c[2] for c in counts], pa.int64()), "closed": pa.array([c[3] for c in counts], pa.int64()),
            }
            yield _filled(columns, len(counts), schema)

    return run


def _filled(columns: dict[str, pa.Array], n: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str | None = None, check: Callable[[str], str | None] | None = closing.state_of) -> DataFrame:
    """The narrow results of the one pass over whole texts, checkpointed."""
    name = F.lit(None).cast("string") if source is None else source_name(source)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), name.alias("source"), F.xxhash64(text, F.lit(1)).alias("h1"), F.xxhash64(text, F.lit(2)).alias("h2"))
    return cut_lineage(rows.mapInArrow(_scan(check), _SCAN))


def classes(scanned: DataFrame) -> DataFrame:
    """(doc_id, source, class_id, size): the smallest id among the texts that are equal, and their length."""
    texts = scanned.where(F.col("seen").isNull() & F.col("size").isNotNull()).select("doc_id", "source", "h1", "h2", "size")
    first = texts.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"))
    return texts.join(first, ["h1", "h2"]).select("doc_id", "source", "class_id", "size")


def buckets(scanned: DataFrame, reps: DataFrame) -> DataFrame:
    """(doc_id, key, width, own), checkpointed: the bands that different texts share, being the widest one of some text
    (``own``). ``reps``: (doc_id) of one text a class."""
    texts = scanned.where(F.col("seen").isNull() & (F.size("keys") > 0))
    banded = texts.select("doc_id", "h1", F.size("keys").alias("_n"), F.posexplode("keys").alias("_p", "key"))
    banded = banded.select("doc_id", "h1", "key", (F.col("_p") / minhash.BANDS).cast("int").alias("width"), (F.col("_p") >= F.col("_n") - minhash.BANDS).alias("own"))
    shared = banded.groupBy("key").agg(F.min("h1").alias("_a"), F.max("h1").alias("_b"), F.max("own").alias("_own")).where((F.col("_a") != F.col("_b")) & F.col("_own")).select("key")
    shared = broadcast_if_small(cut_lineage(shared))
    return cut_lineage(banded.drop("h1").join(shared, "key", "left_semi").join(reps, "doc_id", "left_semi"))


def texts_of(docs: DataFrame, members: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text, size), checkpointed: the whole texts of the documents in ``members``."""
    needed = broadcast_if_small(cut_lineage(members.select("doc_id").distinct()))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.length(text).alias("size"))
    return cut_lineage(texts.join(needed, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def _last_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text its last shingle before a perhaps broken word, null if there is none, and that word."""
    for batch in batches:
        last, broken = [], []
        for text in batch.column(1).to_pylist():
            words = (text or "").rsplit(None, WORDS_BEHIND)[-WORDS_BEHIND:]
            k = _complete_words(text, len(words)) if words else 0
            last.append(" ".join(words[k - minhash.WORDS : k]) if k >= minhash.WORDS else None)
            broken.append(strip_mark(text).rsplit(None, 1)[-1] if last[-1] else None)
        words = minhash.split(pa.array(last, pa.string()))
        grams, _ = minhash.shingle_hashes(words.hashes(), words.by_text)
        at = iter(grams.view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else next(at) for t in last], pa.int64()), pa.array(broken, pa.string())], ["doc_id", "gram", "broken"])


def _followed_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text all shingles but the last one, with the word behind them and whether others follow that word (``more``)."""
    for batch in _parts(batches):
        words = minhash.split(batch.column(1))
        grams, off = minhash.shingle_hashes(words.hashes(), words.by_text)
        n = np.diff(off)
        left = np.repeat(off[1:], n) - np.arange(len(grams)) - 1  # shingles behind each, as many as words
        behind = (np.repeat(words.by_text[1:], n) - left)[left > 0]
        ids, signed, more = np.repeat(batch.column(0).to_numpy(), n)[left > 0], grams.view(np.int64)[left > 0], (left > 1)[left > 0]
        vocabulary = pa.array(words.vocabulary, pa.string())
        for a in range(0, len(ids), ROWS):
            word = vocabulary.take(pa.array(words.codes[behind[a : a + ROWS]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + ROWS]), pa.array(signed[a : a + ROWS]), word, pa.array(more[a : a + ROWS])], ["doc_id", "gram", "word", "more"])


def places(members: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(short_id, spot, short_size, broken) and (long_id, spot, long_size, word, more), checkpointed. A spot is a bucket and a text's last
    shingle; there the first table has the texts that close with it and whose own bucket that is, the second one all of the bucket
    that go on behind it, by the word that follows."""
    texts = texts.select("doc_id", "text", F.col("size").cast("long").alias("size"))
    sizes = texts.select("doc_id", "size")
    spot = F.xxhash64("key", "gram").alias("spot")
    last = texts.mapInArrow(_last_shingles, "doc_id long, gram long, broken string").where(F.col("gram").isNotNull())
    short = cut_lineage(members.where("own").select("doc_id", "key").join(last.join(sizes, "doc_id"), "doc_id").select(F.col("doc_id").alias("short_id"), "gram", spot, F.col("size").alias("short_size"), "broken"))
    asked = broadcast_if_small(cut_lineage(short.select("gram").distinct()))
    rows = texts.select("doc_id", "text").mapInArrow(_followed_shingles, "doc_id long, gram long, word string, more boolean").join(asked, "gram", "left_semi")
    held = rows.groupBy("doc_id", "gram", "word").agg(F.max("more").alias("more"))
    spots = short.groupBy("spot").agg(F.min("short_size").alias("_least"))
    long = members.select("doc_id", "key").join(held.join(sizes, "doc_id"), "doc_id").select(F.col("doc_id").alias("long_id"), spot, F.col("size").alias("long_size"), "word", "more")
    return short.drop("gram"), cut_lineage(long.join(spots, "spot").where(F.col("long_size") > F.col("_least")).drop("_least"))


def _between(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short_id, long_id) of the rows of ``places`` that meet, more than one word following."""
    on = long.where("more").select("spot", "long_id", "long_size").distinct()
    return spread_join(short, on, "spot", salt=F.xxhash64("short_id")).where(F.col("short_size") < F.col("long_size")).select("short_id", "long_id")


def _inside(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short_id, long_id) of the rows of ``places`` that meet, the broken word being a beginning of the one that follows; that is
    decided by distinct words."""
    grown = short.select("spot", "broken").distinct().join(long.select("spot", "word").distinct(), "spot").where(F.col("word").startswith(F.col("broken")) & (F.col("word") != F.col("broken")))
    return short.join(grown, ["spot", "broken"]).join(long, ["spot", "word"]).where(F.col("short_size") < F.col("long_size")).select("short_id", "long_id")


def candidate_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(short_id, long_id): each text of ``members`` (see ``buckets``) with every longer one that begins alike and goes on behind its
    last shingle, wherever that stands. What ``aligned_early`` verifies is among them, whatever else a bucket holds."""
    short, long = places(members, texts)
    return cut_lineage(_between(short, long).unionByName(_inside(short, long)).distinct())


def near_copies(members: DataFrame, texts: DataFrame, done: DataFrame) -> DataFrame:
    """(doc_id, inside): the texts of which ``aligned_early`` verifies one of the ``candidate_pairs``. Those of ``done`` (doc_id) count
    only if they stop inside a word, and meet only texts that say so. The longest text of a spot, and of each word that follows there, is
    tried first; what it settles needs no other pair, so many cut copies of a text don't meet each other; all else meets all its candidates."""
    short, long = places(members, texts)
    done = cut_lineage(short.select("short_id").distinct().join(done.select(F.col("doc_id").alias("short_id")), "short_id", "left_semi"))
    top = F.max(F.struct("long_size", "long_id")).alias("m")
    widest = long.where("more").groupBy("spot").agg(top).select("spot", "m.long_size", "m.long_id", F.lit(True).alias("more"))
    by_word = long.groupBy("spot", "word").agg(top).select("spot", "word", "m.long_size", "m.long_id")
    tried = cut_lineage(_between(short.join(done, "short_id", "left_anti"), widest).unionByName(_inside(short, by_word)).distinct())
    early = cut_lineage(aligned_early(texts, tried).withColumnRenamed("doc_id", "short_id"))
    settled = early.where("inside").select("short_id").unionByName(early.where(~F.col("inside")).select("short_id").join(done, "short_id", "left_anti"))
    open_ = cut_lineage(short.join(settled, "short_id", "left_anti"))
    rest = _between(open_.join(done, "short_id", "left_anti"), long).unionByName(_inside(open_, long)).distinct()
    rest = cut_lineage(rest.join(tried, ["short_id", "long_id"], "left_anti"))
    found = early.select(F.col("short_id").alias("doc_id"), "inside").unionByName(aligned_early(texts, rest))
    return found.groupBy("doc_id").agg(F.max("inside").alias("inside"))


def _early(a: np.ndarray, b: np.ndarray, short: str, long: str) -> str | None:
    """How a text with the shingles ``a`` ends early in one with the shingles ``b``: between words, inside a word, or not."""
    cut = _complete_words(short, len(a) + minhash.WORDS - 1)
    own = a[: max(0, cut - minhash.WORDS + 1)]
    if not len(own):
        return None
    there = np.flatnonzero(b == own[-1])
    if not len(there):
        return None
    at = int(there[np.abs(there - len(own) + 1).argmin()])
    if np.isin(own, b[: at + 1]).mean() < CONTAINED:
        return None
    rest = len(b) - 1 - at  # words behind the last shingle
    if rest < 1:
        return None
    broken, whole = strip_mark(short).split()[-1], long.split()[at + minhash.WORDS]
    if whole != broken and whole.startswith(broken):
        return "inside"
    return "between" if rest > 1 else None


def ends_early(short: str, long: str) -> bool:
    """Whether ``short``, without a mark for the rest, is a copy of a part of ``long`` that stops before ``long`` does."""
    a, b = _shingles([short, long])
    return _early(a, b, short, long) is not None


def _shingles(texts: list[str]) -> list[np.ndarray]:
    words = minhash.split(pa.array(texts, pa.string()))
    grams, off = minhash.shingle_hashes(words.hashes(), words.by_text)
    return [grams[a:b] for a, b in zip(off[:-1], off[1:])]


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        short, long = ([t or "" for t in batch.column(i).to_pylist()] for i in (1, 2))
        early = [_early(a, b, x, y) for a, b, x, y in zip(_shingles(short), _shingles(long), short, long)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(early, pa.string())], ["short_id", "early"])


def aligned_early(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, inside): the shorter texts whose alignment with a near-copy ends early; whether inside a word."""
    one = pairs.join(texts.select(F.col("doc_id").alias("short_id"), F.col("text").alias("short_text")), "short_id")
    both = spread_join(one, texts.select(F.col("doc_id").alias("long_id"), F.col("text").alias("long_text")), "long_id", salt=F.xxhash64("short_id"))
    found = both.select("short_id", "short_text", "long_text").mapInArrow(_align, "short_id long, early string").where(F.col("early").isNotNull())
    return found.groupBy(F.col("short_id").alias("doc_id")).agg(F.max(F.col("early") == "inside").alias("inside"))


def begun_words(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(token) of ``asked`` that are proper beginnings of a token of ``words``: in sorted order a beginning stands before the
    words that it begins, so the next word alone decides, whatever the lengths."""
    head = 3
    vocabulary = words.select("token").where(~F.col("token").startswith(OPAQUE)).distinct()
    asked = asked.select("token").where(F.col("token").isNotNull() & ~F.col("token").startswith(OPAQUE)).distinct()
    both = vocabulary.select("token", F.col("token").alias("_word")).unionByName(asked.where(F.length("token") >= head).select("token", F.lit(None).cast("string").alias("_word")))
    later = Window.partitionBy(F.substring("token", 1, head)).orderBy(F.col("token").desc(), F.col("_word").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    long = both.withColumn("_next", F.last("_word", ignorenulls=True).over(later)).where(F.col("_word").isNull() & F.col("_next").startswith(F.col("token"))).select("token")
    heads = vocabulary.select(F.explode(F.array(*[F.when(F.length("token") > k, F.substring("token", 1, k)) for k in range(1, head)])).alias("token")).where(F.col("token").isNotNull()).distinct()
    return long.unionByName(asked.where(F.length("token") < head).join(heads, "token", "left_semi"))


def terminality(scanned: DataFrame, closes: DataFrame) -> DataFrame:
    """``closes`` with ``terminal``: the share at which its closing word closes lines of its kind. Without a word: 1 behind a line
    break, half of DOUBTFUL for a mark or blanks alone."""
    shape = F.when(F.col("token").startswith(OPAQUE), F.col("token")).otherwise(F.regexp_replace("token", r"\p{L}+", "w"))
    words = cut_lineage(scanned.where(F.col("seen").isNotNull()).groupBy("region", "token").agg(F.sum("seen").alias("seen"), F.sum("closed").alias("closed")).withColumn("shape", shape))
    shapes = words.groupBy("region", "shape").agg(F.sum("seen").alias("_s_seen"), F.sum("closed").alias("_s_closed"))
    asked = cut_lineage(closes.where(F.col("token").isNotNull()).select("region", "token").distinct().withColumn("shape", shape))
    begun = begun_words(asked, words).withColumn("_begun", F.lit(True))
    data = words.where(F.col("token").startswith(OPAQUE)).groupBy("token").agg(F.sum("closed").alias("_ends"))
    most = data.groupBy(F.substring("token", 1, 2).alias("_family")).agg(F.max("_ends").alias("_most"))
    j = asked.join(words.drop("shape"), ["region", "token"], "left").join(shapes, ["region", "shape"], "left").join(begun, "token", "left")
    j = j.withColumn("_family", F.when(F.col("token").startswith(OPAQUE), F.substring("token", 1, 2))).join(data, "token", "left").join(most, "_family", "left")
    known = F.col("_s_closed") / F.col("_s_seen")
    never = F.when(F.coalesce("_begun", F.lit(False)), F.coalesce(known * BEGUN, F.lit(TERMINAL * BEGUN))).otherwise(F.coalesce(known, F.lit(DOUBTFUL)))
    own = (F.col("closed") + F.coalesce(known, F.lit(DOUBTFUL)) * PRIOR_WEIGHT) / (F.col("seen") + PRIOR_WEIGHT)
    encoded = F.coalesce(F.coalesce("_ends", F.lit(0)) / F.when(F.col("_most") > 0, F.col("_most")), F.lit(DOUBTFUL))
    found = j.select("region", "token", F.when(F.col("_family").isNotNull(), encoded).when(F.col("seen").isNotNull(), own).otherwise(never).alias("_terminal"))
    unclear = F.when(F.col("region").isNotNull(), F.lit(DOUBTFUL / 2)).otherwise(F.lit(1.0))
    return closes.join(found, ["region", "token"], "left").withColumn("terminal", F.when(F.col("token").isNull(), unclear).otherwise(F.col("_terminal"))).select(*closes.columns, "terminal")


def limited(members: DataFrame) -> DataFrame:
    """(class_id) of the texts whose length is a field limit of a source: (class_id, source, size) rows. The expectation is the
    mean over neighbouring lengths, the chance a bound on the Poisson tail."""
    by = members.select("class_id", "source", "size").distinct()
    lengths = by.groupBy("source", "size").agg(F.count(F.lit(1)).alias("_k"))
    around = F.sum("_k").over(Window.partitionBy("source").orderBy("size").rangeBetween(-AROUND, AROUND))
    expected = (around - F.col("_k") + 1) / (2 * AROUND)
    tail = -F.col("_e") + F.col("_k") * (1 + F.log("_e") - F.log("_k"))
    piled = lengths.withColumn("_e", expected).where((F.col("_k") > F.col("_e")) & (tail < math.log(CHANCE)) & (F.col("_e") < 0.1 * F.col("_k")))
    return by.join(piled.select(F.col("source").alias("_src"), F.col("size").alias("_size")), F.col("source").eqNullSafe(F.col("_src")) & (F.col("size") == F.col("_size")), "left_semi").select("class_id").distinct()


def verdict(aligned: Column, limit: Column, terminal: Column, state: Column) -> Column:
    """alignment, limit or word, by what a text counts as cut; null: it doesn't."""
    done = F.coalesce(state == "done", F.lit(False))
    least = F.when(state.isin("open", "unsigned"), DOUBTFUL).otherwise(TERMINAL)
    return F.when(F.coalesce(aligned, F.lit(False)), "alignment").when(~done & limit, "limit").when(~done & (terminal < least), "word")


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str | None = None, check: Callable[[str], str | None] | None = closing.state_of) -> DataFrame:
    """(doc_id, class_id, cut, by): every text that isn't null or blank; ``by`` is alignment, limit or word."""
    scanned = scan(docs, text, doc_id, source, check)
    members = cut_lineage(classes(scanned))
    reps = members.where(F.col("doc_id") == F.col("class_id")).select("doc_id")
    together = buckets(scanned, reps)
    texts = texts_of(docs, together, text, doc_id)
    limit = limited(members).select(F.col("class_id").alias("doc_id")).withColumn("_limit", F.lit(True))
    closes = cut_lineage(scanned.where(F.col("seen").isNull()).select("doc_id", "state", "region", "token").join(reps, "doc_id", "left_semi"))
    early = cut_lineage(near_copies(together, texts, closes.where(F.col("state") == "done").select("doc_id"))).withColumn("_early", F.lit(True))
    scored = terminality(scanned, closes).join(early, "doc_id", "left").join(limit, "doc_id", "left")
    # a near-copy that stops between words may be complete in itself; one that stops inside a word isn't
    aligned = F.col("_early") & (F.col("inside") | ~F.coalesce(F.col("state") == "done", F.lit(False)))
    by = verdict(aligned, F.coalesce("_limit", F.lit(False)), F.col("terminal"), F.col("state"))
    return members.join(scored.select(F.col("doc_id").alias("class_id"), by.alias("by")), "class_id").select("doc_id", "class_id", F.col("by").isNotNull().alias("cut"), "by")
