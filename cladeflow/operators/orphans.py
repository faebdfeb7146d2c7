"""References to records that are missing, deleted or loaded later (problem 5).

1. *Bloom filter* of the parent keys, built in the JVM: each key sets ``HASHES`` bits of one 64-bit word,
   words are united by ``bit_or`` (partial aggregation). The filter is a table (word, bits) of at
   most 8 bytes per ``KEYS_PER_WORD`` keys; it is broadcast while it has at most ``MAX_WORDS`` words, a
   bound that is checked when it is built, and joined by shuffle beyond that.
2. References that miss a bit are *definite orphans*; they never meet the parent table.
3. The others are verified by exact join. All of this, the replacement of retired ids too, happens on the distinct ids
   that are referred to, so the number of references to a popular parent doesn't matter; the verdict is joined back by
   fragment and replicate.

Reasons, the first that fits: ``deleted``, ``missing`` (also where the replacement is endless),
``late`` (the earliest record of the parent is newer than the referring row; a null time of the
referring row or of all parents' rows is never late).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.operators.fragment_replicate import balanced_join
from cladeflow.operators.hierarchy import replace_ids
from cladeflow.session import cut_lineage

KEYS_PER_WORD = 4
HASHES = 4
#: 8 MB of bits; as a hash relation on an executor about 32 MB.
MAX_WORDS = 1 << 20


def _word_and_bits(key: str, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(F.col(key), F.lit(17))
    word = F.pmod(F.xxhash64(F.col(key), F.lit(29)), F.lit(words)).cast("long")
    bits: Column = F.lit(0).cast("long")
    for k in range(HASHES):
        bits = bits.bitwiseOR(F.expr(f"shiftleft(1L, cast(pmod(shiftright(_h, {6 * k}), 64) as int))"))
    return h, word, bits


def _hashed(df: DataFrame, key: str, words: int) -> DataFrame:
    h, word, bits = _word_and_bits(key, words)
    return df.withColumn("_h", h).withColumn("_word", word).withColumn("_bits", bits).drop("_h")


def build_bloom(parents: DataFrame, key: str) -> tuple[DataFrame, int]:
    """((word, bits), number of words) of the distinct non-null keys."""
    keys = parents.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_k"))
    n = keys.agg(F.approx_count_distinct("_k").alias("n")).first()["n"]
    words = 1 << max(4, math.ceil(math.log2(max(1, n) / KEYS_PER_WORD + 1)))
    table = _hashed(keys, "_k", words).groupBy("_word").agg(F.bit_or("_bits").alias("_have"))
    return table, words


def bloom_split(refs: DataFrame, key: str, bloom: DataFrame, words: int) -> DataFrame:
    """``refs`` with ``_maybe``: false proves that the parent doesn't exist."""
    table = bloom.withColumnRenamed("_word", "_w")
    h = _hashed(refs, key, words)
    j = h.join(F.broadcast(table) if words <= MAX_WORDS else table, h["_word"] == table["_w"], "left")
    maybe = F.coalesce(F.col("_have").bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False))
    return j.withColumn("_maybe", maybe).drop("_word", "_w", "_bits", "_have")


def find_orphans(refs: DataFrame, parents: DataFrame, deleted: DataFrame, resolved: DataFrame, ref: str = "ref_id", referred_at: str = "loaded_at", parent: str = "taxid", parent_at: str = "loaded_at") -> DataFrame:
    """The rows of ``refs`` (ids in ``ref``, null and 0 being no reference) that fail, with ``reason``."""
    named = cut_lineage(refs.where(F.col(ref).isNotNull() & (F.col(ref) != 0)).withColumn("_raw", F.col(ref).cast("long")))
    gone = deleted.where(F.col(parent).isNotNull()).select(F.col(parent).cast("long").alias("_id")).distinct().withColumn("_deleted", F.lit(True))
    bloom, words = build_bloom(parents, parent)
    ids = replace_ids(named.select("_raw").distinct(), "_raw", resolved, "_id", "_endless")
    probed = cut_lineage(bloom_split(ids, "_id", bloom, words))
    exact = parents.where(F.col(parent).isNotNull()).groupBy(F.col(parent).cast("long").alias("_id")).agg(F.min(parent_at).alias("_since"))
    exact = exact.withColumn("_known", F.lit(True))
    asked = ["_raw", "_id", "_endless"]
    positive = probed.where("_maybe").select(*asked).join(exact, "_id", "left")
    negative = probed.where(~F.col("_maybe")).select(*asked, F.lit(None).cast(exact.schema["_since"].dataType).alias("_since"), F.lit(None).cast("boolean").alias("_known"))
    verdict = cut_lineage(positive.unionByName(negative).join(gone, "_id", "left").drop("_id"))
    judged = balanced_join(named, verdict, ["_raw"], "left")
    reason = (
        F.when(F.col("_endless"), "missing")
        .when(F.coalesce(F.col("_deleted"), F.lit(False)), "deleted")
        .when(~F.coalesce(F.col("_known"), F.lit(False)), "missing")
        .when(F.coalesce(F.col("_since") > F.col(referred_at), F.lit(False)), "late")
    )
    out = judged.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return out.drop("_raw", "_endless", "_since", "_known", "_deleted")
