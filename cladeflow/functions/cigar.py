"""CIGAR strings to (identity, matched length, aligned fraction), as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r"([0-9]*)([^0-9])"


def cigar_tokens(cigar: Column) -> Column:
    """array<struct<n, op>>; operations without a count, or with 0, are left out (they don't end a gap run)."""
    ops = F.regexp_extract_all(cigar, F.lit(_TOKEN), F.lit(2))
    counts = F.regexp_extract_all(cigar, F.lit(_TOKEN), F.lit(1))
    pairs = F.zip_with(counts, ops, lambda n, o: F.struct(F.coalesce(n.try_cast("long"), F.lit(0)).alias("n"), o.alias("op")))
    return F.filter(pairs, lambda t: t["n"] > 0)


def _total(tokens: Column, ops: str) -> Column:
    chosen = F.filter(tokens, lambda t: t["op"].isin(*ops))
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda acc, t: acc + t["n"])


def _gap_events(tokens: Column) -> Column:
    """Runs of adjacent I tokens and of adjacent D tokens."""
    start = F.filter(tokens, lambda t, i: t["op"].isin("I", "D") & (F.when(i == 0, F.lit("")).otherwise(F.get(tokens, i - 1)["op"]) != t["op"]))
    return F.size(start).cast("long")


def cigar_stats(cigar: Column, gap_compressed: bool = True) -> Column:
    """struct<identity, matched_len, fraction>. Once a CIGAR has = or X, its M don't count for the identity."""
    t = cigar_tokens(cigar)
    eq, x, m, ins, dele, soft = (_total(t, c) for c in ("=", "X", "M", "I", "D", "S"))
    gaps = _gap_events(t) if gap_compressed else ins + dele
    extended = (eq + x) > 0
    good = F.when(extended, eq).otherwise(m)
    whole = F.when(extended, eq + x).otherwise(m) + gaps
    read = m + eq + x + ins
    identity = F.when(whole > 0, good / whole).otherwise(F.lit(0.0))
    fraction = F.when(read + soft > 0, read / (read + soft)).otherwise(F.lit(0.0))
    return F.when(cigar.isNotNull(), F.struct(identity.alias("identity"), good.alias("matched_len"), fraction.alias("fraction")))
