"""Mixing sources to target shares of tokens (problem 9).

*Entropy balancing with capped rates*: of all document rates r in (0, M), M being the source's cap of copies, those are
taken that differ least (in the entropy of r / M) from the even rate M / 2 while the tokens of each source sum
to its target. Their dual is convex in one number a source, and the rates are exponentially tilted:
r = M / (1 + exp(-x * tokens / mean tokens)). *Newton steps* solve for x, kept within a bracket that each step narrows;
the sums of a step are one distributed aggregation over the histogram (source, tokens), which was counted in part
before its shuffle. The driver holds one number per source of the target table.

*Total*: the most that the scarcest source allows times ``FILL`` (short of its whole capacity, where rates stay
within their bounds). Sources of the target table without a token can't take part: their share is spread
over the others in proportion, and they are reported with share 0.

*Rounding into copies*: a rate is rounded down or up, never above the cap, whichever brings the tokens given out so far closer
to those due so far. Documents come longest first, so what long ones leave over is made up by short ones. Sources are
cut into salted runs of about ``DOCS_PER_RUN``, each with its own account.

Defined results: source names are compared in lower case, with ``_`` for ``-`` and blanks; documents of other or
null sources, and those without tokens, take no part. Repeated rows are used each on its own.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.session import cut_lineage

log = logging.getLogger(__name__)

FILL = 0.95
DOCS_PER_RUN = 50_000
STEPS = 60
TOLERANCE = 1e-9


def source_name(column: str) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(column, r"\s+", " "))), "[- ]", "_")


def solve_tilts(hist: DataFrame, targets: dict[str, float], caps: dict[str, int], means: dict[str, float], steps: int = STEPS) -> dict[str, float]:
    """Newton within brackets for every source at once. ``hist``: (source, n_tokens, n)."""
    spark = hist.sparkSession
    x = {s: 0.0 for s in targets}
    low, high = {s: -1e4 for s in targets}, {s: 1e4 for s in targets}
    for _ in range(steps):
        state = spark.createDataFrame([(s, x[s], float(caps[s]), means[s]) for s in targets], "source string, x double, cap double, mean double")
        z = F.col("x") * F.col("n_tokens") / F.col("mean")
        p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))))
        mass = F.col("n") * F.col("cap")
        sums = hist.join(F.broadcast(state), "source").groupBy("source").agg(F.sum(mass * p * F.col("n_tokens")).alias("got"), F.sum(mass * p * (1 - p) * F.col("n_tokens") * F.col("n_tokens") / F.col("mean")).alias("slope")).collect()
        worst = 0.0
        for r in sums:
            s, miss = r["source"], r["got"] - targets[r["source"]]
            worst = max(worst, abs(miss) / targets[s])
            if abs(miss) < TOLERANCE * targets[s]:
                continue  # solved; a further step would leave the bracket it has closed
            if miss > 0:
                high[s] = x[s]
            else:
                low[s] = x[s]
            step = x[s] - miss / r["slope"] if r["slope"] > 0 else math.inf
            x[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
        if worst < TOLERANCE:
            break
    else:
        log.warning("the tilts of %s sources are off their targets by a share of %.1e after %s steps", len(targets), worst, steps)
    return x


def mix(docs: DataFrame, targets: DataFrame, fill: float = FILL) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies) for each document that may take part. ``docs``: (doc_id, source,
    n_tokens), read twice; ``targets``: (source, target_share, max_repeats), a table of the run's settings."""
    spark = docs.sparkSession
    goal = {r["source"]: r for r in targets.where(F.col("target_share") > 0).select(source_name("source").alias("source"), "target_share", "max_repeats").collect()}
    named = docs.where(F.col("n_tokens") > 0).select("doc_id", source_name("source").alias("source"), "n_tokens")
    named = named.where(F.col("source").isin(list(goal))) if goal else named.limit(0)
    hist = cut_lineage(named.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    have = {r["source"]: r for r in hist.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens")).collect()}
    take = [s for s in goal if s in have and goal[s]["max_repeats"] > 0]
    whole = sum(goal[s]["target_share"] for s in take)
    shares = {s: goal[s]["target_share"] / whole for s in take}
    caps = {s: goal[s]["max_repeats"] for s in take}
    total = fill * min([have[s]["tokens"] * caps[s] / shares[s] for s in take], default=0)
    means = {s: have[s]["tokens"] / have[s]["docs"] for s in take}
    x = solve_tilts(hist, {s: shares[s] * total for s in take}, caps, means)
    settings = spark.createDataFrame([(s, x[s], caps[s], means[s], -(-have[s]["docs"] // DOCS_PER_RUN)) for s in take], "source string, _x double, _cap int, _mean double, _runs long")
    rate = F.col("_cap") / (1 + F.exp(-F.greatest(F.least(F.col("_x") * F.col("n_tokens") / F.col("_mean"), F.lit(700.0)), F.lit(-700.0))))
    rated = named.join(F.broadcast(settings), "source").withColumn("rate", rate).withColumn("_run", F.pmod(F.xxhash64("doc_id"), F.col("_runs")))
    runs = rated.select("doc_id", "source", "n_tokens", "rate", "_run", "_cap").repartition("source", "_run").sortWithinPartitions("source", "_run", F.col("n_tokens").desc(), "doc_id")
    schema = T.StructType([*runs.schema.fields, T.StructField("copies", T.IntegerType())])
    return runs.mapInArrow(_round, schema).select("doc_id", "source", "n_tokens", F.round("rate", 9).alias("rate"), "copies")


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by run, longest first; the run's account is carried from batch to batch."""
    at, due = None, 0.0
    for batch in batches:
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("source", "_run", "n_tokens", "rate", "_cap"))
        copies = []
        for source, run, tokens, rate, cap in zip(*columns):
            if (source, run) != at:
                at, due = (source, run), 0.0
            due += rate * tokens
            low = min(math.floor(rate), cap)
            high = min(math.ceil(rate), cap)
            k = high if abs(due - high * tokens) < abs(due - low * tokens) else low
            due -= k * tokens
            copies.append(k)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copies, pa.int32())], [*batch.schema.names, "copies"])


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source of the target table reached."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum(F.when(F.col("copies") > 0, 1).otherwise(0)).alias("documents"), F.max("copies").alias("most_copies"))
    total = used.agg(F.sum("tokens").alias("_all"))
    wanted = targets.select(source_name("source").alias("source"), "target_share", "max_repeats")
    out = wanted.join(used, "source", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)), 6).alias("actual_share"))
