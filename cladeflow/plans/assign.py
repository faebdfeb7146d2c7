"""From kept alignments to candidate taxa: thresholds, species before genus, the best alignment per read and taxon, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.config import GENUS_MIN_FRACTION, ProfileConfig
from cladeflow.operators import run_bitmaps

KINDS = ("span", "fixed", "flex")


def species_ok(cfg: ProfileConfig) -> Column:
    return (F.col("mapped_len") >= cfg.mapped_len) & (F.col("identity") >= cfg.identity) & (F.col("fraction") >= cfg.fraction)


def genus_ok(cfg: ProfileConfig) -> Column:
    return (F.col("identity") >= cfg.genus_identity) & (F.col("mapped_len") >= cfg.genus_mapped_len) & (F.col("fraction") >= GENUS_MIN_FRACTION) & F.col("genus_taxid").isNotNull()


def candidates(kept: DataFrame, cfg: ProfileConfig, fallback: bool = False) -> DataFrame:
    """Alignments that pass, with ``taxid`` and ``rank``; genus candidates only for reads without a species candidate. The reads with
    one are made distinct before they are sent, and only rows that could be genus candidates meet them."""
    species = kept.withColumn("_sp", species_ok(cfg))
    if not fallback:
        return species.where("_sp").withColumn("taxid", F.col("species_taxid")).withColumn("rank", F.lit("species")).drop("_sp")
    first = species.where("_sp").withColumn("taxid", F.col("species_taxid")).withColumn("rank", F.lit("species"))
    reads = first.select(F.col("read_name").alias("_read")).distinct()
    second = species.where(~F.col("_sp") & genus_ok(cfg)).join(reads, F.col("read_name").eqNullSafe(F.col("_read")), "left_anti")
    return first.unionByName(second.withColumn("taxid", F.col("genus_taxid")).withColumn("rank", F.lit("genus"))).drop("_sp")


def best_per_taxon(cands: DataFrame, by: str = "identity") -> DataFrame:
    """One alignment per read and taxon: the highest ``by``, of equal ones the first in the file; with ``depth``.
    The ``= 1`` becomes a group limit, applied before the shuffle too."""
    ranked = cands.withColumn("depth", F.col("mapped_len") / F.col("asm_len"))
    w = Window.partitionBy("read_name", "taxid").orderBy(F.col(by).desc(), F.col("ordinal"))
    return ranked.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def covered_lengths(rows: DataFrame, keys: list[str], length: str = "asm_len", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(keys..., kind, covered): units that at least one interval covers, by run bitmaps - no ordered pass over a taxon's
    alignments, so the taxon that holds a third of them is no hot task."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}.s").alias("s"), F.col(f"{k}.e").alias("e")) for k in kinds])).alias("i"), F.lit(2**62).alias("_length"))
    long = long.select(*keys, F.col("i.kind").alias("kind"), F.col("i.s").alias("s"), F.col("i.e").alias("e"), "_length")
    shards = run_bitmaps.shard_runs(long, [*keys, "kind"], "s", "e", "_length")
    bits = F.aggregate("set_runs", F.lit(0).cast("long"), lambda acc, r: acc + r["e"] - r["s"])
    return shards.groupBy(*keys, "kind").agg(F.sum(bits).alias("covered"))


def merged_islands(rows: DataFrame, keys: list[str], kind: str = "span") -> DataFrame:
    """(keys..., s, e): intervals merged where they overlap; touching ones stay apart. On an axis of half units
    ([2s, 2e - 1)) touching intervals leave one unit free, so the same bitmaps serve."""
    doubled = rows.select(*keys, (F.col(f"{kind}.s") * 2).alias("s"), (F.col(f"{kind}.e") * 2 - 1).alias("e"), F.lit(2**62).alias("_length"))
    p = run_bitmaps.periods(doubled, keys, "s", "e", "_length")
    return p.select(*keys, F.floor(F.col("period_start") / 2).alias("s"), F.floor((F.col("period_end") + 1) / 2).alias("e"))


def taxon_coverage(best: DataFrame) -> DataFrame:
    """(taxid, breadth, fixed_chunk, flex_chunk): covered over assembly length, summed over the taxon's assemblies and contigs."""
    keys = ["taxid", "asm", "acc", "asm_len"]
    cov = covered_lengths(best, keys)
    share = F.col("covered") / F.col("asm_len")
    pick = lambda k: F.sum(F.when(F.col("kind") == k, share).otherwise(0.0))
    return cov.groupBy("taxid").agg(pick("span").alias("breadth"), pick("fixed").alias("fixed_chunk"), pick("flex").alias("flex_chunk"))


def strain_coverage(kept: DataFrame, refs: DataFrame) -> DataFrame:
    """(taxid, breadth, fixed_chunk, flex_chunk, num_flex_chunks, asm_length): of all kept alignments, summed per assembly,
    capped at 1, then the best assembly of each strain and species id."""
    keys = ["asm", "acc", "asm_len"]
    cov = covered_lengths(kept, keys)
    share = F.col("covered") / F.greatest(F.col("asm_len"), F.lit(1.0))
    pick = lambda k: F.least(F.sum(F.when(F.col("kind") == k, share).otherwise(0.0)), F.lit(1.0))
    by_asm = cov.groupBy("asm").agg(pick("span").alias("breadth"), pick("fixed").alias("fixed_chunk"), pick("flex").alias("flex_chunk"))
    islands = merged_islands(kept, ["asm", "acc"], "flex").groupBy("asm", "acc").agg(F.count(F.lit(1)).alias("n")).groupBy("asm").agg(F.max("n").alias("islands"))
    estimate = F.floor(F.greatest(F.sqrt(F.col("asm_len").cast("double")) / 2, F.lit(1.0)))
    asms = refs.groupBy("asm").agg(F.max("asm_len").alias("asm_len"))
    stats = asms.join(by_asm, "asm", "left").join(islands, "asm", "left").select("asm", "asm_len", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("breadth", "fixed_chunk", "flex_chunk")], F.greatest(estimate, F.coalesce("islands", F.lit(1))).cast("long").alias("num_flex_chunks"))
    bridge = refs.select("asm", F.explode(F.array_distinct(F.array("strain_taxid", "species_raw"))).alias("taxid")).where(F.col("taxid") > 0).distinct()
    return bridge.join(stats, "asm").groupBy("taxid").agg(*[F.max(c).alias(c) for c in ("breadth", "fixed_chunk", "flex_chunk", "num_flex_chunks")], F.max("asm_len").alias("asm_length"))


def strain_candidates(kept: DataFrame, coverage: DataFrame, names: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Passing alignments with ``taxid``: the strain's id if it has coverage enough and a name, else the species'.
    ``names``: (taxid, name, rank) of the ids in use."""
    ok = coverage.where(F.col("breadth") >= cfg.min_breadth).join(names.where(F.col("name").isNotNull()), "taxid").select(F.col("taxid").alias("_t"))
    passing = kept.where(species_ok(cfg))
    first, second = ok.withColumnRenamed("_t", "_first"), ok.withColumnRenamed("_t", "_second")
    primary = F.when(F.col("strain_taxid") > 0, F.col("strain_taxid")).otherwise(F.col("species_raw"))
    j = passing.withColumn("_p", primary).join(first, F.col("_p") == F.col("_first"), "left").join(second, F.col("species_raw") == F.col("_second"), "left")
    return j.withColumn("taxid", F.coalesce("_first", "_second")).where(F.col("taxid").isNotNull()).drop("_p", "_first", "_second")
