"""Fractional genomes: for each large genome evenly spread random segments that add up to a share of its length.

Small genomes (under ``SMALL_GENOME``) go through whole. Otherwise every contig of at least a segment's length is cut
into as many equal partitions as segments fit, each with one candidate at a random place; the genome's quota is
shared among its contigs by largest remainder, and each takes evenly spaced candidates. Genomes without candidates enough
take their longest contigs. Randomness is a hash of seed, contig and partition: the same on any cluster.

All of it works on lengths; sequences are cut last, by a join with the segments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMALL_GENOME = 500_000


@dataclass(frozen=True)
class SubsampleParams:
    fraction: float
    seed: int = 42
    segment_length: int = 50_000
    min_length: int = 3_000

    def __post_init__(self) -> None:
        if not 0 < self.fraction < 1:
            raise ValueError("the fraction must lie between 0 and 1")
        if self.segment_length < 1 or self.min_length < 0:
            raise ValueError("lengths must be positive")


def candidates(contigs: DataFrame, p: SubsampleParams, small: int = SMALL_GENOME) -> DataFrame:
    """(genome_id, genome_size, contig_idx, slot, slots, start) of large genomes; starts are 1-based. ``contigs``: (genome_id,
    genome_size, contig_idx, len)."""
    long = contigs.where((F.col("genome_size") >= small) & (F.col("len") >= p.segment_length))
    long = long.withColumn("slots", F.floor(F.col("len") / p.segment_length)).withColumn("_part", F.floor(F.col("len") / F.col("slots")))
    each = long.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    first = F.col("slot") * F.col("_part")
    stop = F.when(F.col("slot") == F.col("slots") - 1, F.col("len")).otherwise(first + F.col("_part"))
    room = stop - p.segment_length - first + 1
    u = F.pmod(F.xxhash64(F.lit(p.seed), "genome_id", "contig_idx", "slot"), F.greatest(room, F.lit(1)))
    return each.where(room > 0).select("genome_id", "genome_size", "contig_idx", "slot", "slots", (first + u + 1).alias("start"))


def quotas(contigs: DataFrame, p: SubsampleParams, small: int = SMALL_GENOME) -> DataFrame:
    """(genome_id, contig_idx, slots, quota, enough): how many candidates each contig gives. ``enough`` is false for
    genomes whose candidates don't reach the target."""
    c = contigs.where((F.col("genome_size") >= small) & (F.col("len") >= p.segment_length)).withColumn("slots", F.floor(F.col("len") / p.segment_length))
    genome = Window.partitionBy("genome_id")
    c = c.withColumn("_total", F.sum("slots").over(genome)).withColumn("_goal", F.greatest(F.ceil(F.lit(p.fraction) * F.col("genome_size")), F.lit(1)))
    c = c.withColumn("enough", F.col("_total") * p.segment_length >= F.col("_goal"))
    c = c.withColumn("_want", F.least(F.ceil(F.col("_goal") / p.segment_length), F.col("_total")))
    exact = F.col("slots") / F.col("_total") * F.col("_want")
    c = c.withColumn("_floor", F.least(F.floor(exact), F.col("slots"))).withColumn("_rest", exact - F.col("_floor"))
    c = c.withColumn("_open", F.col("_want") - F.sum("_floor").over(genome))
    room = F.col("_floor") < F.col("slots")
    rank = F.row_number().over(genome.orderBy(room.desc(), F.col("_rest").desc(), F.col("contig_idx")))
    quota = F.col("_floor") + F.when(room & (rank <= F.col("_open")), 1).otherwise(0)
    return c.select("genome_id", "contig_idx", "slots", quota.cast("long").alias("quota"), "enough")


def even_picks(cands: DataFrame, quota: DataFrame, p: SubsampleParams) -> DataFrame:
    """(genome_id, genome_size, contig_idx, start, stop): candidate number ((j + 1) * slots) div quota - 1 for each j below the quota."""
    q = quota.where(F.col("enough") & (F.col("quota") > 0)).select("genome_id", "contig_idx", "quota")
    j = cands.join(q, ["genome_id", "contig_idx"])
    # slot s is taken iff some j satisfies the rule: iff quota * (s + 1) passes a multiple of slots
    taken = F.ceil((F.col("slot") + 2) * F.col("quota") / F.col("slots")) > F.ceil((F.col("slot") + 1) * F.col("quota") / F.col("slots"))
    return j.where(taken).select("genome_id", "genome_size", "contig_idx", "start", (F.col("start") + p.segment_length - 1).alias("stop"))


def longest_contigs(contigs: DataFrame, quota: DataFrame, p: SubsampleParams, small: int = SMALL_GENOME) -> DataFrame:
    """Segments of large genomes without candidates enough: whole contigs, the longest first, the last one cut to what is missing.
    In genomes of over ten times the least length, short contigs only serve when the others don't suffice."""
    enough = quota.where("enough").select("genome_id").distinct()
    rows = contigs.where((F.col("genome_size") >= small) & (F.col("len") > 0)).join(enough, "genome_id", "left_anti")
    rows = rows.withColumn("_goal", F.greatest(F.ceil(F.lit(p.fraction) * F.col("genome_size")), F.lit(1)))
    short = (F.col("genome_size") > p.min_length * 10) & (F.col("len") < p.min_length)
    by = Window.partitionBy("genome_id").orderBy(short.cast("int"), F.col("len").desc(), "contig_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("len").over(by), F.lit(0))).where(F.col("_before") < F.col("_goal"))
    return rows.select("genome_id", "genome_size", "contig_idx", F.lit(1).cast("long").alias("start"), F.least(F.col("len"), F.col("_goal") - F.col("_before")).alias("stop"))


def drop_short(segments: DataFrame, min_length: int) -> DataFrame:
    """Without segments under the least length, in genomes of over ten times it - unless all of a genome's are."""
    n = F.col("stop") - F.col("start") + 1
    longest = F.max(n).over(Window.partitionBy("genome_id"))
    rows = segments.withColumn("_longest", longest)
    return rows.where((F.lit(min_length) == 0) | (F.col("genome_size") <= min_length * 10) | (F.col("_longest") < min_length) | (n >= min_length)).drop("_longest")


def segments(contigs: DataFrame, p: SubsampleParams, small: int = SMALL_GENOME) -> DataFrame:
    """(genome_id, genome_size, contig_idx, start, stop), 1-based and inclusive."""
    whole = contigs.where((F.col("genome_size") < small) & (F.col("len") > 0)).select("genome_id", "genome_size", "contig_idx", F.lit(1).cast("long").alias("start"), F.col("len").alias("stop"))
    q = quotas(contigs, p, small)
    picked = even_picks(candidates(contigs, p, small), q, p)
    return drop_short(whole.unionByName(picked).unionByName(longest_contigs(contigs, q, p, small)), p.min_length)


def subsample(genomes: DataFrame, p: SubsampleParams, small: int = SMALL_GENOME) -> DataFrame:
    """(genome_id, contig_idx, start, header, seq) from FASTA contigs: field 3 gains the stretch, field 4 is the genome's size, field 5
    what was sampled of it."""
    lengths = genomes.select("genome_id", "genome_size", "contig_idx", F.length("seq").cast("long").alias("len"))
    chosen = segments(lengths, p, small).drop("genome_size")
    total = F.sum(F.col("stop") - F.col("start") + 1).over(Window.partitionBy("genome_id"))
    j = genomes.join(chosen.withColumn("_total", total), ["genome_id", "contig_idx"])
    f = lambda k: F.get("fields", F.lit(k))
    header = F.concat_ws("|", f(0), f(1), f(2), F.concat(f(3), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string")), F.col("genome_size").cast("string"), F.col("_total").cast("string"))
    return j.select("genome_id", "contig_idx", "start", header.alias("header"), F.substring("seq", F.col("start").cast("int"), (F.col("stop") - F.col("start") + 1).cast("int")).alias("seq"))
