"""SAM lines to alignments: one projection, one join with the reference dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.config import ProfileConfig
from cladeflow.functions.cigar import cigar_stats
from cladeflow.plans import taxa
from cladeflow.sources.tables import Taxonomy

QC_FAIL, UNMAPPED, FIRST_MATE = 0x200, 0x4, 0x40


def reference_lines(header: DataFrame) -> DataFrame:
    """(ref_name, ref_len, ord) of the @SQ lines that have both a name and a length; a length that is no number is an error."""
    tag = lambda t: F.get(F.filter(F.split("value", "\t"), lambda x: x.startswith(t)), F.lit(0))
    rows = header.select(tag("SN:").alias("sn"), tag("LN:").alias("ln"), F.col("ordinal").alias("ord"))
    return rows.where(F.col("sn").isNotNull() & F.col("ln").isNotNull()).select(F.expr("substring(sn, 4)").alias("ref_name"), F.expr("substring(ln, 4)").cast("long").alias("ref_len"), "ord")


def name_fields(name: str = "ref_name") -> dict[str, Column]:
    """What a reference name says: asm|taxid|species taxid|accession|genome size[|sampled size]."""
    part = lambda k: F.get(F.split(name, r"\|"), F.lit(k))
    number = lambda k: part(k).try_cast("long")
    return {"asm": part(0), "strain_taxid": number(1), "species_raw": number(2), "acc": part(3), "genome_size": number(4), "sampled_size": number(5), "n_fields": F.size(F.split(name, r"\|"))}


def reference_dim(refs: DataFrame, tax: Taxonomy | None = None, lineage: DataFrame | None = None, truncated_flank: bool = False) -> DataFrame:
    """One row a reference, everything that depends on the reference alone: the assembly's summed length, the flexible
    flank, the species (nearest species ancestor, else as given) and the genus."""
    rows = refs.select("ref_name", "ref_len", "ord", *[c.alias(n) for n, c in name_fields().items()])
    lengths = rows.groupBy("asm").agg(F.sum("ref_len").alias("asm_len"))
    rows = rows.join(lengths, "asm")
    root = F.sqrt(F.col("asm_len").cast("double"))
    flank = F.floor(root) if truncated_flank else F.floor(root + 0.5)
    rows = rows.withColumn("flex_flank", F.greatest(flank, F.lit(1)).cast("long"))
    if tax is None:
        return rows.withColumn("species_taxid", F.col("species_raw")).withColumn("genus_taxid", F.lit(None).cast("long"))
    distinct = rows.where(F.col("species_raw").isNotNull()).select("species_raw").distinct()
    return rows.join(taxa.species_and_genus(distinct, "species_raw", tax, lineage), "species_raw", "left")


def database_is_subsampled(refs: DataFrame) -> bool:
    first = refs.orderBy("ord").limit(1).select(F.size(F.split("ref_name", r"\|")).alias("n")).first()
    return first is not None and first["n"] == 6


def scaling(refs: DataFrame) -> DataFrame:
    """(taxid, scale): genome size over sampled size where less was sampled; for an id in several names the first holds."""
    rows = refs.select("ord", *[c.alias(n) for n, c in name_fields().items()])
    good = rows.where((F.col("n_fields") >= 6) & (F.col("sampled_size") > 0) & (F.col("sampled_size") < F.col("genome_size")))
    ids = good.select("ord", (F.col("genome_size") / F.col("sampled_size")).alias("scale"), F.explode(F.array_distinct(F.array("strain_taxid", "species_raw"))).alias("taxid"))
    return ids.where(F.col("taxid").isNotNull()).groupBy("taxid").agg(F.min_by("scale", "ord").alias("scale"))


def split_records(lines: DataFrame, paired: bool = False) -> DataFrame:
    """(read_name, flag, ref_name, pos, cigar, rnext, pnext, seq_len, ordinal); lines of under 6 fields and reads that
    failed quality control don't come out. The sequence is reduced to its length here, before any shuffle."""
    part = lambda k: F.get("c", F.lit(k))
    rows = lines.select(F.split("value", "\t").alias("c"), "ordinal").where(F.size("c") >= 6)
    place = lambda k, default: F.greatest(F.coalesce(part(k).try_cast("long"), F.lit(default)), F.lit(1))
    name = F.regexp_replace(part(0), r"/[^/]*$", "") if paired else part(0)
    flag = F.coalesce(part(1).try_cast("int"), F.lit(0))
    out = rows.select(name.alias("read_name"), flag.alias("flag"), part(2).alias("ref_name"), place(3, 1).alias("pos"), part(5).alias("cigar"), F.coalesce(part(6), F.lit("*")).alias("rnext"), place(7, 0).alias("pnext"), F.length(F.coalesce(part(9), F.lit(""))).cast("long").alias("seq_len"), "ordinal")
    return out.where(F.col("flag").bitwiseAND(QC_FAIL) == 0)


def intervals(start: Column, mapped_len: Column, ref_len: Column, flank: int, flex: Column) -> dict[str, Column]:
    """The aligned span and its two widened versions, half-open and 1-based, clipped to the reference."""
    end = ref_len + 1
    s = F.least(start, ref_len)
    e = F.least(s + mapped_len, end)
    middle = s + F.floor((e - s) / 2)
    pair = lambda a, b: F.struct(a.cast("long").alias("s"), b.cast("long").alias("e"))
    return {"span": pair(s, e), "fixed": pair(F.greatest(s - flank, F.lit(1)), F.least(e + flank, end)), "flex": pair(F.greatest(middle - flex, F.lit(1)), F.least(middle + flex, end))}


def parse_alignments(records: DataFrame, refs: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """Every record with ``counted`` (an alignment of the run's totals) and ``kept`` (it takes part in the profile).
    Records that aren't kept stay: their reads count."""
    dim = refs.select("ref_name", "ref_len", "asm", "acc", "strain_taxid", "species_raw", "species_taxid", "genus_taxid", "asm_len", "flex_flank")
    j = records.join(dim, "ref_name", "left")
    paired = F.lit(cfg.is_paired)
    mapped = (F.col("ref_name") != "*") & (F.col("cigar") != "*") & ~(paired & (F.col("rnext") != "="))
    usable = mapped & (F.coalesce(F.col("ref_len"), F.lit(0)) > 0) & (F.col("seq_len") > 0) & (F.coalesce("asm", F.lit("")) != "") & F.col("species_taxid").isNotNull() & (F.coalesce(F.col("asm_len"), F.lit(0)) > 0)
    # aligned, but to a reference without a usable name, length or species
    lost = mapped & (F.col("seq_len") > 0) & ~usable
    counted = usable & ~(paired & (F.col("flag").bitwiseAND(UNMAPPED) != 0))
    kept = usable & ~(paired & (F.col("flag").bitwiseAND(FIRST_MATE) == 0))
    start = F.least("pos", "pnext") if cfg.is_paired else F.col("pos")
    shapes = intervals(start, F.col("seq_len"), F.col("ref_len"), cfg.chunk_flank, F.col("flex_flank"))
    stats = F.when(kept, cigar_stats(F.col("cigar")))
    out = j.select("read_name", "ordinal", counted.alias("counted"), kept.alias("kept"), F.coalesce(lost, F.lit(False)).alias("lost_reference"), "asm", "acc", "strain_taxid", "species_raw", "species_taxid", "genus_taxid", F.col("asm_len").cast("double").alias("asm_len"), F.col("seq_len").alias("mapped_len"), stats.alias("_c"), *[F.when(kept, c).alias(n) for n, c in shapes.items()])
    return out.select("*", F.col("_c.identity").alias("identity"), F.col("_c.fraction").alias("fraction")).drop("_c")


def run_totals(parsed: DataFrame) -> DataFrame:
    """One row: distinct reads, reads with a kept alignment, counted alignments."""
    by_read = parsed.groupBy("read_name").agg(F.max(F.col("kept").cast("int")).alias("k"), F.sum(F.col("counted").cast("long")).alias("n"))
    return by_read.agg(F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("aligned_reads"), F.coalesce(F.sum("n"), F.lit(0)).alias("alignments"))


def filter_stats(parsed: DataFrame, cfg: ProfileConfig) -> DataFrame:
    """One row: kept alignments evaluated, passed, and filtered by the first threshold they miss."""
    k = parsed.where("kept")
    by_len, by_id, by_fraction = F.col("mapped_len") < cfg.mapped_len, F.col("identity") < cfg.identity, F.col("fraction") < cfg.fraction
    count = lambda c: F.count_if(c)
    return k.agg(F.count(F.lit(1)).alias("evaluated"), count(~by_len & ~by_id & ~by_fraction).alias("passed"), count(by_len).alias("filtered_length"), count(~by_len & by_id).alias("filtered_identity"), count(~by_len & ~by_id & by_fraction).alias("filtered_fraction"))


def skipped_references(parsed: DataFrame) -> DataFrame:
    """One row: alignments whose reference has no assembly, length or species to count them for."""
    lost = F.col("lost_reference") if "lost_reference" in parsed.columns else F.lit(False)
    return parsed.agg(F.count_if(lost).alias("skipped_reference"))
