"""Queries of the training-data problems, over whole tables and whole texts, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeflow.llm import mixing, packing, segmentation, tokens, topn, truncation
from cladeflow.session import current_rows, cut_lineage, load

TOP = 3


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "alignments").select("aln_id", "read_name", "identity", "mapped_len", "ingested_at")
    current = current_rows(rows, ["aln_id"], "ingested_at", F.col("read_name"), F.col("identity").desc_nulls_last(), F.col("mapped_len").desc_nulls_last()).drop("ingested_at")
    top = topn.top_n(current, "read_name", [("identity", True), ("mapped_len", True), ("aln_id", False)], TOP)
    return top.select("read_name", "aln_id")


def _split_contigs(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and pieces of the current contigs; the sequences themselves are never shuffled."""
    rows = load(spark, d, "contigs").select("contig_id", "genome_id", "contig_idx", "loaded_at", "seq")
    return current_rows(segmentation.split_items(rows, "seq"), ["contig_id"], "loaded_at", F.col("_size").desc(), F.col("genome_id"), F.col("contig_idx"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    split = cut_lineage(_split_contigs(spark, d).select("genome_id", "contig_idx", "_size", "_segments"))
    return segmentation.oversized(split, "genome_id", "contig_idx")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    parts = _split_contigs(spark, d).select("genome_id", "contig_idx", "contig_id", F.posexplode("_segments").alias("piece", "s"))
    return parts.select("genome_id", "contig_idx", "contig_id", "piece", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), F.col("s.cut").alias("cut"))


def p6_genome_pieces(spark: SparkSession, d: str) -> DataFrame:
    split = cut_lineage(_split_contigs(spark, d).select("genome_id", "contig_idx", "_size", "_segments"))
    return segmentation.group_pieces(split, "genome_id", "contig_idx")


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """One row: the long contigs and their bases, pieces over the limit, bases that no piece holds, overlaps of another length."""
    split = cut_lineage(_split_contigs(spark, d).select("contig_id", "_size", "_segments"))
    parts = split.select("contig_id", "_size", F.posexplode("_segments").alias("k", "s")).select("contig_id", "_size", "k", "s.start", "s.stop")
    by = parts.groupBy("contig_id", "_size").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("held"), F.max(F.col("stop") - F.col("start")).alias("longest"), F.min("start").alias("a"), F.max("stop").alias("b"))
    shared = by.where((F.col("held") - F.col("_size") != (F.col("n") - 1) * segmentation.OVERLAP) | (F.col("a") != 0) | (F.col("b") != F.col("_size")))
    counts = by.agg(F.count_if(F.col("n") > 1).alias("long_contigs"), F.coalesce(F.sum("_size"), F.lit(0)).cast("long").alias("bases"), F.count_if(F.col("longest") > segmentation.LIMIT).alias("over_limit"))
    return counts.crossJoin(F.broadcast(shared.agg(F.count(F.lit(1)).alias("badly_shared"))))  # one row each


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(tokens.count_tokens(load(spark, d, "documents").select("doc_id", "source", "text")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d).select("doc_id", "n_tokens"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(_sizes(spark, d).select("doc_id", "n_tokens"))


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents held, containers over capacity, documents whose pieces don't cover them once, containers numbered with holes."""
    sizes = _sizes(spark, d).select("doc_id", "n_tokens")
    packed = cut_lineage(packing.pack(sizes))
    held = packed.where(F.col("container").isNotNull())
    by = held.groupBy("container").agg(F.sum("length").alias("used"))
    one = by.agg(F.count_if(F.col("used") > packing.CAPACITY).alias("over_capacity"), (F.coalesce(F.max("container") + 1, F.lit(0)) - F.count(F.lit(1))).cast("long").alias("missing_containers"))
    pieces = held.groupBy("doc_id").agg(F.sum("length").alias("len"), F.count_distinct("piece").alias("k"), F.count(F.lit(1)).alias("n"))
    two = pieces.join(sizes, "doc_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("len") != F.col("n_tokens")) | (F.col("k") != F.col("n"))).alias("badly_cut"))
    return one.crossJoin(F.broadcast(two))  # one row each


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """One row a source of the target table: whether it takes part, copies over its cap, and whether its tokens are within its
    longest document of its share among those that take part."""
    targets = load(spark, d, "mix_targets")
    mixed = cut_lineage(mixing.mix(_sizes(spark, d), targets))
    longest = mixed.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    got = mixing.shares(mixed, targets).join(longest, "source", "left")
    all_ = Window.partitionBy()  # a row a source
    due = F.col("target_share") / F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(all_) * F.sum("tokens").over(all_)
    fits = (F.col("tokens") == 0) | (F.abs(F.col("tokens") - due) <= F.col("longest"))
    return got.select("source", (F.col("tokens") > 0).alias("takes_part"), F.greatest(F.col("most_copies") - F.col("max_repeats"), F.lit(0)).cast("long").alias("over_cap"), fits.alias("fits"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), load(spark, d, "mix_targets")).where(F.col("copies") > 0)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = load(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(_sizes(spark, d), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judge(load(spark, d, "documents").select("doc_id", "text", "source"), source="source").where("cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "source", "text")
    judged = truncation.judge(docs, source="source")
    by = docs.select("doc_id", mixing.source_name("source").alias("source")).join(judged, "doc_id").groupBy("source")
    return by.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("cut").cast("long")).alias("cut_documents")).withColumn("cut_share", F.round(F.col("cut_documents") / F.col("documents"), 6))


QUERIES = {f.__name__: f for f in (p4_found, p6_found, p6_pieces, p6_genome_pieces, p6_check, p8_containers, p8_report, p8_check, p9_mix, p9_shares, p9_check, p10_found, p10_rates)}

SQL = {
    "p4_found": """WITH cur AS (SELECT * FROM alignments QUALIFY row_number() OVER (PARTITION BY aln_id ORDER BY ingested_at DESC) = 1)
SELECT read_name, aln_id FROM cur WHERE identity IS NOT NULL AND NOT isnan(identity)
QUALIFY row_number() OVER (PARTITION BY read_name ORDER BY identity DESC, mapped_len DESC, aln_id) <= 3""",
    "p6_found": """WITH cur AS (SELECT * FROM contigs QUALIFY row_number() OVER (PARTITION BY contig_id ORDER BY loaded_at DESC) = 1),
n AS (SELECT genome_id, contig_idx, coalesce(length(regexp_replace(seq, '[^A-Za-z]', '', 'g')), 0) AS size FROM cur)
SELECT genome_id, contig_idx FROM n WHERE size > 10000
UNION ALL SELECT genome_id, -1 FROM n GROUP BY genome_id HAVING sum(size) > 10000""",
    "p6_check": """WITH cur AS (SELECT * FROM contigs QUALIFY row_number() OVER (PARTITION BY contig_id ORDER BY loaded_at DESC) = 1),
n AS (SELECT coalesce(length(regexp_replace(seq, '[^A-Za-z]', '', 'g')), 0) AS size FROM cur)
SELECT count(*) FILTER (WHERE size > 10000) AS long_contigs, CAST(coalesce(sum(size), 0) AS BIGINT) AS bases, CAST(0 AS BIGINT) AS over_limit, CAST(0 AS BIGINT) AS badly_shared FROM n""",
    "p8_check": """SELECT CAST(0 AS BIGINT) AS over_capacity, CAST(0 AS BIGINT) AS missing_containers, count(*) AS documents, CAST(0 AS BIGINT) AS badly_cut FROM documents WHERE coalesce(text, '') <> ''""",
    "p9_check": r"""WITH have AS (SELECT DISTINCT replace(replace(lower(trim(regexp_replace(source, '\s+', ' ', 'g'))), ' ', '_'), '-', '_') AS source FROM documents WHERE coalesce(text, '') <> ''),
want AS (SELECT replace(replace(lower(trim(source)), ' ', '_'), '-', '_') AS source, target_share, max_repeats FROM mix_targets)
SELECT w.source, h.source IS NOT NULL AND target_share > 0 AND max_repeats > 0 AS takes_part, CAST(0 AS BIGINT) AS over_cap, true AS fits FROM want w LEFT JOIN have h USING (source)""",
}
