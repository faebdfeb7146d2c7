"""Queries of the profiling operators over the alignment tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow import config
from cladeflow.config import ProfileConfig
from cladeflow.functions import cigar, render, stats
from cladeflow.plans import ambiguity, assign, em, parse, profile, subsample, taxa
from cladeflow.queries.problems import current_refs
from cladeflow.session import current_rows, cut_lineage, load, store
from cladeflow.sources.tables import Taxonomy

CFG = ProfileConfig(identity=0.95, mapped_len=50, fraction=0.6, genus_identity=0.80)
STRAIN = ProfileConfig(identity=0.95, mapped_len=50, fraction=0.6, strain=True)
EM_STEPS = 3


def taxonomy(spark: SparkSession, d: str) -> Taxonomy:
    nodes = load(spark, d, "tax_nodes").where(F.col("taxid").isNotNull())
    nodes = current_rows(nodes, ["taxid"], "loaded_at", F.col("parent_taxid").asc_nulls_last(), F.col("rank"), F.col("sci_name"))
    merged = load(spark, d, "tax_merged").groupBy("old_taxid").agg(F.min("new_taxid").alias("new_taxid"))
    return Taxonomy(nodes.select("taxid", "parent_taxid", "rank"), nodes.where(F.col("sci_name").isNotNull()).select("taxid", "sci_name"), merged, load(spark, d, "tax_deleted").select("taxid").distinct())


def lineages(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(taxa.lineages(taxonomy(spark, d)))


def current_alignments(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "alignments").drop("aligned_at")
    return current_rows(a, ["aln_id"], "ingested_at", F.col("read_name"), F.col("identity").desc_nulls_last(), F.col("mapped_len").desc_nulls_last())


def parsed(spark: SparkSession, d: str, with_taxonomy: bool = True, line: DataFrame | None = None) -> DataFrame:
    """The table as parsed alignments: a row that lacks what the profile needs isn't kept, but its read counts."""
    a = current_alignments(spark, d)
    ok = F.col("species_taxid").isNotNull() & (F.coalesce("asm", F.lit("")) != "") & F.col("identity").isNotNull() & ~F.isnan("identity") & (F.coalesce("asm_len", F.lit(0.0)) > 0) & F.col("span").isNotNull()
    fields = parse.name_fields()
    length, s, e = F.col("asm_len").cast("long"), F.col("span.s"), F.col("span.e")
    flex = F.greatest(F.floor(F.sqrt("asm_len") + 0.5), F.lit(1)).cast("long")
    middle = s + F.floor((e - s) / 2)
    pair = lambda x, y: F.when(ok, F.struct(x.cast("long").alias("s"), y.cast("long").alias("e")))
    out = a.select("read_name", F.col("aln_id").alias("ordinal"), ok.alias("kept"), F.lit(True).alias("counted"), "asm", "acc", fields["strain_taxid"].alias("strain_taxid"), F.col("species_taxid").alias("species_raw"), "asm_len", "identity", "fraction", "mapped_len", pair(s, e).alias("span"), pair(F.greatest(s - 2000, F.lit(1)), F.least(e + 2000, length + 1)).alias("fixed"), pair(F.greatest(middle - flex, F.lit(1)), F.least(middle + flex, length + 1)).alias("flex"))
    if not with_taxonomy:
        return out.withColumn("species_taxid", F.col("species_raw")).withColumn("genus_taxid", F.lit(None).cast("long"))
    tax = taxonomy(spark, d)
    known = out.where(F.col("species_raw").isNotNull()).select("species_raw").distinct()
    return out.join(taxa.species_and_genus(known, "species_raw", tax, lineages(spark, d) if line is None else line), "species_raw", "left")


def refs_dim(spark: SparkSession, d: str) -> DataFrame:
    lines = current_refs(spark, d).where(F.col("length").isNotNull() & F.col("ref_name").isNotNull()).select("ref_name", F.col("length").alias("ref_len"), F.col("ref_id").alias("ord"))
    return parse.reference_dim(lines, taxonomy(spark, d), lineages(spark, d))


def sam_lines(spark: SparkSession, d: str) -> DataFrame:
    """The alignments written as SAM text, flags and mates varied by aln_id, to be parsed again."""
    a = current_alignments(spark, d)
    flag = F.element_at(F.array(*[F.lit(x) for x in (99, 147, 0, 512, 103, 355)]), (F.col("aln_id") % 6 + 1).cast("int"))
    mate = F.element_at(F.array(F.lit("="), F.lit("="), F.lit("="), F.lit("*")), (F.col("aln_id") % 4 + 1).cast("int"))
    line = F.concat_ws("\t", "read_name", flag.cast("string"), F.coalesce("ref_name", F.lit("*")), F.col("span.s").cast("string"), F.lit("60"), F.coalesce("cigar", F.lit("*")), mate, F.greatest(F.col("span.s") - 40, F.lit(0)).cast("string"), F.lit("0"), F.expr("repeat('A', cast(mapped_len as int))"), F.lit("*"))
    return a.select(line.alias("value"), F.col("aln_id").alias("ordinal"))


PAIRED = ProfileConfig(identity=0.95, mapped_len=50, fraction=0.6, is_paired=True)


def _parsed_sam(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_alignments(parse.split_records(sam_lines(spark, d), paired=True), refs_dim(spark, d), PAIRED)


def aln_parse(spark: SparkSession, d: str) -> DataFrame:
    p = _parsed_sam(spark, d)
    flat = [F.col(f"{k}.{x}").alias(f"{k}_{x}") for k in assign.KINDS for x in ("s", "e")]
    return p.select("read_name", "ordinal", "asm", "acc", "strain_taxid", "mapped_len", "counted", "kept", *flat)


def mate_and_qc_filters(spark: SparkSession, d: str) -> DataFrame:
    p = _parsed_sam(spark, d)
    return p.groupBy("asm").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("counted").alias("n_counted"), F.count_if("kept").alias("n_kept"))


def cigar_identity(spark: SparkSession, d: str) -> DataFrame:
    a = current_alignments(spark, d).where(F.col("cigar").isNotNull()).select("aln_id", cigar.cigar_stats(F.col("cigar")).alias("c"))
    return a.select("aln_id", F.round("c.identity", 9).alias("identity"), F.col("c.matched_len").alias("matched_len"), F.round("c.fraction", 9).alias("fraction"))


def ref_dim(spark: SparkSession, d: str) -> DataFrame:
    return refs_dim(spark, d).select("ref_name", "ref_len", "asm", "acc", "strain_taxid", "species_raw", "species_taxid", "genus_taxid", "asm_len", "flex_flank", "genome_size", "sampled_size", F.col("n_fields").cast("long").alias("n_fields"))


def run_totals(spark: SparkSession, d: str) -> DataFrame:
    return parse.run_totals(parsed(spark, d, False))


def filter_stats(spark: SparkSession, d: str) -> DataFrame:
    return parse.filter_stats(parsed(spark, d, False), CFG)


def species_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = assign.candidates(parsed(spark, d).where("kept"), CFG)
    return c.groupBy("taxid").agg(F.count(F.lit(1)).alias("n"), F.sum("mapped_len").alias("sum_len"))


def genus_fallback(spark: SparkSession, d: str) -> DataFrame:
    c = assign.candidates(parsed(spark, d).where("kept"), CFG, fallback=True)
    return c.select("read_name", "ordinal", "taxid", "rank")


def best(spark: SparkSession, d: str) -> DataFrame:
    return assign.best_per_taxon(assign.candidates(parsed(spark, d).where("kept"), CFG))


def best_alignment(spark: SparkSession, d: str) -> DataFrame:
    return best(spark, d).select("read_name", "taxid", "ordinal", F.round("depth", 9).alias("depth"))


def best_alignment_strain(spark: SparkSession, d: str) -> DataFrame:
    c = assign.candidates(parsed(spark, d).where("kept"), CFG)
    return assign.best_per_taxon(c, by="depth").select("read_name", "taxid", "ordinal", F.round("depth", 9).alias("depth"))


def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return assign.merged_islands(best(spark, d), ["taxid", "asm", "acc"])


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return assign.taxon_coverage(best(spark, d))


def coverage_by_taxon(spark: SparkSession, d: str) -> DataFrame:
    return coverage(spark, d).select("taxid", *[F.round(c, 9).alias(c) for c in ("breadth", "fixed_chunk", "flex_chunk")])


def strain_cov(spark: SparkSession, d: str) -> DataFrame:
    kept = parsed(spark, d, False).where("kept")
    return assign.strain_coverage(kept, kept.select("asm", "asm_len", "strain_taxid", "species_raw").distinct())


def coverage_strain(spark: SparkSession, d: str) -> DataFrame:
    return strain_cov(spark, d).select("taxid", *[F.round(c, 9).alias(c) for c in ("breadth", "fixed_chunk", "flex_chunk")], "num_flex_chunks", F.col("asm_length").cast("long").alias("asm_length"))


def classed(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(ambiguity.with_class(best(spark, d)))


def _key(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def unambiguous_totals(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ambiguity.certain(classed(spark, d)))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[_key(c) if c == "class" else F.round(c, places).alias(c) if c in ("n", "depth", "maplen", "fraction") else F.col(c) for c in df.columns])


def ambiguity_classes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ambiguity.class_members(classed(spark, d)))


def _known(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Only even taxa count as certain here, so that classes of every kind of support arise."""
    rows = classed(spark, d)
    return cut_lineage(ambiguity.certain(rows).where(F.col("taxid") % 2 == 0)), cut_lineage(ambiguity.class_members(rows))


def _known_whole(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = classed(spark, d)
    return cut_lineage(ambiguity.certain(rows)), cut_lineage(ambiguity.class_members(rows))


def class_support(spark: SparkSession, d: str) -> DataFrame:
    return _class_support(*_known(spark, d))


def class_support_all(spark: SparkSession, d: str) -> DataFrame:
    return _class_support(*_known_whole(spark, d))


def _class_support(known: DataFrame, members: DataFrame) -> DataFrame:
    s = ambiguity.support(members, known)
    kind = F.when(F.col("n_ok") == F.col("size"), "all").when(F.col("n_ok") == 0, "none").otherwise("some")
    return s.select(_key("class"), "taxid", "ok", "n_ok", kind.alias("kind"))


def class_prune(spark: SparkSession, d: str) -> DataFrame:
    return _class_prune(*_known(spark, d))


def class_prune_all(spark: SparkSession, d: str) -> DataFrame:
    return _class_prune(*_known_whole(spark, d))


def _class_prune(known: DataFrame, members: DataFrame) -> DataFrame:
    one, rest = ambiguity.prune(ambiguity.support(members, known))
    both = rest.groupBy("class", "taxid").agg(*[F.sum(c).alias(c) for c in ("n", "depth", "maplen")]).unionByName(one.groupBy("taxid").agg(*[F.sum(c).alias(c) for c in ("n", "depth", "maplen")]).withColumn("class", F.array("taxid")))
    return _rounded(both)


def lineage(spark: SparkSession, d: str) -> DataFrame:
    return lineages(spark, d).select("taxid", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def _resolved(spark: SparkSession, d: str, rank: str) -> DataFrame:
    tax = taxonomy(spark, d)
    ids = current_refs(spark, d).select(F.col("fallback_taxid").alias("taxid")).where(F.col("taxid").isNotNull()).distinct()
    return taxa.of_ids(ids, "taxid", tax, taxa.rank_ancestors(lineages(spark, d), tax, rank), "found")


def species_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d, "species").select("taxid", F.coalesce("found", "taxid").alias("species_taxid"))


def genus_resolve(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d, "genus").select("taxid", F.col("found").alias("genus_taxid"))


def majority_lca(spark: SparkSession, d: str) -> DataFrame:
    """The majority ancestor of the references' taxids of each assembly."""
    refs = current_refs(spark, d).where(F.col("asm").isNotNull())
    ids = refs.select(F.col("asm").alias("class_id"), F.explode(F.array("taxid", "fallback_taxid")).alias("taxid")).where(F.col("taxid") > 0).distinct()
    return taxa.majority_lca(ids, lineages(spark, d), taxonomy(spark, d)).select(F.col("class_id").alias("asm"), "lca")


def taxon_names_merged(spark: SparkSession, d: str) -> DataFrame:
    ids = current_refs(spark, d).select("taxid").where(F.col("taxid").isNotNull()).distinct()
    return taxa.labels(ids, "taxid", taxonomy(spark, d)).select("taxid", "name", "rank")


def _em(spark: SparkSession, d: str, **how) -> em.EmResult:
    rows = classed(spark, d)
    known, members = cut_lineage(ambiguity.certain(rows)), cut_lineage(ambiguity.class_members(rows))
    marked = ambiguity.support(members, known)
    whole = marked.where(F.col("n_ok") == F.col("size")).select("class", "taxid", "n", "depth", "maplen")
    return em.share_out(known, whole, **how)


def em_fixed_iter(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_em(spark, d, max_iter=EM_STEPS, tol=-1.0).state)


def em_profile(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_em(spark, d).state)


def _resolve(spark: SparkSession, d: str) -> tuple[DataFrame, ambiguity.Resolved]:
    """(members of all classes with their support, what becomes of them)."""
    tax, line = taxonomy(spark, d), lineages(spark, d)
    one = cut_lineage(assign.best_per_taxon(assign.candidates(parsed(spark, d, line=line).where("kept"), CFG)))
    rows = cut_lineage(ambiguity.with_class(one))
    known, members = cut_lineage(ambiguity.certain(rows)), cut_lineage(ambiguity.class_members(rows))
    return rows, ambiguity.resolve(known, members, cut_lineage(assign.taxon_coverage(one)), line, tax)


def class_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """The majority ancestors of classes without a certain member."""
    return _resolve(spark, d)[1].ancestors.select(_key("class"), F.col("lca").alias("taxid"))


def resolved_totals(spark: SparkSession, d: str) -> DataFrame:
    """What is certain once classes were pruned or went to their ancestors."""
    return _rounded(_resolve(spark, d)[1].known)


def resolved_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_resolve(spark, d)[1].coverage).select("taxid", *[F.round(c, 9).alias(c) for c in ("breadth", "fixed_chunk", "flex_chunk")])


def profile_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The profile before its filters, but for the probabilities."""
    raw = _run(spark, d, CFG).raw
    return raw.select("name", "taxid", "rank", *[F.round(c, 9).alias(c) for c in profile.FIXED])


def _strain_lines(spark: SparkSession, d: str, p: DataFrame) -> DataFrame:
    names = current_alignments(spark, d).groupBy("ref_name").agg(F.min("aln_id").alias("ord")).where(F.col("ref_name").isNotNull())
    fields = parse.name_fields()
    lines = names.select("ref_name", "ord", fields["asm"].alias("asm"), fields["strain_taxid"].alias("strain_taxid"), fields["species_raw"].alias("species_raw"))
    return lines.join(p.where("kept").groupBy("asm").agg(F.max("asm_len").alias("asm_len")), "asm")


def _run(spark: SparkSession, d: str, cfg: ProfileConfig) -> profile.Profile:
    line = lineages(spark, d)
    p = cut_lineage(parsed(spark, d, line=line))
    lines = current_refs(spark, d).where(F.col("length").isNotNull()).select("ref_name", F.col("ref_id").alias("ord"))
    if cfg.strain:
        lines = _strain_lines(spark, d, p)
    return profile.run_profile(p, cut_lineage(lines), taxonomy(spark, d), cfg, lineage=line, stored=True)


def profile_full(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, CFG).final


def profile_raw(spark: SparkSession, d: str) -> DataFrame:
    return profile.rendered(_run(spark, d, CFG).raw)


def profile_strain(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, STRAIN).raw


def profile_strain_final(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, STRAIN).final


def classification_strain(spark: SparkSession, d: str) -> DataFrame:
    """Also where references are sampled, which a run writes no classification for."""
    tax, line = taxonomy(spark, d), lineages(spark, d)
    p = cut_lineage(parsed(spark, d, line=line))
    parts = profile.strain_parts(p.where("kept"), cut_lineage(_strain_lines(spark, d, p)), tax, STRAIN, line)
    return profile.strain_classification(parts.classed, parts.em, parts.ancestors, tax, parts.classes)


def classification(spark: SparkSession, d: str) -> DataFrame:
    tax, line = taxonomy(spark, d), lineages(spark, d)
    one = store(assign.best_per_taxon(assign.candidates(parsed(spark, d, line=line).where("kept"), CFG)))
    rows, classes = ambiguity.numbered(one)
    known, members = store(ambiguity.certain(rows)), store(ambiguity.class_members(rows))
    marked = ambiguity.support(members, known)
    r = ambiguity.resolve(known, members, store(assign.taxon_coverage(one)), line, tax)
    whole = marked.where(F.col("n_ok") == F.col("size")).select("class").distinct()
    return profile.classification(rows, em.share_out(r.known, r.members), whole, r.ancestors, tax, classes)


def expected_breadth(spark: SparkSession, d: str) -> DataFrame:
    k = _known_all(spark, d)
    length = stats.genome_length(F.col("maplen"), F.col("depth"))
    chunks = stats.flex_chunks(length)
    return k.select("taxid", F.round(stats.expected_breadth(F.col("depth"), F.col("n"), clamp=True), 6).alias("expected_breadth"), F.round(length, 4).alias("genome_len"), chunks.alias("chunks"), F.round(stats.expected_flex(chunks, F.col("n")), 6).alias("expected_flex"))


def _known_all(spark: SparkSession, d: str) -> DataFrame:
    return ambiguity.certain(classed(spark, d))


def _pvalues(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """p-values of every contig's read counts, as cells and balls of one kind of size each."""
    by = parsed(spark, d, False).where("kept").groupBy("asm", "acc").agg(F.count(F.lit(1)).cast("long").alias("m"), F.sum("mapped_len").alias("len"))
    cells = {"exact": F.lit(50) + F.col("len") % 100, "normal": F.lit(4000) + F.col("len") % 1000, "binomial": F.lit(200_000) + F.col("len")}[kind]
    reads = {"exact": F.least("m", F.lit(40)), "normal": F.col("m") + 2000, "binomial": F.col("m")}[kind]
    rows = by.select("asm", "acc", reads.cast("long").alias("m"), cells.cast("long").alias("cells"))
    expect = 1 - F.pow(1 - 1 / F.col("cells"), F.col("m"))
    rows = rows.withColumn("expected", expect).withColumn("observed", F.floor(F.col("expected") * F.col("cells") * 0.9) / F.col("cells"))
    p = stats.pvalue_udf("m", F.col("m") / F.col("cells"), "observed", "expected", F.lit(False))
    return rows.select("asm", "acc", "m", "cells", F.round(F.col("observed") * F.col("cells")).cast("long").alias("k"), F.round(p, 6).alias("p"))


def pvalue_exact(spark: SparkSession, d: str) -> DataFrame:
    return _pvalues(spark, d, "exact")


def pvalue_normal(spark: SparkSession, d: str) -> DataFrame:
    return _pvalues(spark, d, "normal")


def pvalue_binomial(spark: SparkSession, d: str) -> DataFrame:
    return _pvalues(spark, d, "binomial")


def chunk_threshold(spark: SparkSession, d: str) -> DataFrame:
    t = parse.run_totals(parsed(spark, d, False)).first()
    totals = config.RunTotals(t["reads"], t["aligned_reads"], t["alignments"])
    rows = [(s, low, float(round(config.chunk_threshold(totals.reads, s == "illumina", low), 9))) for s in ("illumina", "nanopore") for low in (False, True)]
    return spark.createDataFrame(rows, "sequencer string, lowbiomass boolean, threshold double")


def _filter_input(spark: SparkSession, d: str) -> DataFrame:
    """Observed and expected values of all taxa, as printed."""
    k, c = _known_all(spark, d), coverage(spark, d)
    chunks = stats.flex_chunks(stats.genome_length(F.col("maplen"), F.col("depth")))
    rows = k.join(c, "taxid").select("taxid", F.lit("species").alias("rank"), F.least("breadth", F.lit(1.0)).alias("breadth"), stats.expected_breadth(F.col("depth"), F.col("n"), clamp=True).alias("expected_breadth"), F.least("flex_chunk", F.lit(1.0)).alias("flex_chunk"), stats.expected_flex(chunks, F.col("n")).alias("expected_flex"), "depth")
    return rows.select("taxid", "rank", "depth", *[render.round5(F.col(x)).alias(x) for x in ("breadth", "expected_breadth", "flex_chunk", "expected_flex")])


def ratio_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _filter_input(spark, d)
    return rows.select("taxid", profile.ratio_ok(CFG, "breadth", "expected_breadth", None).alias("breadth_ok"), profile.ratio_ok(CFG, "flex_chunk", "expected_flex", None).alias("flex_ok"))


def pvalue_filter(spark: SparkSession, d: str) -> DataFrame:
    """The truth table of the filter, on the mean identities of assemblies as stand-ins for p-values."""
    a = parsed(spark, d, False).where("kept").groupBy("asm").agg(F.min("identity").alias("lo"), F.max("identity").alias("hi"))
    tiny = lambda c: F.when(F.col(c) < 0.8, None).otherwise((1 - F.col(c)) * 1e-4)
    rows = a.select("asm", F.lit("species").alias("rank"), tiny("lo").alias("cov_prob"), tiny("hi").alias("chunk_prob"))
    strict = ProfileConfig(strict=True)
    return rows.select("asm", profile.pvalue_ok(CFG).alias("default_ok"), profile.pvalue_ok(strict).alias("strict_ok"))


def abundance_renorm(spark: SparkSession, d: str) -> DataFrame:
    rows = _known_all(spark, d).select("taxid", render.round5(F.col("depth")).alias("abundance"))
    return profile.renormalise(rows).select("taxid", "abundance")


def _hosts(spark: SparkSession, d: str) -> DataFrame:
    """A host table made of the taxonomy: each species is hosted by its parent, some by nobody known."""
    n = taxonomy(spark, d).nodes.where(F.col("rank") == "species")
    unknown = F.col("taxid") % 5 == 0
    return n.select("taxid", F.when(unknown, "unknown").otherwise(F.col("parent_taxid").cast("string")).alias("host_taxids"), F.when(unknown, "unknown").otherwise(F.concat(F.lit("host "), F.col("parent_taxid").cast("string"))).alias("host_names"), F.concat(F.lit("d"), (F.col("taxid") % 7).cast("string"), F.lit(";d0")).alias("diseases"))


HOST = 2


def host_annotation(spark: SparkSession, d: str) -> DataFrame:
    rows = taxonomy(spark, d).nodes.select("taxid")
    return profile.annotate_hosts(rows, _hosts(spark, d).where(F.col("host_taxids").isNotNull()), HOST, lineages(spark, d), taxonomy(spark, d))


def subsample_scaling(spark: SparkSession, d: str) -> DataFrame:
    lines = current_refs(spark, d).where(F.col("ref_name").isNotNull()).select("ref_name", F.col("ref_id").alias("ord"))
    return parse.scaling(lines).select("taxid", F.round("scale", 9).alias("scale"))


SUB, SUB_SMALL = subsample.SubsampleParams(fraction=0.3, segment_length=1000, min_length=300), 5000


def _contig_lengths(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "contigs").select("contig_id", "genome_id", "contig_idx", "loaded_at", F.length(F.regexp_replace(F.coalesce("seq", F.lit("")), "[^A-Za-z]", "")).cast("long").alias("len"))
    c = current_rows(c, ["contig_id"], "loaded_at", F.col("len").desc())
    from pyspark.sql import Window

    return c.select("genome_id", F.sum("len").over(Window.partitionBy("genome_id")).alias("genome_size"), F.col("contig_idx").cast("long").alias("contig_idx"), "len")


def subsample_allocation(spark: SparkSession, d: str) -> DataFrame:
    return subsample.quotas(_contig_lengths(spark, d), SUB, SUB_SMALL)


def subsample_min_length(spark: SparkSession, d: str) -> DataFrame:
    c = _contig_lengths(spark, d).where(F.col("len") > 0).select("genome_id", "genome_size", "contig_idx", F.lit(1).cast("long").alias("start"), F.col("len").alias("stop"))
    return subsample.drop_short(c, 2000).select("genome_id", "contig_idx", "start", "stop")


def subsample_segments(spark: SparkSession, d: str) -> DataFrame:
    return subsample.segments(_contig_lengths(spark, d), SUB, SUB_SMALL)


QUERIES = {
    f.__name__: f
    for f in (aln_parse, mate_and_qc_filters, cigar_identity, ref_dim, run_totals, filter_stats, species_candidates, genus_fallback, best_alignment, best_alignment_strain, interval_union, coverage_by_taxon, coverage_strain, unambiguous_totals, ambiguity_classes, class_support, class_prune, class_support_all, class_prune_all, lineage, species_normalise, genus_resolve, majority_lca, taxon_names_merged, em_fixed_iter, em_profile, class_ancestors, resolved_totals, resolved_coverage, profile_metrics, profile_full, profile_raw, profile_strain, profile_strain_final, classification, classification_strain, expected_breadth, pvalue_exact, pvalue_normal, pvalue_binomial, chunk_threshold, ratio_filter, pvalue_filter, abundance_renorm, host_annotation, subsample_scaling, subsample_allocation, subsample_min_length, subsample_segments)
}
_LINEAGE = """m1 AS (SELECT old_taxid, min(new_taxid) AS new_taxid FROM tax_merged GROUP BY 1),
cn AS (SELECT taxid, parent_taxid, rank, sci_name FROM tax_nodes WHERE taxid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY taxid ORDER BY loaded_at DESC) = 1),
lk0 AS (
  SELECT n.taxid, CASE WHEN n.parent_taxid = 1 THEN 1 ELSE coalesce(m.new_taxid, n.parent_taxid) END AS p FROM cn n LEFT JOIN m1 m ON m.old_taxid = n.parent_taxid WHERE n.taxid <> 1
  UNION ALL SELECT 1, NULL),
lk AS (SELECT a.taxid, b.taxid AS parent FROM lk0 a LEFT JOIN lk0 b ON b.taxid = a.p AND b.taxid <> a.taxid),
tree AS (
  SELECT taxid, [taxid] AS way FROM lk WHERE parent IS NULL
  UNION ALL SELECT l.taxid, list_append(t.way, l.taxid) FROM lk l JOIN tree t ON l.parent = t.taxid),
steps AS (SELECT taxid, unnest(way) AS node, unnest(range(len(way))) AS lvl FROM tree),
ranked AS (SELECT s.taxid, arg_max(s.node, s.lvl) FILTER (WHERE cn.rank = 'species') AS sp, arg_max(s.node, s.lvl) FILTER (WHERE cn.rank = 'genus') AS gen FROM steps s JOIN cn ON cn.taxid = s.node GROUP BY 1),
refs AS (SELECT * FROM ref_meta QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY loaded_at DESC) = 1)"""
_CURRENT = """cur AS (SELECT * FROM alignments QUALIFY row_number() OVER (PARTITION BY aln_id ORDER BY ingested_at DESC) = 1),
prs AS (
  SELECT read_name, aln_id AS ordinal, asm, acc, try_cast(split_part(ref_name, '|', 2) AS BIGINT) AS strain_taxid, species_taxid AS species_raw, asm_len, identity, fraction, mapped_len, span.s AS s, span.e AS e,
    coalesce(asm, '') <> '' AND species_taxid IS NOT NULL AND identity IS NOT NULL AND NOT isnan(identity) AND coalesce(asm_len, 0) > 0 AND span IS NOT NULL AS kept FROM cur)"""
_CLASSES = f"""{_LINEAGE}, {_CURRENT},
k AS (
  SELECT p.*, coalesce(r.sp, p.species_raw) AS species_taxid, r.gen AS genus_taxid FROM prs p
  LEFT JOIN m1 ON m1.old_taxid = p.species_raw LEFT JOIN ranked r ON r.taxid = coalesce(m1.new_taxid, p.species_raw) WHERE p.kept),
cand AS (SELECT *, species_taxid AS taxid, mapped_len / asm_len AS depth FROM k WHERE mapped_len >= 50 AND identity >= 0.95 AND fraction >= 0.6),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY read_name, taxid ORDER BY identity DESC, ordinal) = 1),
sets AS (SELECT read_name, list_sort(list(taxid)) AS class FROM best GROUP BY 1),
cls AS (SELECT b.*, CAST(b.mapped_len AS DOUBLE) AS maplen, s.class FROM best b JOIN sets s ON s.read_name IS NOT DISTINCT FROM b.read_name),
uni AS (SELECT taxid, CAST(count(*) AS DOUBLE) AS n, sum(depth) AS depth, sum(maplen) AS maplen FROM cls WHERE len(class) = 1 GROUP BY 1),
mem AS (SELECT class, taxid, CAST(count(*) AS DOUBLE) AS n, sum(depth) AS depth, sum(maplen) AS maplen FROM cls WHERE len(class) > 1 GROUP BY 1, 2),
even AS (SELECT * FROM uni WHERE taxid % 2 = 0),
sup AS (SELECT m.*, e.taxid IS NOT NULL AS ok, count(e.taxid) OVER (PARTITION BY m.class) AS n_ok FROM mem m LEFT JOIN even e USING (taxid))"""
_KINDS = """kinds AS (
  SELECT *, 'span' AS kind, s AS a, e AS b FROM {0}
  UNION ALL SELECT *, 'fixed', greatest(s - 2000, 1), least(e + 2000, CAST(asm_len AS BIGINT) + 1) FROM {0}
  UNION ALL SELECT *, 'flex', greatest(s + (e - s) // 2 - greatest(CAST(floor(sqrt(asm_len) + 0.5) AS BIGINT), 1), 1), least(s + (e - s) // 2 + greatest(CAST(floor(sqrt(asm_len) + 0.5) AS BIGINT), 1), CAST(asm_len AS BIGINT) + 1) FROM {0}),
reach AS (SELECT *, max(b) OVER (PARTITION BY {1}, kind ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM kinds WHERE b > a),
cov AS (SELECT {1}, kind, sum(CASE WHEN pm IS NULL OR a >= pm THEN b - a ELSE greatest(b - pm, 0) END) / asm_len AS share, count(*) FILTER (WHERE pm IS NULL OR a >= pm) AS islands FROM reach GROUP BY {1}, kind)"""
_COVERAGE = _KINDS.format("best", "taxid, asm, acc, asm_len") + """,
tcov AS (SELECT taxid, sum(share) FILTER (WHERE kind = 'span') AS breadth, sum(share) FILTER (WHERE kind = 'fixed') AS fixed_chunk, sum(share) FILTER (WHERE kind = 'flex') AS flex_chunk FROM cov GROUP BY 1)"""
_STRAIN_COVERAGE = "kk AS (SELECT * FROM prs WHERE kept), " + _KINDS.format("kk", "asm, acc, asm_len") + """,
by_asm AS (
  SELECT asm, least(sum(share) FILTER (WHERE kind = 'span'), 1) AS breadth, least(sum(share) FILTER (WHERE kind = 'fixed'), 1) AS fixed_chunk, least(sum(share) FILTER (WHERE kind = 'flex'), 1) AS flex_chunk FROM cov GROUP BY 1),
isl AS (SELECT asm, max(n) AS n FROM (SELECT asm, acc, sum(islands) AS n FROM cov WHERE kind = 'flex' GROUP BY 1, 2) GROUP BY 1),
asms AS (SELECT asm, max(asm_len) AS asm_len FROM kk GROUP BY 1),
bridge AS (SELECT asm, strain_taxid AS taxid FROM kk WHERE strain_taxid > 0 UNION SELECT asm, species_raw FROM kk WHERE species_raw > 0)
SELECT b.taxid, round(max(c.breadth), 9) AS breadth, round(max(c.fixed_chunk), 9) AS fixed_chunk, round(max(c.flex_chunk), 9) AS flex_chunk,
  max(greatest(CAST(floor(greatest(sqrt(a.asm_len) / 2, 1)) AS BIGINT), CAST(i.n AS BIGINT))) AS num_flex_chunks, CAST(max(a.asm_len) AS BIGINT) AS asm_length
FROM bridge b JOIN by_asm c USING (asm) JOIN isl i USING (asm) JOIN asms a USING (asm) GROUP BY 1"""
_R5 = "(CASE WHEN ({0}) < 0 THEN -floor(-({0}) * 1e5 + 0.5) ELSE floor(({0}) * 1e5 + 0.5) END / 1e5)"


def _em_sql(steps: int) -> str:
    """The iterations written out."""
    known = "whole AS (SELECT m.* FROM mem m JOIN (SELECT m.class FROM mem m LEFT JOIN uni u USING (taxid) GROUP BY 1 HAVING count(u.taxid) = count(*)) USING (class)), s0 AS (SELECT taxid, n, depth, maplen FROM uni)"
    for i in range(steps):
        known += f""",
f{i} AS (SELECT w.*, s.depth / sum(s.depth) OVER (PARTITION BY w.class) AS f FROM whole w JOIN s{i} s USING (taxid)),
w{i} AS (SELECT *, max(f) OVER (PARTITION BY class) >= 0.99 AS taken FROM f{i}),
g{i} AS (SELECT taxid, sum(n * wt) AS n, sum(depth * wt) AS depth, sum(maplen * wt) AS maplen FROM (SELECT *, CASE WHEN taken THEN 1.0 ELSE f END AS wt FROM w{i} WHERE NOT taken OR f >= 0.99) GROUP BY 1),
s{i + 1} AS (SELECT u.taxid, u.n + coalesce(g.n, 0) AS n, u.depth + coalesce(g.depth, 0) AS depth, u.maplen + coalesce(g.maplen, 0) AS maplen FROM uni u LEFT JOIN g{i} g USING (taxid))"""
    return f"WITH RECURSIVE {_CLASSES}, {known} SELECT taxid, round(n, 6) AS n, round(depth, 6) AS depth, round(maplen, 6) AS maplen FROM s{steps}"


_KEY = "array_to_string(class, ',') AS class"
_SUMS = "round(n, 6) AS n, round(depth, 6) AS depth, round(maplen, 6) AS maplen"
_DIM = f"""WITH RECURSIVE {_LINEAGE},
r0 AS (
  SELECT ref_name, length AS ref_len, split_part(ref_name, '|', 1) AS asm, split_part(ref_name, '|', 4) AS acc, try_cast(split_part(ref_name, '|', 2) AS BIGINT) AS strain_taxid, try_cast(split_part(ref_name, '|', 3) AS BIGINT) AS species_raw,
    try_cast(split_part(ref_name, '|', 5) AS BIGINT) AS genome_size, try_cast(split_part(ref_name, '|', 6) AS BIGINT) AS sampled_size, len(string_split(ref_name, '|')) AS n_fields FROM refs WHERE length IS NOT NULL AND ref_name IS NOT NULL),
dim AS (
  SELECT r0.*, coalesce(k.sp, r0.species_raw) AS species_taxid, k.gen AS genus_taxid, a.asm_len, greatest(CAST(floor(sqrt(a.asm_len) + 0.5) AS BIGINT), 1) AS flex_flank
  FROM r0 JOIN (SELECT asm, CAST(sum(ref_len) AS BIGINT) AS asm_len FROM r0 GROUP BY 1) a USING (asm) LEFT JOIN m1 ON m1.old_taxid = r0.species_raw LEFT JOIN ranked k ON k.taxid = coalesce(m1.new_taxid, r0.species_raw))"""
_SAM = f"""{_DIM}, {_CURRENT},
sam AS (
  SELECT CASE WHEN contains(read_name, '/') THEN regexp_replace(read_name, '/[^/]*$', '') ELSE read_name END AS read_name, aln_id AS ordinal, coalesce(ref_name, '*') AS ref_name, [99, 147, 0, 512, 103, 355][aln_id % 6 + 1] AS flag,
    ['=', '=', '=', '*'][aln_id % 4 + 1] AS rnext, coalesce(cigar, '*') AS cigar, least(greatest(span.s, 1), greatest(span.s - 40, 1)) AS start, mapped_len FROM cur),
j AS (
  SELECT s.*, d.asm, d.acc, d.strain_taxid, d.ref_len, d.flex_flank AS x,
    s.ref_name <> '*' AND s.cigar <> '*' AND s.rnext = '=' AND coalesce(d.ref_len, 0) > 0 AND s.mapped_len > 0 AND coalesce(d.asm, '') <> '' AND d.species_taxid IS NOT NULL AND coalesce(d.asm_len, 0) > 0 AS usable
  FROM sam s LEFT JOIN dim d ON d.ref_name = s.ref_name WHERE s.flag & 512 = 0),
placed AS (
  SELECT *, usable AND flag & 4 = 0 AS counted, usable AND flag & 64 <> 0 AS kept, least(start, ref_len) AS s, least(least(start, ref_len) + mapped_len, ref_len + 1) AS e FROM j)"""

SQL: dict[str, str] = {
    "aln_parse": f"""{_SAM}
SELECT read_name, ordinal, asm, acc, strain_taxid, mapped_len, counted, kept, CASE WHEN kept THEN s END AS span_s, CASE WHEN kept THEN e END AS span_e,
  CASE WHEN kept THEN greatest(s - 1000, 1) END AS fixed_s, CASE WHEN kept THEN least(e + 1000, ref_len + 1) END AS fixed_e, CASE WHEN kept THEN greatest(s + (e - s) // 2 - x, 1) END AS flex_s, CASE WHEN kept THEN least(s + (e - s) // 2 + x, ref_len + 1) END AS flex_e FROM placed""",
    "mate_and_qc_filters": f"{_SAM} SELECT asm, count(*) AS n_rows, count(*) FILTER (WHERE counted) AS n_counted, count(*) FILTER (WHERE kept) AS n_kept FROM placed GROUP BY 1",
    "cigar_identity": f"""WITH {_CURRENT},
toks AS (SELECT aln_id, unnest(regexp_extract_all(cigar, '([0-9]+)([^0-9])', 1)) AS n, unnest(regexp_extract_all(cigar, '([0-9]+)([^0-9])', 2)) AS op, unnest(range(len(regexp_extract_all(cigar, '[0-9]+[^0-9]')))) AS i FROM cur WHERE cigar IS NOT NULL),
marked AS (SELECT aln_id, CAST(n AS BIGINT) AS n, op, lag(op) OVER (PARTITION BY aln_id ORDER BY i) AS prev FROM toks WHERE CAST(n AS BIGINT) > 0),
t AS (
  SELECT aln_id, coalesce(sum(n) FILTER (WHERE op = '='), 0) AS eq, coalesce(sum(n) FILTER (WHERE op = 'X'), 0) AS x, coalesce(sum(n) FILTER (WHERE op = 'M'), 0) AS m, coalesce(sum(n) FILTER (WHERE op = 'I'), 0) AS i,
    coalesce(sum(n) FILTER (WHERE op = 'S'), 0) AS s, count(*) FILTER (WHERE op IN ('I', 'D') AND prev IS DISTINCT FROM op) AS g FROM marked GROUP BY 1),
a AS (SELECT c.aln_id, coalesce(eq, 0) AS eq, coalesce(x, 0) AS x, coalesce(m, 0) AS m, coalesce(i, 0) AS i, coalesce(s, 0) AS s, coalesce(g, 0) AS g FROM cur c LEFT JOIN t USING (aln_id) WHERE c.cigar IS NOT NULL)
SELECT aln_id, round(CASE WHEN eq + x > 0 THEN eq / (eq + x + g) WHEN m + g > 0 THEN m / (m + g) ELSE 0.0 END, 9) AS identity, CAST(CASE WHEN eq + x > 0 THEN eq ELSE m END AS BIGINT) AS matched_len,
  round(CASE WHEN m + eq + x + i + s > 0 THEN (m + eq + x + i) / (m + eq + x + i + s) ELSE 0.0 END, 9) AS fraction FROM a""",
    "ref_dim": f"{_DIM} SELECT ref_name, ref_len, asm, acc, strain_taxid, species_raw, species_taxid, genus_taxid, asm_len, flex_flank, genome_size, sampled_size, n_fields FROM dim",
    "run_totals": f"WITH {_CURRENT} SELECT count(DISTINCT read_name) AS reads, count(DISTINCT read_name) FILTER (WHERE kept) AS aligned_reads, count(*) AS alignments FROM prs",
    "filter_stats": f"""WITH {_CURRENT}
SELECT count(*) AS evaluated, count(*) FILTER (WHERE mapped_len >= 50 AND identity >= 0.95 AND fraction >= 0.6) AS passed, count(*) FILTER (WHERE mapped_len < 50) AS filtered_length,
  count(*) FILTER (WHERE mapped_len >= 50 AND identity < 0.95) AS filtered_identity, count(*) FILTER (WHERE mapped_len >= 50 AND identity >= 0.95 AND fraction < 0.6) AS filtered_fraction FROM prs WHERE kept""",
    "species_candidates": f"WITH RECURSIVE {_CLASSES} SELECT taxid, count(*) AS n, CAST(sum(mapped_len) AS BIGINT) AS sum_len FROM cand GROUP BY 1",
    "genus_fallback": f"""WITH RECURSIVE {_CLASSES},
both_kinds AS (
  SELECT *, mapped_len >= 50 AND identity >= 0.95 AND fraction >= 0.6 AS sp, identity >= 0.80 AND mapped_len >= 50 AND fraction >= 0.60 AND genus_taxid IS NOT NULL AS gn FROM k),
chosen AS (SELECT *, bool_or(sp) OVER (PARTITION BY read_name) AS any_sp FROM both_kinds WHERE sp OR gn)
SELECT read_name, ordinal, CASE WHEN sp THEN species_taxid ELSE genus_taxid END AS taxid, CASE WHEN sp THEN 'species' ELSE 'genus' END AS rank FROM chosen WHERE sp OR NOT any_sp""",
    "best_alignment": f"WITH RECURSIVE {_CLASSES} SELECT read_name, taxid, ordinal, round(depth, 9) AS depth FROM best",
    "best_alignment_strain": f"WITH RECURSIVE {_CLASSES} SELECT read_name, taxid, ordinal, round(depth, 9) AS depth FROM cand QUALIFY row_number() OVER (PARTITION BY read_name, taxid ORDER BY depth DESC, ordinal) = 1",
    "interval_union": f"""WITH RECURSIVE {_CLASSES},
r AS (SELECT taxid, asm, acc, s, e, max(e) OVER (PARTITION BY taxid, asm, acc ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM best),
i AS (SELECT *, sum(CASE WHEN pm IS NULL OR s >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY taxid, asm, acc ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT taxid, asm, acc, min(s) AS s, max(e) AS e FROM i GROUP BY taxid, asm, acc, island""",
    "coverage_by_taxon": f"WITH RECURSIVE {_CLASSES}, {_COVERAGE} SELECT taxid, round(breadth, 9) AS breadth, round(fixed_chunk, 9) AS fixed_chunk, round(flex_chunk, 9) AS flex_chunk FROM tcov",
    "coverage_strain": f"WITH {_CURRENT}, {_STRAIN_COVERAGE}",
    "unambiguous_totals": f"WITH RECURSIVE {_CLASSES} SELECT taxid, {_SUMS} FROM uni",
    "ambiguity_classes": f"WITH RECURSIVE {_CLASSES} SELECT {_KEY}, taxid, {_SUMS} FROM mem",
    "class_support": f"WITH RECURSIVE {_CLASSES} SELECT {_KEY}, taxid, ok, n_ok, CASE WHEN n_ok = len(class) THEN 'all' WHEN n_ok = 0 THEN 'none' ELSE 'some' END AS kind FROM sup",
    "class_prune": f"""WITH RECURSIVE {_CLASSES},
p AS (SELECT class, taxid, n, depth, maplen FROM sup WHERE ok AND n_ok < len(class)),
q AS (SELECT s.class, p.taxid, p.n, p.depth, p.maplen FROM p JOIN (SELECT class AS c0, list_sort(list(taxid)) AS class FROM p GROUP BY 1) s ON s.c0 = p.class)
SELECT {_KEY}, taxid, round(sum(n), 6) AS n, round(sum(depth), 6) AS depth, round(sum(maplen), 6) AS maplen FROM q GROUP BY class, taxid""",
    "lineage": f"WITH RECURSIVE {_LINEAGE} SELECT taxid, array_to_string(way, '/') AS path FROM tree",
    "species_normalise": f"WITH RECURSIVE {_LINEAGE} SELECT i.taxid, coalesce(k.sp, i.taxid) AS species_taxid FROM (SELECT DISTINCT fallback_taxid AS taxid FROM refs WHERE fallback_taxid IS NOT NULL) i LEFT JOIN m1 ON m1.old_taxid = i.taxid LEFT JOIN ranked k ON k.taxid = coalesce(m1.new_taxid, i.taxid)",
    "genus_resolve": f"WITH RECURSIVE {_LINEAGE} SELECT i.taxid, k.gen AS genus_taxid FROM (SELECT DISTINCT fallback_taxid AS taxid FROM refs WHERE fallback_taxid IS NOT NULL) i LEFT JOIN m1 ON m1.old_taxid = i.taxid LEFT JOIN ranked k ON k.taxid = coalesce(m1.new_taxid, i.taxid)",
    "majority_lca": f"""WITH RECURSIVE {_LINEAGE},
ids AS (SELECT asm, taxid FROM refs WHERE asm IS NOT NULL AND taxid > 0 UNION SELECT asm, fallback_taxid FROM refs WHERE asm IS NOT NULL AND fallback_taxid > 0),
sizes AS (SELECT asm, count(*) AS n FROM ids GROUP BY 1),
c AS (SELECT i.asm, s.lvl, s.node, count(*) AS k FROM ids i LEFT JOIN m1 ON m1.old_taxid = i.taxid JOIN steps s ON s.taxid = coalesce(m1.new_taxid, i.taxid) GROUP BY 1, 2, 3)
SELECT c.asm, arg_max(node, lvl) AS lca FROM c JOIN sizes USING (asm) WHERE k >= ceil(CAST(0.7 AS DOUBLE) * n) GROUP BY 1""",
    "taxon_names_merged": f"""WITH RECURSIVE {_LINEAGE},
i AS (SELECT DISTINCT r.taxid, coalesce(m1.new_taxid, r.taxid) AS id FROM refs r LEFT JOIN m1 ON m1.old_taxid = r.taxid WHERE r.taxid IS NOT NULL)
SELECT i.taxid, CASE WHEN d.taxid IS NULL THEN cn.sci_name END AS name, CASE WHEN d.taxid IS NULL THEN cn.rank END AS rank FROM i LEFT JOIN cn ON cn.taxid = i.id LEFT JOIN (SELECT DISTINCT taxid FROM tax_deleted) d ON d.taxid = i.id""",
    "em_fixed_iter": _em_sql(EM_STEPS),
    "expected_breadth": f"""WITH RECURSIVE {_CLASSES},
g AS (SELECT *, maplen / depth AS len, greatest(CAST(floor(sqrt(maplen / depth) / 2) AS BIGINT), 1) AS chunks FROM uni)
SELECT taxid, round(1 - pow(greatest(least(1 - depth / n, 1), 0), n), 6) AS expected_breadth, round(len, 4) AS genome_len, chunks, round(1 - pow(1 - 1 / chunks, n), 6) AS expected_flex FROM g""",
    "chunk_threshold": f"""WITH {_CURRENT}, t AS (SELECT CAST(count(DISTINCT read_name) AS DOUBLE) AS n FROM prs),
e AS (SELECT CASE WHEN n <= 100000 THEN n / 1e6 WHEN n <= 1000000 THEN 0.11 * n / 1e6 + 0.09 ELSE least(0.2 + 0.382 * log10(n / 1e6), 0.95) END AS short, CASE WHEN n <= 5000 THEN 0.0 WHEN n <= 1000000 THEN 0.3 ELSE 0.5 END AS long FROM t)
SELECT 'illumina' AS sequencer, false AS lowbiomass, CAST(round(short, 9) AS DOUBLE) AS threshold FROM e UNION ALL SELECT 'illumina', true, 0.0 FROM e UNION ALL SELECT 'nanopore', false, CAST(long AS DOUBLE) FROM e UNION ALL SELECT 'nanopore', true, 0.0 FROM e""",
    "ratio_filter": f"""WITH RECURSIVE {_CLASSES}, {_COVERAGE},
g AS (SELECT *, greatest(CAST(floor(sqrt(maplen / depth) / 2) AS BIGINT), 1) AS chunks FROM uni),
v AS (
  SELECT taxid, {_R5.format("least(breadth, 1)")} AS b, {_R5.format("1 - pow(greatest(least(1 - depth / n, 1), 0), n)")} AS eb, {_R5.format("least(flex_chunk, 1)")} AS f, {_R5.format("1 - pow(1 - 1 / chunks, n)")} AS ef FROM g JOIN tcov USING (taxid))
SELECT taxid, eb > 0 AND coalesce(b / nullif(eb, 0) BETWEEN 0.75 AND 1.5, false) AS breadth_ok, ef > 0 AND coalesce(f / nullif(ef, 0) BETWEEN 0.75 AND 1.5, false) AS flex_ok FROM v""",
    "pvalue_filter": f"""WITH {_CURRENT}, a AS (SELECT asm, min(identity) AS lo, max(identity) AS hi FROM prs WHERE kept GROUP BY 1),
p AS (SELECT asm, CASE WHEN lo < 0.8 THEN NULL ELSE (1 - lo) * 1e-4 END AS c, CASE WHEN hi < 0.8 THEN NULL ELSE (1 - hi) * 1e-4 END AS h FROM a)
SELECT asm, NOT coalesce(c < 1e-5 AND h < 1e-5, false) AS default_ok, coalesce(c >= 1e-5 AND h >= 1e-5, false) AS strict_ok FROM p""",
    "abundance_renorm": f"""WITH RECURSIVE {_CLASSES}, v AS (SELECT taxid, {_R5.format("depth")} AS a FROM uni)
SELECT taxid, {_R5.format("a / (SELECT sum(a) FROM v) * 100")} AS abundance FROM v""",
    "host_annotation": f"""WITH RECURSIVE {_LINEAGE},
h AS (SELECT taxid, parent_taxid AS host, taxid % 5 = 0 AS unknown FROM cn WHERE rank = 'species' AND (parent_taxid IS NOT NULL OR taxid % 5 = 0)),
hit AS (SELECT h.taxid FROM h LEFT JOIN m1 ON m1.old_taxid = h.host LEFT JOIN tree t ON t.taxid = coalesce(m1.new_taxid, h.host) WHERE NOT unknown AND (h.host = 2 OR coalesce(list_contains(t.way, 2), false)))
SELECT cn.taxid, CASE WHEN h.taxid IS NULL THEN 'unknown' ELSE 'host ' || h.host END AS host_names, CASE WHEN h.taxid IS NULL THEN 'unknown' ELSE CAST(h.host AS VARCHAR) END AS host_taxids,
  CASE WHEN h.taxid IS NULL THEN 'unknown' WHEN h.taxid % 7 = 0 THEN 'd0' ELSE 'd0;d' || (h.taxid % 7) END AS diseases
FROM cn LEFT JOIN h USING (taxid) WHERE h.taxid IS NULL OR h.taxid IN (SELECT taxid FROM hit)""",
    "subsample_scaling": f"""WITH RECURSIVE {_LINEAGE},
r0 AS (
  SELECT ref_id, try_cast(split_part(ref_name, '|', 2) AS BIGINT) AS a, try_cast(split_part(ref_name, '|', 3) AS BIGINT) AS b, try_cast(split_part(ref_name, '|', 5) AS BIGINT) AS g, try_cast(split_part(ref_name, '|', 6) AS BIGINT) AS z, len(string_split(ref_name, '|')) AS k FROM refs WHERE ref_name IS NOT NULL),
u AS (SELECT ref_id, a AS taxid, g / z AS scale FROM r0 WHERE k >= 6 AND z > 0 AND z < g UNION SELECT ref_id, b, g / z FROM r0 WHERE k >= 6 AND z > 0 AND z < g)
SELECT taxid, round(arg_min(scale, ref_id), 9) AS scale FROM u WHERE taxid IS NOT NULL GROUP BY 1""",
}
_LENGTHS = """cc AS (SELECT * FROM contigs QUALIFY row_number() OVER (PARTITION BY contig_id ORDER BY loaded_at DESC) = 1),
c0 AS (SELECT genome_id, CAST(contig_idx AS BIGINT) AS contig_idx, CAST(length(regexp_replace(coalesce(seq, ''), '[^A-Za-z]', '', 'g')) AS BIGINT) AS len FROM cc),
c1 AS (SELECT *, CAST(sum(len) OVER (PARTITION BY genome_id) AS BIGINT) AS genome_size FROM c0)"""
SQL["subsample_min_length"] = f"""WITH {_LENGTHS}, v AS (SELECT *, max(len) OVER (PARTITION BY genome_id) AS longest FROM c1 WHERE len > 0)
SELECT genome_id, contig_idx, CAST(1 AS BIGINT) AS start, len AS stop FROM v WHERE genome_size <= 20000 OR longest < 2000 OR len >= 2000"""
SQL["subsample_allocation"] = f"""WITH {_LENGTHS},
v AS (SELECT genome_id, genome_size, contig_idx, len // 1000 AS slots FROM c1 WHERE genome_size >= 5000 AND len >= 1000),
w AS (SELECT *, CAST(sum(slots) OVER (PARTITION BY genome_id) AS BIGINT) AS total, greatest(ceil(CAST(0.3 AS DOUBLE) * genome_size), 1) AS goal FROM v),
x AS (SELECT *, total * 1000 >= goal AS enough, least(ceil(goal / 1000), total) AS want FROM w),
y AS (SELECT *, least(floor(slots / total * want), slots) AS fl, slots / total * want - least(floor(slots / total * want), slots) AS rest FROM x),
z AS (SELECT *, want - sum(fl) OVER (PARTITION BY genome_id) AS open, row_number() OVER (PARTITION BY genome_id ORDER BY (fl < slots) DESC, rest DESC, contig_idx) AS rk FROM y)
SELECT genome_id, contig_idx, slots, CAST(fl + CASE WHEN fl < slots AND rk <= open THEN 1 ELSE 0 END AS BIGINT) AS quota, enough FROM z"""
_PV = """WITH {current},
by_acc AS (SELECT asm, acc, count(*) AS m0, CAST(sum(mapped_len) AS BIGINT) AS len FROM prs WHERE kept GROUP BY 1, 2),
c AS (SELECT asm, acc, {m} AS m, {cells} AS cells FROM by_acc),
o AS (SELECT *, 1 - pow(1 - 1 / cells, m) AS p, CAST(floor((1 - pow(1 - 1 / cells, m)) * cells * 0.9) AS BIGINT) AS k FROM c)"""
SQL["pvalue_exact"] = f"""WITH RECURSIVE {_PV.format(current=_CURRENT, m="least(m0, 40)", cells="50 + len % 100")[5:]},
occ AS (
  SELECT DISTINCT cells AS n, 1 AS m, 1 AS k, CAST(1 AS DOUBLE) AS pr FROM o
  UNION ALL SELECT n, m + 1, k + d, sum(pr * CASE WHEN d = 0 THEN k / n ELSE (n - k) / n END) FROM occ, (VALUES (0), (1)) t(d) WHERE m < 40 GROUP BY n, m, k + d)
SELECT o.asm, o.acc, o.m, o.cells, o.k, round(CASE WHEN o.k = 0 THEN 0.0 WHEN o.k >= least(o.cells, o.m) THEN 1.0 ELSE sum(q.pr) FILTER (WHERE q.k <= o.k) END, 6) AS p
FROM o JOIN occ q ON q.n = o.cells AND q.m = o.m GROUP BY 1, 2, 3, 4, 5"""
SQL["pvalue_binomial"] = f"""{_PV.format(current=_CURRENT, m="m0", cells="200000 + len")},
terms AS (SELECT *, unnest(range(k + 1)) AS i FROM o)
SELECT asm, acc, m, cells, k, round(least(sum(exp(lgamma(cells + 1) - lgamma(i + 1) - lgamma(cells - i + 1) + i * ln(p) + (cells - i) * ln(1 - p))), 1.0), 6) AS p FROM terms GROUP BY 1, 2, 3, 4, 5"""
_SUP_ALL = "sup_all AS (SELECT m.*, u.taxid IS NOT NULL AS ok, count(u.taxid) OVER (PARTITION BY m.class) AS n_ok FROM mem m LEFT JOIN uni u USING (taxid))"
SQL["class_support_all"] = f"WITH RECURSIVE {_CLASSES}, {_SUP_ALL} SELECT {_KEY}, taxid, ok, n_ok, CASE WHEN n_ok = len(class) THEN 'all' WHEN n_ok = 0 THEN 'none' ELSE 'some' END AS kind FROM sup_all"
SQL["class_prune_all"] = f"""WITH RECURSIVE {_CLASSES}, {_SUP_ALL},
p AS (SELECT class, taxid, n, depth, maplen FROM sup_all WHERE ok AND n_ok < len(class)),
q AS (SELECT s.class, p.taxid, p.n, p.depth, p.maplen FROM p JOIN (SELECT class AS c0, list_sort(list(taxid)) AS class FROM p GROUP BY 1) s ON s.c0 = p.class)
SELECT {_KEY}, taxid, round(sum(n), 6) AS n, round(sum(depth), 6) AS depth, round(sum(maplen), 6) AS maplen FROM q GROUP BY class, taxid"""

# The distribution function of the normal law, by its series around 0.
SQL["pvalue_normal"] = f"""{_PV.format(current=_CURRENT, m="m0 + 2000", cells="4000 + len % 1000")},
z AS (SELECT *, (k + 0.5 - cells * p) / sqrt(cells * p * (1 - p)) AS z FROM o),
terms AS (SELECT *, unnest(range(200)) AS i FROM z)
SELECT asm, acc, m, cells, k, round(0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * sum(CASE WHEN z = 0 THEN 0 ELSE exp((2 * i + 1) * ln(abs(z)) + i * ln(2) + lgamma(i + 1) - lgamma(2 * i + 2)) END), 6) AS p
FROM terms GROUP BY asm, acc, m, cells, k, z"""


def _em_to_the_end(known: str, members: str, tol: float = 1e-5) -> str:
    """Iterations (it) of EM over ``known`` and ``members`` until no more than a share of ``tol`` moves."""
    return f"""it AS (
  SELECT 0 AS i, taxid, n, depth, maplen, CAST(1e9 AS DOUBLE) AS moved FROM {known}
  UNION ALL
  SELECT i, taxid, n, depth, maplen, sum(abs(depth - old)) OVER () / greatest(sum(old) OVER (), 1e-12) FROM (
    SELECT s.i + 1 AS i, u.taxid, u.n + coalesce(g.n, 0) AS n, u.depth + coalesce(g.depth, 0) AS depth, u.maplen + coalesce(g.maplen, 0) AS maplen, s.depth AS old
    FROM it s JOIN {known} u USING (taxid) LEFT JOIN (
      SELECT taxid, sum(n * wt) AS n, sum(depth * wt) AS depth, sum(maplen * wt) AS maplen FROM (
        SELECT *, CASE WHEN max(f) OVER (PARTITION BY class) < 0.99 THEN f WHEN f >= 0.99 THEN 1.0 ELSE 0.0 END AS wt
        FROM (SELECT w.*, s2.depth / sum(s2.depth) OVER (PARTITION BY w.class) AS f FROM {members} w JOIN it s2 USING (taxid)))
      GROUP BY 1) g USING (taxid)
    WHERE s.moved > {tol} AND s.i < 1000))"""


SQL["em_profile"] = f"""WITH RECURSIVE {_CLASSES},
whole AS (SELECT m.* FROM mem m JOIN (SELECT m.class FROM mem m LEFT JOIN uni u USING (taxid) GROUP BY 1 HAVING count(u.taxid) = count(*)) USING (class)),
{_em_to_the_end("uni", "whole")}
SELECT taxid, {_SUMS} FROM it WHERE i = (SELECT max(i) FROM it)"""
_RESOLVED_SQL = f"""{_CLASSES}, {_SUP_ALL}, {_COVERAGE},
steps2 AS (SELECT s.class, s.taxid, unnest(t.way) AS node, unnest(range(len(t.way))) AS lvl FROM sup_all s LEFT JOIN m1 ON m1.old_taxid = s.taxid JOIN tree t ON t.taxid = coalesce(m1.new_taxid, s.taxid) WHERE n_ok = 0),
lca AS (
  SELECT class, arg_max(node, lvl) AS lca FROM (SELECT class, lvl, node, count(*) AS k FROM steps2 GROUP BY 1, 2, 3) WHERE k >= ceil(CAST(0.7 AS DOUBLE) * len(class)) GROUP BY 1),
gain AS (SELECT lca AS taxid, max(n) AS n, avg(depth) AS depth, avg(maplen) AS maplen FROM sup_all JOIN lca USING (class) GROUP BY class, lca),
kn AS (
  SELECT taxid, sum(n) AS n, sum(depth) AS depth, sum(maplen) AS maplen FROM (
    SELECT taxid, n, depth, maplen FROM uni UNION ALL SELECT taxid, n, depth, maplen FROM sup_all WHERE ok AND n_ok = 1 AND n_ok < len(class) UNION ALL SELECT taxid, n, depth, maplen FROM gain) GROUP BY 1),
part AS (SELECT * FROM sup_all WHERE ok AND n_ok > 1 AND n_ok < len(class)),
mm AS (
  SELECT class, taxid, sum(n) AS n, sum(depth) AS depth, sum(maplen) AS maplen FROM (
    SELECT class, taxid, n, depth, maplen FROM sup_all WHERE n_ok = len(class)
    UNION ALL SELECT c.class, p.taxid, p.n, p.depth, p.maplen FROM part p JOIN (SELECT class AS c0, list_sort(list(taxid)) AS class FROM part GROUP BY 1) c ON c.c0 = p.class) GROUP BY 1, 2),
over_ AS (SELECT l.lca AS taxid, max(t.breadth) AS breadth, max(t.fixed_chunk) AS fixed_chunk, max(t.flex_chunk) AS flex_chunk FROM sup_all s JOIN lca l USING (class) JOIN tcov t ON t.taxid = s.taxid GROUP BY 1),
rcov AS (
  SELECT coalesce(o.taxid, t.taxid) AS taxid, coalesce(o.breadth, t.breadth) AS breadth, coalesce(o.fixed_chunk, t.fixed_chunk) AS fixed_chunk, coalesce(o.flex_chunk, t.flex_chunk) AS flex_chunk
  FROM tcov t FULL JOIN over_ o ON o.taxid = t.taxid),
lab AS (
  SELECT i.taxid, CASE WHEN d.taxid IS NULL THEN cn.sci_name END AS name, CASE WHEN d.taxid IS NULL THEN cn.rank END AS rank
  FROM (SELECT taxid FROM kn UNION SELECT taxid FROM mm UNION SELECT lca FROM lca) i LEFT JOIN m1 ON m1.old_taxid = i.taxid
  LEFT JOIN cn ON cn.taxid = coalesce(m1.new_taxid, i.taxid) LEFT JOIN (SELECT DISTINCT taxid FROM tax_deleted) d ON d.taxid = coalesce(m1.new_taxid, i.taxid))"""
SQL["class_ancestors"] = f"WITH RECURSIVE {_RESOLVED_SQL} SELECT {_KEY}, lca AS taxid FROM lca"
SQL["resolved_totals"] = f"WITH RECURSIVE {_RESOLVED_SQL} SELECT taxid, {_SUMS} FROM kn"
SQL["resolved_coverage"] = f"WITH RECURSIVE {_RESOLVED_SQL} SELECT taxid, round(breadth, 9) AS breadth, round(fixed_chunk, 9) AS fixed_chunk, round(flex_chunk, 9) AS flex_chunk FROM rcov"
_EM_ALL = f"WITH RECURSIVE {_RESOLVED_SQL}, {_em_to_the_end('kn', 'mm')}, fin AS (SELECT * FROM it WHERE i = (SELECT max(i) FROM it))"
SQL["classification"] = f"""{_EM_ALL},
fr AS (SELECT class, taxid, f, max(f) OVER (PARTITION BY class) >= 0.99 AS taken FROM (SELECT w.class, w.taxid, s.depth / sum(s.depth) OVER (PARTITION BY w.class) AS f FROM mm w JOIN it s USING (taxid) WHERE s.i = (SELECT max(i) - 1 FROM it))),
fq AS (SELECT class, taxid, CASE WHEN taken THEN 1.0 ELSE {_R5.format("f")} END AS f, taken FROM fr WHERE NOT taken OR f >= 0.99),
fs AS (SELECT class, taxid, CASE WHEN taken THEN f ELSE f / sum(f) OVER (PARTITION BY class) END AS f FROM fq),
calls AS (
  SELECT class, list(taxid ORDER BY f DESC, taxid)[1] AS taxid, string_agg(CAST(taxid AS VARCHAR), ';' ORDER BY f DESC, taxid) AS taxids,
    string_agg(regexp_replace(regexp_replace(printf('%.5f', f), '0+$', ''), '\\.$', ''), ';' ORDER BY f DESC, taxid) AS fractions
  FROM fs WHERE class IN (SELECT class FROM sup_all WHERE n_ok = len(class)) GROUP BY 1
  UNION ALL SELECT class, lca, array_to_string(class, ';'), '1' FROM lca)
SELECT read_name, taxid, 'species' AS rank, CAST(taxid AS VARCHAR) AS taxids, '1' AS fractions FROM cls WHERE len(class) = 1
UNION ALL SELECT r.read_name, c.taxid, coalesce(l.rank, 'no rank'), c.taxids, c.fractions FROM (SELECT DISTINCT read_name, class FROM cls WHERE len(class) > 1) r JOIN calls c USING (class) LEFT JOIN lab l ON l.taxid = c.taxid"""
_SHOWN = {
    "reads": "v.n * coalesce(sc.scale, 1.0)", "depth": "v.depth", "abundance": "CASE WHEN whole <= 2.220446049250313e-16 THEN 0 ELSE v.depth / whole END", "breadth": "least(coalesce(c.breadth, 0), 1)", "expected_breadth": "CASE WHEN v.n = 0 THEN 0 ELSE 1 - pow(1 - v.depth / v.n, v.n) END",
    "fixed_chunk": "least(coalesce(c.fixed_chunk, 0), 1)", "flex_chunk": "least(coalesce(c.flex_chunk, 0), 1)", "expected_flex": "1 - pow(1 - 1 / v.chunks, v.n)",
}
SQL["profile_metrics"] = f"""{_EM_ALL},
r1 AS (
  SELECT ref_id, try_cast(split_part(ref_name, '|', 2) AS BIGINT) AS a, try_cast(split_part(ref_name, '|', 3) AS BIGINT) AS b, try_cast(split_part(ref_name, '|', 5) AS BIGINT) AS g, try_cast(split_part(ref_name, '|', 6) AS BIGINT) AS z, len(string_split(ref_name, '|')) AS k FROM refs WHERE ref_name IS NOT NULL AND length IS NOT NULL),
us AS (SELECT ref_id, a AS taxid, g / z AS scale FROM r1 WHERE k >= 6 AND z > 0 AND z < g UNION SELECT ref_id, b, g / z FROM r1 WHERE k >= 6 AND z > 0 AND z < g),
sc AS (SELECT taxid, arg_min(scale, ref_id) AS scale FROM us WHERE taxid IS NOT NULL GROUP BY 1),
v AS (SELECT *, (SELECT sum(depth) * 0.01 FROM fin) AS whole, CASE WHEN depth <= 2.220446049250313e-16 OR maplen / depth <= 0 THEN 1 ELSE greatest(CAST(floor(sqrt(maplen / depth) / 2) AS BIGINT), 1) END AS chunks FROM fin WHERE n >= 0.5)
SELECT l.name, v.taxid, coalesce(l.rank, 'no rank') AS rank, {", ".join(f"CAST(round({x}, 9) AS DOUBLE) AS {c}" for c, x in _SHOWN.items())}
FROM v JOIN lab l ON l.taxid = v.taxid LEFT JOIN rcov c ON c.taxid = v.taxid LEFT JOIN sc ON sc.taxid = v.taxid WHERE l.name IS NOT NULL"""
