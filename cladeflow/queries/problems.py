"""Queries of the general data-processing problems, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.operators import bad_records, fragment_replicate, hierarchy, orphans, run_bitmaps
from cladeflow.session import current_rows, load

#: p2: the share of all rows from which a key counts as holding most of them.
HOT_SHARE = 0.02


def current_refs(spark: SparkSession, d: str) -> DataFrame:
    refs = load(spark, d, "ref_meta").select("ref_id", "ref_name", "asm", "length", "taxid", "fallback_taxid", "loaded_at")
    return current_rows(refs, ["ref_id"], "loaded_at", F.col("ref_name"), F.col("length").desc_nulls_last(), F.col("taxid"), F.col("fallback_taxid"))


def _spans_with_length(spark: SparkSession, d: str) -> DataFrame:
    refs = current_refs(spark, d).where(F.col("length").isNotNull()).groupBy("ref_name").agg(F.max("length").alias("length"))
    spans = load(spark, d, "worker_spans").select("sample_id", "ref_name", "s", "e")
    return spans.join(refs, "ref_name")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return run_bitmaps.gaps(_spans_with_length(spark, d), ["sample_id", "ref_name"])


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    return run_bitmaps.periods(_spans_with_length(spark, d), ["sample_id", "ref_name"])


def _key_rows(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "alignments").select("species_taxid", "asm", "identity", "mapped_len")
    both = F.array(F.struct(F.lit("species_taxid").alias("f"), F.col("species_taxid").cast("string").alias("v")), F.struct(F.lit("asm").alias("f"), F.col("asm").alias("v")))
    rows = a.select(F.explode(both).alias("k"), "identity", "mapped_len")
    return rows.select(F.col("k.f").alias("key_field"), F.col("k.v").alias("key_value"), "identity", "mapped_len")


def _key_names(spark: SparkSession, d: str) -> DataFrame:
    """The matching side: what is known of a key, one row a key."""
    nodes = load(spark, d, "tax_nodes").select("taxid", "sci_name", "loaded_at")
    names = current_rows(nodes, ["taxid"], "loaded_at", F.col("sci_name")).where(F.col("taxid").isNotNull())
    species = names.select(F.lit("species_taxid").alias("key_field"), F.col("taxid").cast("string").alias("key_value"), F.col("sci_name").alias("label"))
    refs = current_refs(spark, d).where(F.col("asm").isNotNull()).groupBy("asm").agg(F.count(F.lit(1)).alias("n"))
    asm = refs.select(F.lit("asm").alias("key_field"), F.col("asm").alias("key_value"), F.concat(F.col("n").cast("string"), F.lit(" references")).alias("label"))
    return species.unionByName(asm)


def key_stats(spark: SparkSession, d: str, named: bool) -> DataFrame:
    """Per key: rows, mean identity (of the identities that are numbers) and summed mapped_len."""
    rows = _key_rows(spark, d)
    number = F.when(F.isnan("identity"), None).otherwise(F.col("identity"))
    return fragment_replicate.balanced_aggregate(
        rows,
        ["key_field", "key_value"],
        {"_n": F.count(F.lit(1)), "_ids": F.count(number), "_id_sum": F.sum(number), "_len": F.sum("mapped_len")},
        {"n_rows": F.sum("_n"), "mean_identity": F.round(F.sum("_id_sum") / F.sum("_ids"), 6), "sum_mapped_len": F.sum("_len")},
        right=_key_names(spark, d) if named else None,
    ).where(F.col("key_value").isNotNull() & (F.col("key_value") != ""))


def p2_key_stats(spark: SparkSession, d: str) -> DataFrame:
    return key_stats(spark, d, named=True).select("key_field", "key_value", "n_rows", "mean_identity", "sum_mapped_len", "label")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    total = load(spark, d, "alignments").count()
    return key_stats(spark, d, named=False).where(F.col("n_rows") >= HOT_SHARE * total).select("key_field", "key_value")


def _raw_headers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "raw_headers").select("raw_id", "kind", "line")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_records.failing(_raw_headers(spark, d)).select("raw_id", "reason")


def p3_valid(spark: SparkSession, d: str) -> DataFrame:
    return bad_records.valid(_raw_headers(spark, d)).select("raw_id", "kind", "parsed.*")


def merged_ids(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve_merged(load(spark, d, "tax_merged"))


def taxon_references(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, row_id, field, ref_id, loaded_at) of the current rows. Texts in contigs.fields that are
    no whole number refer to nothing that can exist: id -1."""
    refs = current_refs(spark, d)
    one = refs.select(F.lit("ref_meta").alias("table_name"), F.col("ref_id").alias("row_id"), "loaded_at", F.explode(F.array(F.struct(F.lit("taxid").alias("field"), F.col("taxid").alias("id")), F.struct(F.lit("fallback_taxid").alias("field"), F.col("fallback_taxid").alias("id")))).alias("r"))
    contigs = current_rows(load(spark, d, "contigs").select("contig_id", "fields", "loaded_at"), ["contig_id"], "loaded_at", F.col("fields"))
    number = lambda k: F.when(F.trim(F.get("fields", F.lit(k))) != "", F.coalesce(F.expr(f"try_cast(trim(get(fields, {k})) as bigint)"), F.lit(-1).cast("long")))
    two = contigs.select(F.lit("contigs").alias("table_name"), F.col("contig_id").alias("row_id"), "loaded_at", F.explode(F.array(F.struct(F.lit("taxid").alias("field"), number(1).alias("id")), F.struct(F.lit("fallback_taxid").alias("field"), number(2).alias("id")))).alias("r"))
    both = one.unionByName(two)
    return both.select("table_name", "row_id", F.col("r.field").alias("field"), F.col("r.id").alias("ref_id"), "loaded_at")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    nodes = load(spark, d, "tax_nodes").select("taxid", "loaded_at")
    return orphans.find_orphans(taxon_references(spark, d), nodes, load(spark, d, "tax_deleted").select("taxid"), merged_ids(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "row_id", "field", "reason")


def p5_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    month = F.date_format("loaded_at", "yyyy-MM").alias("month")
    return _orphans(spark, d).groupBy("table_name", "field", month, "reason").agg(F.count(F.lit(1)).alias("orphans"))


def taxon_links(spark: SparkSession, d: str) -> DataFrame:
    nodes = load(spark, d, "tax_nodes").select("taxid", "parent_taxid", "loaded_at")
    current = current_rows(nodes, ["taxid"], "loaded_at", F.col("parent_taxid").asc_nulls_last())
    return hierarchy.parent_links(current, merged_ids(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, unreached = hierarchy.reach(taxon_links(spark, d))
    return hierarchy.find_cycles(unreached).select(F.col("cycle_id").alias("cycle_taxid"), F.col("node").alias("taxid"))


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    reached, _ = hierarchy.build_hierarchy(taxon_links(spark, d))
    out = reached.join(hierarchy.descendant_counts(reached), "node", "left")
    return out.select(F.col("node").alias("taxid"), "root", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "descendants")


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    reached, _ = hierarchy.build_hierarchy(taxon_links(spark, d))
    return hierarchy.descendants(reached)


QUERIES = {f.__name__: f for f in (p1_found, p1_periods, p2_found, p2_key_stats, p3_found, p3_valid, p5_found, p5_orphan_counts, p7_found, p7_paths, p7_descendants)}

_REFS = "refs AS (SELECT * FROM ref_meta QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY loaded_at DESC) = 1)"
_SPANS = f"""{_REFS},
lens AS (SELECT ref_name, max(length) AS length FROM refs WHERE length IS NOT NULL GROUP BY 1),
base AS (SELECT sample_id, ref_name, length, greatest(s, 1) AS s, least(e, length + 1) AS e, s < e AS ok FROM worker_spans JOIN lens USING (ref_name)),
good AS (SELECT * FROM base WHERE ok AND s < e),
reach AS (SELECT *, max(e) OVER (PARTITION BY sample_id, ref_name ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM good)"""
_RESOLVED = """chain AS (
  SELECT DISTINCT old_taxid, new_taxid, 1 AS n FROM tax_merged
  UNION ALL SELECT c.old_taxid, m.new_taxid, n + 1 FROM chain c JOIN (SELECT DISTINCT old_taxid, new_taxid FROM tax_merged) m ON m.old_taxid = c.new_taxid WHERE n < 200),
resolved AS (
  SELECT m.old_taxid, f.new_taxid AS final_taxid FROM (SELECT DISTINCT old_taxid FROM tax_merged) m
  LEFT JOIN (SELECT old_taxid, new_taxid FROM chain WHERE new_taxid NOT IN (SELECT old_taxid FROM tax_merged)) f USING (old_taxid))"""
_ORPHANS = f"""WITH RECURSIVE {_RESOLVED}, {_REFS},
cont AS (SELECT * FROM contigs QUALIFY row_number() OVER (PARTITION BY contig_id ORDER BY loaded_at DESC) = 1),
given AS (
  SELECT 'ref_meta' AS table_name, ref_id AS row_id, 'taxid' AS field, taxid AS id, loaded_at FROM refs
  UNION ALL SELECT 'ref_meta', ref_id, 'fallback_taxid', fallback_taxid, loaded_at FROM refs
  UNION ALL SELECT 'contigs', contig_id, 'taxid', try_cast(nullif(trim(fields[2]), '') AS BIGINT), loaded_at FROM cont
  UNION ALL SELECT 'contigs', contig_id, 'fallback_taxid', try_cast(nullif(trim(fields[3]), '') AS BIGINT), loaded_at FROM cont),
judged AS (
  SELECT g.table_name, g.row_id, g.field, g.loaded_at,
    CASE WHEN r.old_taxid IS NOT NULL AND r.final_taxid IS NULL THEN 'missing'
         WHEN coalesce(r.final_taxid, g.id) IN (SELECT taxid FROM tax_deleted) THEN 'deleted'
         WHEN n.taxid IS NULL THEN 'missing'
         WHEN n.since > g.loaded_at THEN 'late' END AS reason
  FROM given g LEFT JOIN resolved r ON r.old_taxid = g.id
  LEFT JOIN (SELECT taxid, min(loaded_at) AS since FROM tax_nodes GROUP BY 1) n ON n.taxid = coalesce(r.final_taxid, g.id)
  WHERE g.id IS NOT NULL AND g.id <> 0)"""
_TREE = f"""WITH RECURSIVE {_RESOLVED},
cur AS (SELECT taxid, parent_taxid FROM tax_nodes WHERE taxid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY taxid ORDER BY loaded_at DESC) = 1),
nodes AS (SELECT * FROM cur WHERE taxid NOT IN (SELECT old_taxid FROM tax_merged)),
links AS (
  SELECT n.taxid, p.taxid AS parent FROM nodes n LEFT JOIN resolved r ON r.old_taxid = n.parent_taxid
  LEFT JOIN nodes p ON p.taxid = (CASE WHEN r.old_taxid IS NULL THEN n.parent_taxid ELSE r.final_taxid END) AND p.taxid <> n.taxid),
tree AS (
  SELECT taxid, taxid AS root, 0 AS depth, CAST(taxid AS VARCHAR) AS path, [taxid] AS way FROM links WHERE parent IS NULL
  UNION ALL SELECT l.taxid, t.root, t.depth + 1, t.path || '/' || l.taxid, list_append(t.way, l.taxid) FROM links l JOIN tree t ON l.parent = t.taxid)"""

SQL = {
    "p1_found": f"""WITH {_SPANS},
edges AS (
  SELECT sample_id, ref_name, coalesce(before, 1) AS gap_start, s AS gap_end FROM reach WHERE s > coalesce(before, 1)
  UNION ALL
  SELECT b.sample_id, b.ref_name, coalesce(max(g.e), 1), any_value(b.length) + 1
  FROM (SELECT DISTINCT sample_id, ref_name, length FROM base) b LEFT JOIN good g ON g.sample_id IS NOT DISTINCT FROM b.sample_id AND g.ref_name = b.ref_name GROUP BY 1, 2)
SELECT sample_id, ref_name, gap_start, gap_end FROM edges WHERE gap_start < gap_end""",
    "p1_periods": f"""WITH {_SPANS},
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id, ref_name ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reach)
SELECT sample_id, ref_name, min(s) AS period_start, max(e) AS period_end FROM marked GROUP BY sample_id, ref_name, island""",
    "p2_found": """WITH k AS (
  SELECT 'species_taxid' AS key_field, CAST(species_taxid AS VARCHAR) AS key_value FROM alignments
  UNION ALL SELECT 'asm', asm FROM alignments)
SELECT key_field, key_value FROM k WHERE key_value IS NOT NULL AND key_value <> '' GROUP BY 1, 2 HAVING count(*) >= 0.02 * (SELECT count(*) FROM alignments)""",
    "p2_key_stats": f"""WITH {_REFS}, k AS (
  SELECT 'species_taxid' AS key_field, CAST(species_taxid AS VARCHAR) AS key_value, identity, mapped_len FROM alignments
  UNION ALL SELECT 'asm', asm, identity, mapped_len FROM alignments),
labels AS (
  SELECT 'species_taxid' AS key_field, CAST(taxid AS VARCHAR) AS key_value, sci_name AS label FROM (SELECT * FROM tax_nodes QUALIFY row_number() OVER (PARTITION BY taxid ORDER BY loaded_at DESC) = 1)
  UNION ALL SELECT 'asm', asm, count(*) || ' references' FROM refs GROUP BY asm)
SELECT key_field, key_value, count(*) AS n_rows, round(avg(identity) FILTER (WHERE NOT isnan(identity)), 6) AS mean_identity, CAST(sum(mapped_len) AS BIGINT) AS sum_mapped_len, any_value(label) AS label
FROM k LEFT JOIN labels USING (key_field, key_value) WHERE key_value IS NOT NULL AND key_value <> '' GROUP BY 1, 2""",
    "p5_found": f"{_ORPHANS} SELECT table_name, row_id, field, reason FROM judged WHERE reason IS NOT NULL",
    "p5_orphan_counts": f"{_ORPHANS} SELECT table_name, field, strftime(loaded_at, '%Y-%m') AS month, reason, count(*) AS orphans FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2, 3, 4",
    "p7_paths": f"""{_TREE}, below AS (SELECT unnest(way) AS taxid FROM tree)
SELECT taxid, root, depth, path, n - 1 AS descendants FROM tree JOIN (SELECT taxid, count(*) AS n FROM below GROUP BY 1) USING (taxid)""",
    "p7_descendants": f"{_TREE} SELECT ancestor, descendant FROM (SELECT unnest(way) AS ancestor, taxid AS descendant FROM tree) WHERE ancestor <> descendant",
    "p7_found": f"""{_TREE},
lost AS (SELECT * FROM links WHERE taxid NOT IN (SELECT taxid FROM tree)),
walk AS (SELECT taxid, parent AS stop FROM lost UNION SELECT w.taxid, l.parent FROM walk w JOIN lost l ON l.taxid = w.stop),
looped AS (SELECT taxid FROM walk WHERE taxid = stop)
SELECT min(stop) AS cycle_taxid, taxid FROM walk WHERE stop IN (SELECT taxid FROM looped) GROUP BY taxid""",
}

# A field of a header: plain, or quoted with doubled quotes inside, and white space around it.
_WS = r"[ \t\r\n]*"
_FIELD = rf'{_WS}(?:"(?:[^"]|"")*"{_WS}|[^|"]*)'
_STRIP = "' ' || chr(9) || chr(13) || chr(10)"
_HEADERS = rf"""WITH lines AS (SELECT raw_id, kind, trim(line, {_STRIP}) AS line FROM raw_headers WHERE line IS NOT NULL AND trim(line, {_STRIP}) <> ''),
tagged AS (SELECT *, CASE WHEN kind = 'sq' THEN list_transform(string_split(line, chr(9))[2:], lambda t: trim(t, {_STRIP})) ELSE [] END AS tags FROM lines),
heads AS (
  SELECT raw_id, kind, CASE WHEN kind = 'fasta' THEN starts_with(line, '>') WHEN kind = 'sq' THEN trim(string_split(line, chr(9))[1], {_STRIP}) = '@SQ' ELSE false END AS known,
    CASE WHEN kind = 'sq' THEN list_transform(list_filter(tags, lambda t: starts_with(t, 'SN:')), lambda t: substr(t, 4)) ELSE [substr(line, 2)] END AS hs,
    CASE WHEN kind = 'sq' THEN list_transform(list_filter(tags, lambda t: starts_with(t, 'LN:')), lambda t: trim(substr(t, 4), {_STRIP})) ELSE ['1'] END AS lns FROM tagged),
checked AS (
  SELECT *, len(list_filter(hs, lambda h: NOT regexp_full_match(h, '{_FIELD}(?:\|{_FIELD})*'))) > 0 AS broken,
    list_transform(regexp_extract_all(hs[1] || '|', '({_FIELD})\|', 1), lambda x: trim(x, {_STRIP})) AS raw FROM heads),
cells AS (SELECT *, list_transform(raw, lambda x: CASE WHEN starts_with(x, '"') THEN trim(replace(substr(x, 2, length(x) - 2), '""', '"'), {_STRIP}) ELSE x END) AS f FROM checked),
nums AS (
  SELECT *, list_transform([f[2], f[3], f[5], coalesce(f[6], '1'), lns[1]], lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN try_cast(x AS HUGEINT) END) AS n FROM cells),
judged AS (
  SELECT *, CASE WHEN NOT known THEN 'columns' WHEN broken THEN 'quoting' WHEN len(hs) <> 1 OR len(lns) <> 1 OR len(f) NOT IN (5, 6) THEN 'columns'
    WHEN f[1] = '' OR f[4] = '' OR regexp_matches(f[1], '[ \t\r\n]') OR regexp_matches(f[4], '[ \t\r\n]')
      OR NOT coalesce(n[1] BETWEEN 1 AND 4294967295 AND n[2] BETWEEN 1 AND 4294967295 AND n[3] BETWEEN 1 AND 9223372036854775807 AND n[4] BETWEEN 1 AND 9223372036854775807 AND n[5] BETWEEN 1 AND 9223372036854775807, false)
      OR n[4] > n[3] THEN 'value' END AS reason FROM nums)"""
SQL["p3_found"] = f"{_HEADERS} SELECT raw_id, reason FROM judged WHERE reason IS NOT NULL"
SQL["p3_valid"] = f"""{_HEADERS} SELECT raw_id, kind, f[1] AS asm, CAST(n[1] AS BIGINT) AS taxid, CAST(n[2] AS BIGINT) AS species_taxid, f[4] AS acc, CAST(n[3] AS BIGINT) AS genome_size,
  CASE WHEN len(f) = 6 THEN CAST(n[4] AS BIGINT) END AS sampled_size, CASE WHEN kind = 'sq' THEN CAST(n[5] AS BIGINT) END AS length FROM judged WHERE reason IS NULL"""
