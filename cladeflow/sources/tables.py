"""Taxonomy dumps, host tables, FASTA and the text sinks."""

from __future__ import annotations

import gzip
import os
import shutil
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Taxonomy:
    """nodes (taxid, parent_taxid, rank), names (taxid, sci_name), merged (old_taxid, new_taxid), deleted (taxid)."""

    nodes: DataFrame
    names: DataFrame
    merged: DataFrame
    deleted: DataFrame


def _cells(spark: SparkSession, path: str) -> tuple[DataFrame, list[Column]]:
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("_at"), F.split("value", r"\s*\|\s*").alias("c"))
    return rows, [F.trim(F.get("c", F.lit(k))) for k in range(4)]


def _last_wins(df: DataFrame, key: str) -> DataFrame:
    columns = [c for c in df.columns if c not in (key, "_at")]
    return df.groupBy(key).agg(*[F.max_by(c, "_at").alias(c) for c in columns])


def read_dmp(spark: SparkSession, folder: str) -> Taxonomy:
    """``*.dmp`` of a taxonomy dump. Ids that aren't numbers are errors, but in delnodes, which may also be missing."""
    n, c = _cells(spark, os.path.join(folder, "nodes.dmp"))
    nodes = _last_wins(n.where(F.size("c") >= 3).select("_at", c[0].cast("long").alias("taxid"), c[1].cast("long").alias("parent_taxid"), c[2].alias("rank")), "taxid")
    n, c = _cells(spark, os.path.join(folder, "names.dmp"))
    named = n.where((F.size("c") >= 4) & c[3].contains("scientific name"))
    names = _last_wins(named.select("_at", c[0].cast("long").alias("taxid"), c[1].alias("sci_name")), "taxid")
    n, c = _cells(spark, os.path.join(folder, "merged.dmp"))
    merged = _last_wins(n.where(F.size("c") >= 2).select("_at", c[0].cast("long").alias("old_taxid"), c[1].cast("long").alias("new_taxid")), "old_taxid")
    path = os.path.join(folder, "delnodes.dmp")
    if os.path.exists(path):
        n, c = _cells(spark, path)
        deleted = n.select(c[0].try_cast("long").alias("taxid")).where(F.col("taxid").isNotNull()).distinct()
    else:
        deleted = spark.createDataFrame([], "taxid long")
    return Taxonomy(nodes, names, merged, deleted)


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, host_taxids, host_names, diseases): a header line, rows of under 4 cells skipped, the last row of an id holds."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("_at"), F.split("value", "\t").alias("c"))
    first = rows.agg(F.min("_at").alias("a")).first()["a"]
    cell = lambda k: F.trim(F.get("c", F.lit(k)))
    good = rows.where((F.col("_at") != F.lit(first if first is not None else -1)) & (F.size("c") >= 4))
    return _last_wins(good.select("_at", cell(0).cast("long").alias("taxid"), cell(1).alias("host_taxids"), cell(2).alias("host_names"), cell(3).alias("diseases")), "taxid")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(genome_id, genome_size, contig_idx, fields, seq, ordinal): a record is its header and the lines below. Headers of under
    five fields are errors; of a genome's declared sizes the last one holds. Contigs count from 0."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.regexp_replace("value", r"^>", "").alias("r"))
    raw = raw.where(F.trim("r") != "")
    head = F.regexp_extract("r", r"^[^\r\n]*", 0)
    parts = raw.select("ordinal", F.transform(F.split(head, r"\|"), lambda x: F.trim(x)).alias("fields"), F.regexp_replace(F.regexp_replace("r", r"^[^\r\n]*", ""), r"\s", "").alias("seq"))
    parts = parts.withColumn("fields", F.when(F.size("fields") >= 5, F.col("fields")).otherwise(F.raise_error(F.concat(F.lit("a header needs five fields: "), F.array_join("fields", "|")))))
    genome = Window.partitionBy(F.get("fields", F.lit(0))).orderBy("ordinal")
    size = F.last(F.get("fields", F.lit(4)).cast("long")).over(genome.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return parts.select(F.get("fields", F.lit(0)).alias("genome_id"), size.alias("genome_size"), (F.row_number().over(genome) - 1).alias("contig_idx"), "fields", "seq", "ordinal")


def _one_file(lines: DataFrame, path: str) -> None:
    """``lines`` (value) as the file ``path``: written in parallel beside it, the parts then put together in order, in the file
    system that the path names. The driver streams bytes, it holds no rows."""
    jvm, session = lines.sparkSession._jvm, lines.sparkSession._jsparkSession
    conf, fs_path = session.sessionState().newHadoopConf(), jvm.org.apache.hadoop.fs.Path
    parts, target = fs_path(f"{path}._parts"), fs_path(path)
    lines.write.mode("overwrite").text(parts.toString())
    fs = target.getFileSystem(conf)
    fs.delete(target, True)
    out = fs.create(target, True)
    try:
        for name in sorted(s.getPath().toString() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")):
            part = fs.open(fs_path(name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    finally:
        out.close()
    fs.delete(parts, True)


def write_tsv(df: DataFrame, path: str) -> None:
    """A headerless tab-separated file, in the order of ``df``."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    _one_file(df.select(F.concat_ws("\t", *text).alias("value")), path)


def fasta_text(records: DataFrame, header: str = "header", seq: str = "seq", width: int = 60) -> Column:
    """A record as FASTA text, its sequence wrapped."""
    wrapped = F.regexp_replace(F.regexp_replace(F.col(seq), f"(.{{{width}}})", "$1\n"), r"\n$", "")
    return F.concat(F.lit(">"), F.col(header), F.lit("\n"), wrapped)


def gzip_file(path: str) -> str | None:
    """Compress a local file and remove the original; nothing to do if it is missing or has the ending already."""
    if path.endswith(".gz") or not os.path.exists(path):
        return None
    with open(path, "rb") as a, gzip.open(path + ".gz", "wb") as b:
        shutil.copyfileobj(a, b, 1 << 20)
    os.remove(path)
    return path + ".gz"
