"""Lineages, ranks and majority ancestors over taxonomy tables.

Lineages replace a retired id once per hop, end at a node that is its own parent or whose parent isn't there, and
otherwise at the root 1. Nodes on or below a cycle have no lineage. They are built once for the whole
tree by level-wise joins (``operators.hierarchy``); all else are joins with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.operators import hierarchy
from cladeflow.sources.tables import Taxonomy

ROOT = 1


def once_replaced(df: DataFrame, column: str, merged: DataFrame, out: str) -> DataFrame:
    m = merged.where(F.col("old_taxid").isNotNull()).groupBy(F.col("old_taxid").alias("_old")).agg(F.min("new_taxid").alias("_new"))
    return df.join(m, df[column] == m["_old"], "left").withColumn(out, F.coalesce("_new", F.col(column))).drop("_old", "_new")


def lineages(tax: Taxonomy) -> DataFrame:
    """(taxid, path): the nodes from the root down to the taxid itself."""
    nodes = tax.nodes.where(F.col("taxid").isNotNull()).select("taxid", "parent_taxid")
    links = once_replaced(nodes, "parent_taxid", tax.merged, "_p").select(F.col("taxid").alias("node"), F.when(F.col("parent_taxid") == ROOT, F.lit(ROOT)).otherwise(F.col("_p")).cast("long").alias("_p"))
    # a parent of 1 ends the walk there, whether or not 1 is a node
    links = links.where(F.col("node") != ROOT).unionByName(nodes.sparkSession.createDataFrame([(ROOT, None)], "node long, _p long"))
    known = links.select(F.col("node").alias("_n"))
    linked = links.join(known, links["_p"] == known["_n"], "left").select("node", F.when(F.col("_n") != F.col("node"), F.col("_n")).alias("parent"))
    reached, _ = hierarchy.build_hierarchy(linked)
    return reached.select(F.col("node").alias("taxid"), "path")


def rank_ancestors(lineage: DataFrame, tax: Taxonomy, rank: str) -> DataFrame:
    """(taxid, ancestor): the nearest node of the rank on the way up, the taxid itself included."""
    steps = lineage.select("taxid", F.posexplode("path").alias("level", "node"))
    ranked = tax.nodes.where(F.col("rank") == rank).select(F.col("taxid").alias("node"))
    return steps.join(ranked, "node").groupBy("taxid").agg(F.max_by("node", "level").alias("ancestor"))


def species_and_genus(ids: DataFrame, column: str, tax: Taxonomy, lineage: DataFrame) -> DataFrame:
    """``ids`` with ``species_taxid`` (the nearest species on the way up, else the id as given) and ``genus_taxid``; one pass over
    the paths of the ids asked for finds both."""
    paths = of_ids(ids, column, tax, lineage, "_path")
    steps = paths.select(column, F.posexplode("_path").alias("_level", "_node"))
    ranked = tax.nodes.where(F.col("rank").isin("species", "genus")).select(F.col("taxid").alias("_node"), F.col("rank").alias("_rank"))
    nearest = lambda rank: F.max_by("_node", F.when(F.col("_rank") == rank, F.col("_level")))
    found = steps.join(ranked, "_node").groupBy(column).agg(nearest("species").alias("_s"), nearest("genus").alias("genus_taxid"))
    return ids.join(found, column, "left").withColumn("species_taxid", F.coalesce("_s", column)).drop("_s")


def of_ids(ids: DataFrame, column: str, tax: Taxonomy, by_taxid: DataFrame, out: str) -> DataFrame:
    """``ids`` with ``out`` from (taxid, value), after replacing retired ids once; null where there is none."""
    value = [c for c in by_taxid.columns if c != "taxid"][0]
    t = by_taxid.select(F.col("taxid").alias("_t"), F.col(value).alias(out))
    r = once_replaced(ids, column, tax.merged, "_id")
    return r.join(t, r["_id"] == t["_t"], "left").drop("_id", "_t")


def labels(ids: DataFrame, column: str, tax: Taxonomy) -> DataFrame:
    """``ids`` with ``name`` and ``rank``, both null for deleted and unknown ids."""
    r = once_replaced(ids, column, tax.merged, "_id")
    gone = tax.deleted.select(F.col("taxid").alias("_id")).distinct().withColumn("_gone", F.lit(True))
    names = tax.names.select(F.col("taxid").alias("_id"), F.col("sci_name").alias("name"))
    ranks = tax.nodes.select(F.col("taxid").alias("_id"), "rank")
    j = r.join(gone, "_id", "left").join(names, "_id", "left").join(ranks, "_id", "left")
    there = F.col("_gone").isNull()
    return j.withColumn("name", F.when(there, F.col("name"))).withColumn("rank", F.when(there, F.col("rank"))).drop("_id", "_gone")


def majority_lca(members: DataFrame, lineage: DataFrame, tax: Taxonomy, cutoff: float = 0.7) -> DataFrame:
    """(class_id, lca) from (class_id, taxid): the deepest node that, at its level, at least ``cutoff`` of the
    class's members share. Members without a lineage count among the members."""
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("_n"))
    paths = of_ids(members, "taxid", tax, lineage, "path")
    steps = paths.select("class_id", F.posexplode("path").alias("level", "node"))
    counts = steps.groupBy("class_id", "level", "node").agg(F.count(F.lit(1)).alias("_k"))
    enough = counts.join(sizes, "class_id").where(F.col("_k") >= F.ceil(F.lit(cutoff) * F.col("_n")))
    return enough.groupBy("class_id").agg(F.max_by("node", "level").alias("lca"))
