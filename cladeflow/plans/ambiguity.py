"""Reads with several candidate taxa: classes, what the certain taxa make of them, majority ancestors.

A class is the sorted set of a read's candidate taxa. All decisions look at the certain taxa as they were before any class
was resolved, so the order of the classes doesn't matter.

``class`` is that set itself, or its number in a table of classes: a read of many thousand candidates has a row for each, and with the
set in each of them they would grow with the square of the candidates. Numbers have the same results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeflow.plans import taxa
from cladeflow.session import cut_lineage, store
from cladeflow.sources.tables import Taxonomy


def with_class(best: DataFrame, coverage: DataFrame | None = None, min_breadth: float = 0.0) -> DataFrame:
    """(read_name, taxid, rank, depth, maplen, class): candidates with breadth enough, and their read's class."""
    return _broad(best, coverage, min_breadth).withColumn("class", F.array_sort(F.collect_set("taxid").over(Window.partitionBy("read_name"))))


def _broad(best: DataFrame, coverage: DataFrame | None, min_breadth: float) -> DataFrame:
    rows = best.select("read_name", "taxid", "rank", "depth", F.col("mapped_len").cast("double").alias("maplen"))
    if coverage is None:
        return rows
    cov = coverage.select("taxid", "breadth")
    return rows.join(cov, "taxid", "left").where(F.coalesce("breadth", F.lit(0.0)) >= min_breadth).drop("breadth")


def numbered(best: DataFrame, coverage: DataFrame | None = None, min_breadth: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(``with_class`` with the number of the class, null for a read with one candidate; (class, members) of the numbers). A class's set is
    in one row of its reads and one of the classes, so everything grows with the candidates."""
    rows = store(_broad(best, coverage, min_breadth))
    sets = store(rows.groupBy(F.col("read_name").alias("_read")).agg(F.array_sort(F.collect_set("taxid")).alias("members")).where(F.size("members") > 1))
    classes = store(sets.select("members").distinct().withColumn("class", F.monotonically_increasing_id()))
    reads = sets.join(classes, "members").select("_read", "class")
    return store(rows.join(reads, F.col("read_name").eqNullSafe(F.col("_read")), "left").drop("_read")), classes


def _by_set(df: DataFrame) -> bool:
    return isinstance(df.schema["class"].dataType, T.ArrayType)


def is_shared(df: DataFrame) -> Column:
    """Whether a row's read has several candidates."""
    return F.size("class") > 1 if _by_set(df) else F.col("class").isNotNull()


def with_members(df: DataFrame, classes: DataFrame | None) -> DataFrame:
    """``df`` with ``members``, the set of its class; ``classes`` says which, if classes are numbers."""
    return df.withColumn("members", F.col("class")) if classes is None else df.join(classes, "class")


def certain(classed: DataFrame) -> DataFrame:
    """(taxid, n, depth, maplen) of the reads with one candidate."""
    return classed.where(~is_shared(classed)).groupBy("taxid").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("depth").alias("depth"), F.sum("maplen").alias("maplen"))


def class_members(classed: DataFrame) -> DataFrame:
    """(class, taxid, n, depth, maplen): a class's reads, and each member's sums over them."""
    return classed.where(is_shared(classed)).groupBy("class", "taxid").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("depth").alias("depth"), F.sum("maplen").alias("maplen"))


def support(members: DataFrame, known: DataFrame) -> DataFrame:
    """``members`` with ``ok`` (the taxon is certain) and ``n_ok`` and ``size`` of the class."""
    flags = known.select("taxid").withColumn("_ok", F.lit(True))
    by = Window.partitionBy("class")
    j = members.join(flags, "taxid", "left").withColumn("ok", F.coalesce("_ok", F.lit(False))).drop("_ok")
    return j.withColumn("n_ok", F.sum(F.col("ok").cast("long")).over(by)).withColumn("size", F.count(F.lit(1)).over(by))


@dataclass(frozen=True)
class Resolved:
    known: DataFrame
    members: DataFrame
    #: (class, lca) of the classes that went to an ancestor.
    ancestors: DataFrame
    #: (taxid, breadth, fixed_chunk, flex_chunk) with those ancestors' own.
    coverage: DataFrame


def prune(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes with some certain members, not all: ((taxid, n, depth, maplen) of those with one, and the members of the others
    under the class of their certain members). The whole count stays, what the dropped members had goes. A class with a number keeps it: shares
    are the same whether or not classes of the same members are put together."""
    kept = marked.where((F.col("n_ok") > 0) & (F.col("n_ok") < F.col("size")) & F.col("ok"))
    one = kept.where(F.col("n_ok") == 1).select("taxid", "n", "depth", "maplen")
    rest = kept.where(F.col("n_ok") > 1)
    if _by_set(marked):
        rest = rest.withColumn("class", F.array_sort(F.collect_set("taxid").over(Window.partitionBy("class"))))
    return one, rest.select("class", "taxid", "n", "depth", "maplen")


def lca_classes(open_: DataFrame, lineage: DataFrame, tax: Taxonomy) -> DataFrame:
    """(class, lca) for classes (class, taxid, ...) with a majority ancestor."""
    ids = open_.select(F.col("class").alias("class_id"), "taxid")
    return taxa.majority_lca(ids, lineage, tax).where(F.col("lca").isNotNull()).select(F.col("class_id").alias("class"), "lca")


def lca_gains(open_: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(taxid, n, depth, maplen): an ancestor gains a class's count and the mean over members of its sums."""
    by_class = open_.join(ancestors, "class").groupBy("class", "lca").agg(F.max("n").alias("n"), F.avg("depth").alias("depth"), F.avg("maplen").alias("maplen"))
    return by_class.select(F.col("lca").alias("taxid"), "n", "depth", "maplen")


def add_up(*parts: DataFrame) -> DataFrame:
    rows = parts[0].select("taxid", "n", "depth", "maplen")
    for p in parts[1:]:
        rows = rows.unionByName(p.select("taxid", "n", "depth", "maplen"))
    return rows.groupBy("taxid").agg(F.sum("n").alias("n"), F.sum("depth").alias("depth"), F.sum("maplen").alias("maplen"))


def resolve(known: DataFrame, members: DataFrame, coverage: DataFrame, lineage: DataFrame, tax: Taxonomy) -> Resolved:
    """Species level: classes of certain members stay, those of some are pruned to them, those of none go to their majority
    ancestor or are dropped."""
    marked = support(members, known)
    one, pruned = prune(marked)
    none = marked.where(F.col("n_ok") == 0)
    ancestors = cut_lineage(lca_classes(none, lineage, tax))
    whole = marked.where(F.col("n_ok") == F.col("size")).select("class", "taxid", "n", "depth", "maplen")
    merged = whole.unionByName(pruned).groupBy("class", "taxid").agg(F.sum("n").alias("n"), F.sum("depth").alias("depth"), F.sum("maplen").alias("maplen"))
    kinds = ("breadth", "fixed_chunk", "flex_chunk")
    over = none.join(ancestors, "class").join(coverage, "taxid").groupBy(F.col("lca").alias("taxid")).agg(*[F.max(k).alias(f"_{k}") for k in kinds])
    replaced = coverage.join(over, "taxid", "full_outer").select("taxid", *[F.coalesce(f"_{k}", k).alias(k) for k in kinds])
    return Resolved(add_up(known, one, lca_gains(none, ancestors)), merged, ancestors, replaced)


def resolve_strain(known: DataFrame, members: DataFrame, lineage: DataFrame, tax: Taxonomy) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(known, members, first state, ancestors): any certain member keeps the class whole; without one it goes to its ancestor, or
    stays. The first state gives every uncertain member a trace."""
    from cladeflow.plans.em import PSEUDO

    marked = support(members, known)
    none = marked.where(F.col("n_ok") == 0)
    ancestors = cut_lineage(lca_classes(none, lineage, tax))
    trace = members.select("taxid").distinct().join(known.select("taxid"), "taxid", "left_anti").select("taxid", *[F.lit(v).alias(c) for v, c in zip(PSEUDO, ("n", "depth", "maplen"))])
    left = members.join(ancestors.select("class"), "class", "left_anti").select("class", "taxid", "n", "depth", "maplen")
    return add_up(known, lca_gains(none, ancestors)), left, known.select("taxid", "n", "depth", "maplen").unionByName(trace), ancestors
