"""Parent-child links to full hierarchies, and the resolution of replaced ids (problem 7).

``resolve_merged`` follows replacements by pointer doubling: after k rounds every id within 2^k
replacements of its end has arrived, so a round that brings no id home proves that the rest runs in
circles.

``reach`` moves a frontier of levels down from the roots. Every node below it holds the ancestor that its links have
led to so far; a join with the nodes themselves tells whether that ancestor has been reached, which reaches the node,
or how much further up it leads. So the frontier of round k covers all levels below 2^k, each band of levels as deep as all
before, and a tree of any depth, a chain too, takes few rounds. Levels have no holes: a round that reaches nothing proves
that all that is left lies on or below a cycle. Only numbers move here, so a cycle costs no more than a tree.

``build_hierarchy`` then extends the paths of what was reached by the same joins. Paths hold the ancestor pairs, from which
descendants are counted or listed. Every round is written to the checkpoint folder, so the plan doesn't grow with the depth, and joined by
fragment and replicate, as an ancestor may be that of a third of all nodes. Pointer doubling over the unreached nodes alone carries the
smallest id of the next 2^k steps along, which on the cycle is the smallest id of the cycle.

Defined results: a null, absent or endlessly replaced parent, or being one's own parent, makes a root;
a null id is no node; of rows with equal ids the caller keeps one (``current_rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeflow.operators.fragment_replicate import key_loads, spread_join
from cladeflow.session import discard, store


def resolve_merged(merged: DataFrame, old: str = "old_taxid", new: str = "new_taxid") -> DataFrame:
    """(old_id, final_id) for each replaced id; final_id is null where the replacement is endless.
    A null replacement ends a chain at the id itself being unknown (null). Rows that name two
    replacements of one id: the smaller id holds, so that results don't depend on the row order."""
    step = merged.where(F.col(old).isNotNull()).groupBy(F.col(old).cast("long").alias("old_id")).agg(F.min(F.col(new).cast("long")).alias("to"))
    step = store(step)
    open_before = -1
    while True:
        nxt = step.select(F.col("old_id").alias("_o"), F.col("to").alias("_t"))
        joined = step.join(nxt, step["to"] == nxt["_o"], "left")
        open_now = joined.where(F.col("_o").isNotNull()).count()
        if open_now in (0, open_before):
            break
        open_before = open_now
        step = store(joined.select("old_id", F.when(F.col("_o").isNotNull(), F.col("_t")).otherwise(F.col("to")).alias("to")))
    return joined.select("old_id", F.when(F.col("_o").isNull(), F.col("to")).alias("final_id"))


def replace_ids(df: DataFrame, column: str, resolved: DataFrame, out: str, endless: str | None = None) -> DataFrame:
    """``df`` with ``out``: the id that ``column`` stands for, and ``endless`` (boolean) if asked for."""
    r = resolved.select(F.col("old_id").alias("_old"), F.col("final_id").alias("_final"))
    j = df.join(r, df[column] == r["_old"], "left")
    j = j.withColumn(out, F.when(F.col("_old").isNull(), F.col(column)).otherwise(F.col("_final")))
    if endless:
        j = j.withColumn(endless, F.col("_old").isNotNull() & F.col("_final").isNull())
    return j.drop("_old", "_final")


def parent_links(nodes: DataFrame, resolved: DataFrame | None, node: str = "taxid", parent: str = "parent_taxid") -> DataFrame:
    """(node, parent): one row per node; a root's parent is null. Replaced ids are no nodes."""
    links = nodes.where(F.col(node).isNotNull()).select(F.col(node).cast("long").alias("node"), F.col(parent).cast("long").alias("_p"))
    if resolved is not None:
        links = links.join(resolved, links["node"] == resolved["old_id"], "left_anti")
        links = replace_ids(links, "_p", resolved, "_to")
    else:
        links = links.withColumn("_to", F.col("_p"))
    known = links.select(F.col("node").alias("_n"))
    links = links.join(known, links["_to"] == known["_n"], "left")
    return links.select("node", F.when(F.col("_n") != F.col("node"), F.col("_n")).alias("parent"))


def _rounds(links: DataFrame, held: Column, join_held) -> tuple[DataFrame, DataFrame]:
    """(reached, unreached) of (node, parent), each with ``held``: what a node holds of the way to its ancestor ``top``.
    ``join_held`` puts the ancestor's and the node's together. ``top`` is null once a root is reached, which is ``root``."""
    first = links.select("node", "parent", F.col("parent").alias("top"), F.when(F.col("parent").isNull(), F.col("node")).alias("root"), held.alias("held"))
    first = store(first)
    done, open_ = first.where(F.col("top").isNull()), first.where(F.col("top").isNotNull())
    loads = key_loads(open_, "top")
    left = sum(loads[1].values())
    while left:
        above = done.unionByName(open_).select(F.col("node").alias("top"), F.col("top").alias("_top"), F.col("root").alias("_root"), F.col("held").alias("_held"))
        moved = spread_join(open_, above, "top", salt=F.xxhash64("node"), loads=loads)
        moved = store(moved.select("node", "parent", F.col("_top").alias("top"), F.col("_root").alias("root"), join_held("_held", "held").alias("held")))
        loads = key_loads(moved.where(F.col("top").isNotNull()), "top")
        still = sum(loads[1].values())
        if still == left:
            break
        done, open_, left = done.unionByName(moved.where(F.col("top").isNull())), moved.where(F.col("top").isNotNull()), still
    return done, open_


def reach(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (node, parent) the reached nodes (node, parent, root, depth) and the unreached (node, parent)."""
    steps = F.when(F.col("parent").isNull(), 0).otherwise(1)
    done, open_ = _rounds(links, steps, lambda above, own: F.col(above) + F.col(own))
    return done.select("node", "parent", "root", F.col("held").alias("depth")), open_.select("node", "parent")


def build_hierarchy(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (node, parent) the reached nodes (node, parent, root, depth, path; the path runs from the root
    to the node) and the unreached (node, parent)."""
    reached, unreached = reach(links)
    done, _ = _rounds(reached.select("node", "parent"), F.array("node"), lambda above, own: F.concat(above, own))
    return done.select("node", "parent", "root", (F.size("held") - 1).alias("depth"), F.col("held").alias("path")), unreached


def find_cycles(unreached: DataFrame) -> DataFrame:
    """(cycle_id, node) for each node on or below a cycle; ``unreached`` must hold all nodes of each cycle. The nodes that
    all steps so far lead to get fewer until only those on cycles are left; once they and all smallest ids stay as they
    are when the steps double, every cycle has been gone round."""
    step = store(unreached.select("node", F.col("parent").alias("to"), F.col("node").alias("low")))
    ends = -1
    while True:
        last = step
        nxt = last.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        ahead = spread_join(last.select("node", "to", "low"), nxt, "to", salt=F.xxhash64("node"))
        step = store(ahead.select("node", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("_moved")))
        discard(last)
        seen = step.agg(F.count_distinct("to").alias("ends"), F.count_if("_moved").alias("moved")).first()
        if seen["ends"] == ends and seen["moved"] == 0:
            break
        ends = seen["ends"]
    landed = step.select(F.col("node").alias("to"), F.col("low").alias("cycle_id"))
    return spread_join(step.select("node", "to"), landed, "to", salt=F.xxhash64("node")).select("cycle_id", "node")


def descendant_counts(reached: DataFrame) -> DataFrame:
    """(node, descendants): from the ancestor pairs in the paths, counted in part before the shuffle."""
    pairs = reached.select(F.explode("path").alias("node"))
    return pairs.groupBy("node").agg((F.count(F.lit(1)) - 1).alias("descendants"))


def descendants(reached: DataFrame) -> DataFrame:
    """(ancestor, descendant) for all proper pairs."""
    return reached.select(F.explode("path").alias("ancestor"), F.col("node").alias("descendant")).where(F.col("ancestor") != F.col("descendant"))
