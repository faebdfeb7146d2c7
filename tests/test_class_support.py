import os

import pytest
from pyspark.sql import functions as F

from cladeflow.plans import profile
from cladeflow.queries import profiling
from tests.test_queries import DIR, canon, db  # noqa: F401


def test_every_kind_of_support_with_all_certain_taxa(spark):
    sums = "n double, depth double, maplen double"
    known = spark.createDataFrame([(t, 1.0, 0.1, 10.0) for t in (1, 2, 3)], f"taxid long, {sums}")
    members = spark.createDataFrame([(c, t, 2.0, 0.2, 20.0) for c in ([1, 3], [1, 2, 9], [3, 8], [8, 9]) for t in c], f"class array<long>, taxid long, {sums}")
    kinds = {(r["class"], r["taxid"]): (r["ok"], r["n_ok"], r["kind"]) for r in profiling._class_support(known, members).collect()}
    assert kinds[("1,3", 1)] == (True, 2, "all") and kinds[("1,2,9", 1)] == (True, 2, "some") and kinds[("1,2,9", 9)] == (False, 2, "some")
    assert kinds[("3,8", 3)] == (True, 1, "some") and kinds[("8,9", 8)] == (False, 0, "none")
    assert {(r["class"], r["taxid"], r["n"]) for r in profiling._class_prune(known, members).collect()} == {("1,2", 1, 2.0), ("1,2", 2, 2.0), ("3", 3, 2.0)}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", ["class_support_all", "class_prune_all"])
def test_all_certain_taxa_against_sql(spark, db, name):  # noqa: F811
    df = profiling.QUERIES[name](spark, DIR)
    order = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(order)} FROM ({profiling.SQL[name]})").fetchall()
    assert canon(map(tuple, df.select(*order).collect())) == canon(want)
    if name == "class_support_all":
        assert any(r["ok"] for r in df.where("taxid % 2 = 1").collect())


def test_numbered_classes_are_the_same_classes(spark):
    from cladeflow.plans import ambiguity

    reads = {None: (1, 2), "a": (1, 2), "b": (3,), "c": (2, 1, 4), "d": (1, 2), "hot": tuple(range(10, 2010))}
    best = spark.createDataFrame([(r, t, "species", 0.1, 10) for r, ts in reads.items() for t in ts], "read_name string, taxid long, rank string, depth double, mapped_len long")
    rows, classes = ambiguity.numbered(best)
    assert dict(rows.dtypes)["class"] == "bigint"  # no set of 2,000 in each of the 2,000 rows of a read
    sets = {r["class"]: tuple(r["members"]) for r in classes.collect()}
    assert sorted(sets.values()) == [(1, 2), (1, 2, 4), reads["hot"]]
    got = {(r["read_name"], r["taxid"], sets.get(r["class"], (r["taxid"],))) for r in rows.collect()}
    assert got == {(r["read_name"], r["taxid"], tuple(r["class"])) for r in ambiguity.with_class(best).collect()} and rows.count() == best.count()
    plain = ambiguity.with_class(best)
    assert sorted(map(tuple, ambiguity.certain(rows).collect())) == sorted(map(tuple, ambiguity.certain(plain).collect()))
    count = lambda df, name: sorted((name(r["class"]), r["taxid"], r["n"], r["n_ok"], r["size"]) for r in ambiguity.support(df, spark.createDataFrame([(1,), (4,)], "taxid long")).collect())
    assert count(ambiguity.class_members(rows), sets.get) == count(ambiguity.class_members(plain), tuple)


def _called(spark, which):
    """``which`` on reads of a shared class and of one that went to an ancestor, with classes as sets and as numbers."""
    from cladeflow.plans import ambiguity, em
    from cladeflow.sources.tables import Taxonomy

    ids = spark.createDataFrame([(t, 1, "species", f"n{t}") for t in (2, 3, 4, 5, 6)], "taxid long, parent_taxid long, rank string, sci_name string")
    none = spark.createDataFrame([], "old_taxid long, new_taxid long")
    tax = Taxonomy(ids.select("taxid", "parent_taxid", "rank"), ids.select("taxid", "sci_name"), none, none.select(F.col("old_taxid").alias("taxid")))
    reads = {"a": (2,), "b": (2, 3), "c": (4, 5), "d": (2, 3)}
    best = spark.createDataFrame([(r, t, "species", 0.1, 10) for r, ts in reads.items() for t in ts], "read_name string, taxid long, rank string, depth double, mapped_len long")
    out = []
    for rows, classes in ((ambiguity.with_class(best), None), ambiguity.numbered(best)):
        key = {(2, 3): [2, 3], (4, 5): [4, 5]} if classes is None else {tuple(r["members"]): r["class"] for r in classes.collect()}
        kind = "array<bigint>" if classes is None else "bigint"
        shares = spark.createDataFrame([(key[(2, 3)], 2, 0.75), (key[(2, 3)], 3, 0.25)], f"class {kind}, taxid long, fraction double")
        up = spark.createDataFrame([(key[(4, 5)], 6)], f"class {kind}, lca long")
        result = em.EmResult(None, shares, 1, True)
        args = (rows, result, up, tax) if which is profile.strain_classification else (rows, result, shares.select("class").distinct(), up, tax)
        out.append(sorted(map(tuple, which(*args, *([] if classes is None else [classes])).collect())))
    return out


def test_classification_by_numbers(spark):
    by_set, by_number = _called(spark, profile.classification)
    assert by_set == by_number == [("a", 2, "species", "2", "1"), ("b", 2, "species", "2;3", "0.75;0.25"), ("c", 6, "species", "4;5", "1"), ("d", 2, "species", "2;3", "0.75;0.25")]


def test_strain_classification_by_numbers(spark):
    by_set, by_number = _called(spark, profile.strain_classification)
    assert by_set == by_number and ("c", "n6", 6, "species", "n4;n5", "4;5", "1") in by_number and len(by_number) == 4
