"""Registered queries against their SQL, on the smallest tables if they are here."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from cladeflow.queries import problems, profiling

DIR = "/root/testdata/sf0.001"
NAMES = ["p1_found", "p1_periods", "p2_key_stats", "p3_found", "p3_valid", "p5_found", "p7_found", "p7_paths", "aln_parse", "cigar_identity", "genus_fallback", "coverage_by_taxon", "coverage_strain", "class_prune", "majority_lca", "em_fixed_iter", "host_annotation", "subsample_allocation", "pvalue_exact"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def canon(rows):
    return Counter(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, db, name):
    queries, sql = problems.QUERIES | profiling.QUERIES, problems.SQL | profiling.SQL
    df = queries[name](spark, DIR)
    rel = db.sql(sql[name])
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    want = canon(rel.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall())
    assert canon(map(tuple, df.select(*order).collect())) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
