from cladeflow import session


class FakeContext:
    def __init__(self):
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class FakeSession:
    def __init__(self, named):
        self.sparkContext = FakeContext()
        self.conf = {"spark.checkpoint.dir": named} if named else {}


def test_the_named_folder_wins():
    s = FakeSession("file:///shared")
    assert session.ensure_checkpoint_dir(s) == "file:///shared"
    s.sparkContext.dir = "elsewhere"
    assert session.ensure_checkpoint_dir(s) == "elsewhere"
    assert "cladeflow-ckpt" in session.ensure_checkpoint_dir(FakeSession(None))


def test_current_rows_ignore_the_row_order(spark):
    from pyspark.sql import functions as F

    rows = [(1, 5, "b"), (1, 5, "a"), (1, 4, "c"), (2, None, "x"), (2, 1, "y"), (None, 1, "z")]
    want = {(1, 5, "a"), (2, 1, "y"), (None, 1, "z")}
    for k in range(3):
        df = spark.createDataFrame(rows[k:] + rows[:k], "k int, at int, v string")
        assert {tuple(r) for r in session.current_rows(df, ["k"], "at", F.col("v")).collect()} == want


def test_broadcast_only_below_the_bound(spark):
    left, right = spark.range(50).selectExpr("id AS a"), spark.range(20).selectExpr("id AS a").checkpoint()
    plan = lambda rows: left.join(session.broadcast_if_small(right, rows), "a", "left_semi")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(20) and "strategy=broadcast" not in plan(19)
    assert left.join(session.broadcast_if_small(right, 19), "a", "left_semi").count() == 20


def test_no_local_folder_on_a_cluster():
    import pytest

    s = FakeSession(None)
    s.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError, match="checkpoint"):
        session.ensure_checkpoint_dir(s)
    named = FakeSession("hdfs:///shared")
    named.sparkContext.master = "yarn"
    assert session.ensure_checkpoint_dir(named) == "hdfs:///shared"
