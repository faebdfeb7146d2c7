"""Session-level helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. The one named in ``spark.checkpoint.dir`` wins; a local folder is made only where neither
    that setting nor a directory on the context exists and everything runs on this machine (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = getattr(sc, "master", "local")
    if not named and not master.startswith("local"):
        raise ValueError(f"{master}: spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cladeflow-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: survives the loss of executors, and later jobs start from its files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_clustered(df: DataFrame, *keys: str) -> DataFrame:
    """``cut_lineage`` of ``df`` with equal keys together and in order, which windows over the keys then neither shuffle nor sort again.
    A plan of adaptive execution doesn't say how its rows are spread, so it is off for this one."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut_lineage(df.repartition(*keys).sortWithinPartitions(*keys))
    finally:
        conf.set(name, before)


def store(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the checkpoint folder, for the steps of an iteration: its size is that of its files. The size of a
    checkpoint is an estimate that every join multiplies; after some steps planning is all that an iteration does."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(stored: DataFrame) -> None:
    """Removes the files of a table of ``store`` that nothing reads any more."""
    jvm, spark = stored.sparkSession._jvm, stored.sparkSession
    for name in {os.path.dirname(f) for f in stored.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of up to ``BROADCAST_WIDTH`` bytes that are broadcast at most.
BROADCAST_ROWS, BROADCAST_WIDTH = 1 << 18, 64


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a checkpointed table of narrow rows, marked for broadcast if a count finds it small; a join then needs no shuffle
    of its other side. Beyond the bound it is joined like any other table, with the same result."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def current_rows(df: DataFrame, keys: list[str], newest: str, *ties: Column) -> DataFrame:
    """One row per key: the one with the latest ``newest`` (nulls last). Rows equal in ``newest`` are
    ordered by ``ties``, so the choice doesn't depend on the row order. Catalyst turns the
    ``row_number() = 1`` into a group limit, which drops superseded rows before the shuffle."""
    order = [F.col(newest).desc_nulls_last(), *ties]
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") == 1).drop("_rn")
