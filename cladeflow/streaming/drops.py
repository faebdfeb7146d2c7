"""Alignment files that arrive one after the other, as a stream.

Each micro-batch parses the new files of a folder and appends narrow alignment rows to a table; profiles are made of that
table as a batch. The checkpoint of the stream keeps a file from being taken twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cladeflow.config import ProfileConfig
from cladeflow.plans import parse


def start(spark: SparkSession, folder: str, refs: DataFrame, out: str, cfg: ProfileConfig) -> StreamingQuery:
    """Follow ``folder`` for SAM text; parsed rows are written as parquet below ``out``."""
    lines = spark.readStream.text(os.path.join(folder, "*.sam*")).select("value", F.xxhash64("value").alias("ordinal"))
    records = parse.split_records(lines.where((F.col("value") != "") & ~F.col("value").startswith("@")), cfg.is_paired)
    parsed = parse.parse_alignments(records, refs, cfg)
    return parsed.writeStream.format("parquet").option("path", os.path.join(out, "alignments")).option("checkpointLocation", os.path.join(out, "checkpoint")).outputMode("append").trigger(availableNow=True).start()
