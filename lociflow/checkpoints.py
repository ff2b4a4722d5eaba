"""Cutting of lineage by files in a folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: that of spark.checkpoint.dir, or on a local master without it one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (context.master.startswith("local[") or context.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or f"/tmp/lociflow-checkpoint-{uuid.uuid4().hex}")
    return context.getCheckpointDir()


#: Bytes of shuffled rows that a task is meant to get. Sorted rows take few bytes each, so that Spark's own 64 MB can be tens
#: of millions of them, which a task then sorts.
PART_BYTES = 8 << 20


def small_parts(spark: SparkSession) -> None:
    """Lowers the session's size of shuffle partitions to PART_BYTES, so that rows of a task don't grow with the input."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    size = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(name, "64m").lower())
    if size is None or int(size[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[size[2]] > PART_BYTES:
        spark.conf.set(name, str(PART_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the session's shared checkpoint folder and goes on from the files; Spark removes them if told to by
    spark.cleaner.referenceTracking.cleanCheckpoints."""
    shared_folder(df.sparkSession)
    small_parts(df.sparkSession)
    return df.checkpoint(eager=True)
