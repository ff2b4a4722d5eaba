"""Column helpers that several corpus operators share."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as (doc_id, text)."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; letters beyond ASCII stay as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def row_key(*cols: Column) -> Column:
    """128 bits that stand for the values of a row (nulls included), as a struct of two longs."""
    return F.struct(
        F.xxhash64(F.lit(1), *[F.isnull(c) for c in cols], *cols).alias("a"),
        F.xxhash64(F.lit(2), *[F.isnull(c) for c in cols], *cols).alias("b"),
    )


def sha256_hex(text: Column) -> Column:
    """Lower-case hex digest of the UTF-8 bytes."""
    return F.sha2(text, 256)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often use and its lambdas name it."""
    return F.transform(F.array(value), use)[0]


def kept_runs(dropped: Column, n: Column) -> Column:
    """start and length of the runs of kept ones among n places, between the ascending dropped ones."""

    def runs(edges: Column) -> Column:
        between = lambda i: F.struct((F.get(edges, i - 1) + 1).alias("start"), (F.get(edges, i) - F.get(edges, i - 1) - 1).alias("length"))
        return F.filter(F.transform(F.sequence(F.lit(1), F.size(edges) - 1), between), lambda g: g["length"] > 0)

    return bound(F.concat(F.array(F.lit(-1)), dropped, F.array(n)), runs)


def kept_text(parts: Column, runs: Column, between: str) -> Column:
    """The parts of a text in the runs, joined, in one pass."""
    return bound(parts, lambda own: F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(own, r["start"] + 1, r["length"]))), between))


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the shared folder of spark.checkpoint.dir; on a local master without that setting, a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not (context.master.startswith("local[") or context.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or f"/tmp/lociflow-checkpoint-{uuid.uuid4().hex}")


#: Arrow batches have so many bytes at most; ten thousand whole texts can be any number.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of bytes in an Arrow batch, so that a task's memory follows it (or its longest text)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(64 << 20)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from the files."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables of keys are broadcast up to so many rows.
BROADCAST_ROWS = 1_000_000


def if_small(rows: DataFrame, table: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table of narrow rows, which is broadcast once it is written and its rows are counted, if few."""
    table = cut(table)
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, key, how)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't in gone (a column of that name)."""
    return if_small(rows, gone.select(key).distinct(), key, "left_anti")
