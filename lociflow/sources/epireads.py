"""Reads of methylation states in text files: chromosome, CpG number and states, by tabs or blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import cut


#: The table of splits is broadcast up to so many rows (a row is a file name and three numbers).
BROADCAST_SPLITS = 100_000


def read_lines(spark: SparkSession, path: str | list[str], file_lines: bool = False, **options: str) -> DataFrame:
    """line_no and line of text files (also compressed), line_no without gaps from 0 in each file and from file to file.

    The lines of each split are counted first; a running sum over the small table of splits gives where each begins.
    file_lines adds file and file_line, the line's number within its file.
    """
    lines = spark.read.options(**options).text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id")
    )
    splits = cut(lines.groupBy("_file", "_at").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n")))
    whole = W.orderBy("_file", "_at").rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("_file").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    begins = splits.select("_file", "_at", "_least", F.coalesce(F.sum("_n").over(whole), F.lit(0)).alias("_first"), F.coalesce(F.sum("_n").over(own), F.lit(0)).alias("_own"))
    named = lines.join(F.broadcast(begins) if splits.count() <= BROADCAST_SPLITS else begins, ["_file", "_at"])
    within = F.col("_id") - F.col("_least")
    columns = [(F.col("_first") + within).alias("line_no"), F.col("line")]
    return named.select(*columns, *([F.col("_file").alias("file"), (F.col("_own") + within).alias("file_line")] if file_lines else []))


def parse_epireads(lines: DataFrame) -> DataFrame:
    """line_no, chr, pos, seq; a line without three fields, a whole number and states fails the query."""
    parts = F.split(F.trim("line"), r"\s+")
    ok = (F.size(parts) >= 3) & F.get(parts, F.lit(1)).rlike(r"^[0-9]+$")
    checked = F.when(ok, parts).otherwise(F.raise_error(F.concat(F.lit("not a read: "), F.col("line"))).cast("array<string>"))
    rows = lines.where(F.trim("line") != "").select("line_no", checked.alias("p"))
    return rows.select("line_no", F.get("p", F.lit(0)).alias("chr"), F.get("p", F.lit(1)).cast("bigint").alias("pos"), F.get("p", F.lit(2)).alias("seq"))


def read_epireads(spark: SparkSession, path: str) -> DataFrame:
    return parse_epireads(read_lines(spark, path))


def write_epireads(reads: DataFrame, path: str) -> None:
    reads.select("chr", "pos", "seq").write.csv(path, sep="\t")
