"""Multiple testing: the cutoff of the false discovery rate, and adjusted p-values.

Ranks come from counts of distinct values in blocks of their order, so no task sorts all p-values.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import value_blocks, with_before


def _distinct(df: DataFrame, p: str, blocks: int) -> DataFrame:
    """p, n (rows of that value), upto (rows of it and smaller ones) and _block."""
    values = df.select(F.col(p).cast("double").alias("p")).where(F.col("p").isNotNull())
    grouped = values.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    grouped = grouped.withColumn("_block", value_blocks(values, "p", blocks))
    return with_before(grouped, [], "_block", [F.col("p")], _less=("sum", F.col("n"))).withColumn("upto", F.coalesce("_less", F.lit(0)) + F.col("n")).drop("_less")


def fdr_cutoff(df: DataFrame, p: str, n_tests: int, alpha: float, blocks: int = 64) -> float:
    """The least p-value after which the next one isn't below alpha * rank / n_tests (ranks from 1)."""
    if alpha <= 0:
        return sys.float_info.max
    if alpha > 1:
        return sys.float_info.min
    ranked = _distinct(df, p, blocks).withColumn("_back", -F.col("_block")).withColumn("_p", -F.col("p"))
    following = with_before(ranked, [], "_back", [F.col("_p")], next=("lag", F.col("p")))
    last = F.col("next").isNull() | (F.col("next") >= alpha * F.col("upto") / n_tests)
    tie = (F.col("n") > 1) & (F.col("p") >= alpha * (F.col("upto") - F.col("n") + 1) / n_tests)
    found = following.where(last | tie).agg(F.min("p").alias("c")).first().c
    return sys.float_info.max if found is None else float(found)


def adjusted(df: DataFrame, p: str, n_tests: int, name: str = "adjusted", blocks: int = 64) -> DataFrame:
    """Adds the running maximum of p * n_tests / (number of p-values up to it), equal for equal ones, not cut at 1."""
    values = _distinct(df, p, blocks).withColumn("_own", F.col("p") * (n_tests / F.col("upto")))
    running = with_before(values, [], "_block", [F.col("p")], _top=("max", F.col("_own"))).select(F.col("p").alias("_p"), F.greatest("_own", "_top").alias(name))
    return df.join(running, F.col(p).cast("double") == F.col("_p"), "left").drop("_p")
