"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number from the hash of (key, shard); the shard with the smallest ``-ln(u) / weight`` gets the
record. A record's place depends on its key and the shards alone, so that one more shard takes records only into
itself, about its share of the total weight.

Defined cases: a null key is the empty key; rows of equal keys share a shard; equal rows have neighbouring slots; a null
text counts as no bytes; a text of any length counts with its size and checksum alone; an empty table gives an empty
result; columns other than the key and the text are not looked at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, documents

HASH_BITS = 52


def unit_hash(value: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 digest; the same in any system that has MD5."""
    bits = F.conv(F.substring(F.md5(value.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("double")
    return (bits + 0.5) / float(2**HASH_BITS)


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """What a shard bids for a key; the lowest bid wins."""
    return -F.ln(unit_hash(F.concat_ws(":", key, shard.cast("string")))) / weight


def rendezvous(key: Column, weights: list[float], first: int = 0) -> Column:
    """struct(bid, shard) of the winner among shards first, first + 1, ... of these weights."""
    each = F.array(*[F.lit(float(w)) for w in weights])
    bids = F.transform(
        F.sequence(F.lit(0), F.lit(len(weights) - 1)),
        lambda i: F.struct(draw(key, i + first, F.get(each, i)).alias("bid"), (i + first).cast("int").alias("shard")),
    )
    return F.array_min(bids)


def assign_shards(df: DataFrame, key: str, weights: list[float], rows_per_group: int = 4096) -> DataFrame:
    """The rows of df (of columns that can be grouped by) with shard, slot and grown_shard.

    slot numbers the rows of a shard from 0 without gaps. Equal rows are counted first; the distinct ones are dealt to
    groups of about rows_per_group by the hash of all their columns, so that no task gets a whole shard, or all rows of
    one key, and the counts of the groups say where each begins. grown_shard is the shard with one more shard of the
    mean weight.
    """
    if not weights or any(not w > 0 or math.isinf(w) for w in weights):
        raise ValueError("weights must be positive and finite, at least one")
    own = df.columns
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = df.groupBy(*own).agg(F.count(F.lit(1)).alias("_copies"))
    bids = rows.select("*", rendezvous(k, weights).alias("_best"), rendezvous(k, [sum(weights) / len(weights)], first=len(weights)).alias("_next"), F.xxhash64(*own).alias("_hash"))
    shard = F.col("_best.shard")
    placed = cut(bids.select(*own, "_copies", "_hash", shard.alias("shard"), F.when(F.col("_next.bid") < F.col("_best.bid"), F.col("_next.shard")).otherwise(shard).alias("grown_shard")))
    groups = max(1, math.ceil(placed.count() / (rows_per_group * len(weights))))
    dealt = placed.withColumn("_group", F.pmod("_hash", F.lit(groups)).cast("int"))
    before = W.partitionBy("shard").orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    counted = dealt.groupBy("shard", "_group").agg(F.sum("_copies").alias("_n"))
    offsets = counted.select("shard", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy("shard", "_group").orderBy("_hash", *own).rowsBetween(W.unboundedPreceding, -1)
    first = F.col("_before") + F.coalesce(F.sum("_copies").over(within), F.lit(0))
    numbered = dealt.join(offsets, ["shard", "_group"]).withColumn("_first", first)
    copies = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1))
    return numbered.select(*own, "shard", copies.alias("slot"), "grown_shard")


SHARDS = 16


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str, shards: int = SHARDS) -> DataFrame:
    """All documents over shards 0 to 15 of equal weight."""
    return shard_documents(documents(spark, sf_dir), [1.0] * shards)


def shard_documents(docs: DataFrame, weights: list[float]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(rows, "doc_id", weights).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
