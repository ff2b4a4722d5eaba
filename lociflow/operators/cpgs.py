"""CpG sites of sequences, and the conversion of CpG numbers to base positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import pieces
from .ordered import with_before

CHUNK = 1 << 16


def cpg_sites(sequences: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """chrom, ordinal (from 0) and position of each CG of each (name, seq), any case.

    A sequence is cut into chunks with one base of overlap; the chunks' counts give the ordinals' starts.
    """
    part = pieces(sequences, chunk, 1).where(F.length("s") > 1).select(F.col("name").alias("chrom"), "piece", F.col("s").cast("binary").alias("s"))
    places = part.select("chrom", "piece", "s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i"))
    found = places.where(F.substring("s", F.col("i"), F.lit(2)) == F.lit(b"CG"))
    at = found.select("chrom", "piece", (F.col("piece").cast("bigint") * chunk + F.col("i") - 1).alias("position"))
    numbered = with_before(at.withColumn("_one", F.lit(1)), ["chrom"], "piece", [F.col("position")], before=("sum", F.col("_one")))
    return numbered.select("chrom", F.coalesce("before", F.lit(0)).cast("bigint").alias("ordinal"), "position")


def to_bases(hits: DataFrame, sites: DataFrame) -> DataFrame:
    """hits with start and end as positions of the C of their first and last CpG; a number out of range fails the query."""
    first = sites.select("chrom", F.col("ordinal").alias("start"), F.col("position").alias("_start"))
    last = sites.select("chrom", F.col("ordinal").alias("end"), F.col("position").alias("_end"))
    joined = hits.join(first, ["chrom", "start"], "left").join(last, ["chrom", "end"], "left")
    missing = F.raise_error(F.concat(F.lit("no such CpG on "), F.col("chrom"))).cast("bigint")
    place = {"start": F.coalesce("_start", missing), "end": F.coalesce("_end", missing)}
    return joined.select(*[place.get(c, F.col(c)).alias(c) for c in hits.columns])
