"""Methylation sites and their summaries. A site is chrom, pos, strand, context, meth (a share), n_reads."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The confidence level is passed where the error rate is expected; results depend on it.
ALPHA = 0.95


def n_meth() -> Column:
    return F.round(F.col("meth") * F.col("n_reads")).cast("bigint")


def n_unmeth() -> Column:
    return F.col("n_reads") - n_meth()


def is_context(context: Column, name: str) -> Column:
    """CpG, CHH, CCG, CXG by their beginning."""
    return context.startswith(name)


def is_mutated(context: Column) -> Column:
    return context.endswith("x")


def set_mutated(context: Column, mutated: bool = True) -> Column:
    plain = F.regexp_replace(context, "x$", "")
    return F.concat(plain, F.lit("x")) if mutated else plain


def wilson(p: Column, n: Column, alpha: float = ALPHA) -> Column:
    """struct(lower, upper) of the Wilson score interval of a share p of n."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    bottom = 1 + z * z / n
    centre = p + z * z / (2 * n)
    width = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.struct(((centre - width) / bottom).alias("lower"), ((centre + width) / bottom).alias("upper"))


def levels(sites: DataFrame, by: str = "context", alpha: float = ALPHA) -> DataFrame:
    """Counters and levels of each context: sites, covered, mutated, reads by state, calls by the Wilson interval."""
    covered = (F.col("n_reads") > 0) & ~is_mutated(F.col("context"))
    w = wilson(F.col("meth"), F.greatest(F.col("n_reads"), F.lit(1)).cast("double"), alpha)
    one = sites.withColumn("_c", covered).withColumn("_w", w).withColumn("_m", n_meth())
    counts = one.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_sites"),
        F.count_if("_c").alias("sites_covered"),
        F.coalesce(F.max(F.when(F.col("_c"), F.col("n_reads"))), F.lit(0)).alias("max_depth"),
        F.count_if(is_mutated(F.col("context"))).alias("mutations"),
        F.coalesce(F.sum(F.when(F.col("_c"), F.col("_m"))), F.lit(0)).alias("total_c"),
        F.coalesce(F.sum(F.when(F.col("_c"), F.col("n_reads") - F.col("_m"))), F.lit(0)).alias("total_t"),
        F.count_if(F.col("_c") & (F.col("_w.lower") > 0.5)).alias("called_meth"),
        F.count_if(F.col("_c") & (F.col("_w.upper") < 0.5)).alias("called_unmeth"),
        F.coalesce(F.sum(F.when(F.col("_c"), F.col("meth"))), F.lit(0.0)).alias("mean_agg"),
    )
    share = lambda a, b: a / F.nullif(b, F.lit(0))
    return (
        counts.withColumn("coverage", F.col("total_c") + F.col("total_t"))
        .withColumn("total_called", F.col("called_meth") + F.col("called_unmeth"))
        .withColumn("mean_meth_weighted", share(F.col("total_c"), F.col("coverage")))
        .withColumn("fractional_meth", share(F.col("called_meth"), F.col("total_called")))
        .withColumn("mean_meth", share(F.col("mean_agg"), F.col("sites_covered")))
    )


def merge_mates(sites: DataFrame) -> DataFrame:
    """CpG sites of both strands, one base apart, as one site of the plus strand."""
    plus = sites.where((F.col("strand") == "+") & is_context(F.col("context"), "CpG")).withColumn("_m", n_meth())
    minus = sites.where((F.col("strand") == "-") & is_context(F.col("context"), "CpG")).select("chrom", (F.col("pos") - 1).alias("pos"), F.col("n_reads").alias("_n2"), n_meth().alias("_m2"))
    n = F.col("n_reads") + F.col("_n2")
    return plus.join(minus, ["chrom", "pos"]).select("chrom", "pos", "strand", "context", ((F.col("_m") + F.col("_m2")) / F.greatest(n, F.lit(1))).alias("meth"), n.alias("n_reads"))


def kmer_counts(sequences: DataFrame, k: int, dense: bool = False, piece: int = 1 << 14) -> DataFrame:
    """kmer and n over all (name, seq), k-mers of valid bases only; dense adds those that don't occur (k up to 10).

    Sequences are cut into pieces that overlap by k - 1 letters, and each place of a piece is one row up to the partial
    sum, so that neither an array of all k-mers nor a search from a sequence's start is made.
    """
    from ..functions.dna import number_kmer, pieces

    rows = pieces(sequences, piece, k - 1).where(F.length("s") >= k).select(F.col("s").cast("binary").alias("s"))
    placed = rows.select("s", F.explode(F.sequence(F.lit(1), F.length("s") - k + 1)).alias("i"))
    counted = placed.groupBy(F.substring("s", F.col("i"), F.lit(k)).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))
    found = counted.select(F.col("kmer").cast("string").alias("kmer"), "n").where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$"))
    if not dense:
        return found
    every = sequences.sparkSession.range(4**k).select(number_kmer(F.col("id"), k).alias("kmer"))
    return every.join(found, "kmer", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))
