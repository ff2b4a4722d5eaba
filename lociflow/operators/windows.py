"""Runs, sliding windows of CpG sites, and the reads of each window.

A read is (line_no, chr, pos, seq): pos counts CpG sites, and seq has one of C, T, N for each site. A run is consecutive
reads of one chromosome, so that a name that comes back later is another run. A window takes width sites; a read is in
the window that begins at s if it ends after s and no read so far in its run, itself included, begins at s + width or
later. On unsorted input late reads are so left out of some windows. Reads without a pos or a seq are dropped; those
without a chr are reads of one chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import cut

BLOCK_BITS = 20
#: Window starts of a block of running sums, as a power of two.
START_BITS = 12
#: The table of parts of runs is broadcast up to so many rows.
BROADCAST_PARTS = 500_000


def with_runs(reads: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Adds run_id (the line_no of the run's first read), furthest, the greatest pos of the run so far, and n_cpgs, the
    CpGs up to the end of the run's reads.

    A block is 2 ** block_bits line numbers. Runs are found within blocks, by one window over them, and a row for each
    block says what of the run before it goes on: its run_id, how far it has come, and how far it will. A table with a row
    for each part of a run in a block gives the reads the rest. Reads without pos or seq go.
    """
    sound = reads.where(F.col("pos").isNotNull() & F.col("seq").isNotNull()).withColumn("_block", F.shiftright("line_no", block_bits))
    inside = W.partitionBy("_block").orderBy("line_no")
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    new = (F.row_number().over(inside) == 1) | ~F.col("chr").eqNullSafe(F.lag("chr").over(inside))
    local = sound.withColumn("_new", F.when(new, F.col("line_no"))).withColumn("_run", F.max("_new").over(so_far)).drop("_new")
    local = cut(local.withColumn("_far", F.max(F.struct("_run", "pos")).over(so_far)["pos"]))  # runs ascend, so the greatest is of this one
    parts = cut(local.groupBy("_block", "_run").agg(F.first("chr").alias("chr"), F.max("pos").alias("far"), F.max(F.col("pos") + F.length("seq")).alias("end")))
    head, tail = (f(F.struct("chr", "far", "end"), "_run") for f in (F.min_by, F.max_by))
    blocks = parts.groupBy("_block").agg(F.min("_run").alias("_first"), head.alias("_head"), F.max("_run").alias("_last"), tail.alias("_tail"))
    by = W.orderBy("_block")  # a row for each 2 ** block_bits reads
    joins = F.coalesce(F.col("_head.chr").eqNullSafe(F.lag("_tail").over(by)["chr"]) & (F.lag("_block").over(by).isNotNull()), F.lit(False))
    ends = cut(blocks).withColumn("_joins", joins).withColumn("_open", F.when(~F.col("_joins") | (F.col("_first") < F.col("_last")), F.col("_last")))
    ends = ends.withColumn("_open", F.last("_open", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    far = F.max("_tail.far").over(W.partitionBy("_open").orderBy("_block").rowsBetween(W.unboundedPreceding, W.currentRow))
    ends = ends.withColumn("_reached", far).withColumn("_from", F.lag("_open").over(by))
    before = ends.select("_block", F.when(F.col("_joins"), F.col("_first")).alias("_goes_on"), "_from", F.lag("_reached").over(by).alias("_reached"), F.col("_last"), F.col("_open"))
    of_run = ends.select(F.col("_open").alias("_r"), "_tail.end").unionByName(ends.where("_joins").select(F.col("_from").alias("_r"), "_head.end")).groupBy("_r").agg(F.max("end").alias("_e"))
    before = before.join(of_run.select(F.col("_r").alias("_open"), F.col("_e").alias("_open_end")), "_open", "left")
    before = before.join(of_run.select(F.col("_r").alias("_from"), F.col("_e").alias("_from_end")), "_from", "left")
    goes_on = F.col("_run") == F.col("_goes_on")
    of_part = parts.join(F.broadcast(before), "_block").select(
        "_block", "_run",
        F.when(goes_on, F.col("_from")).otherwise(F.col("_run")).alias("run_id"),
        F.when(goes_on, F.col("_reached")).alias("_reached"),
        F.when(goes_on, F.col("_from_end")).when(F.col("_run") == F.col("_last"), F.col("_open_end")).otherwise(F.col("end")).alias("n_cpgs"),
    )
    joined = local.join(F.broadcast(of_part) if parts.count() <= BROADCAST_PARTS else of_part, ["_block", "_run"])
    return joined.select(*reads.columns, "run_id", F.greatest("_far", "_reached").alias("furthest"), "n_cpgs")


def n_starts(width: int) -> Column:
    """How many windows a run has."""
    return F.greatest(F.lit(1), F.col("n_cpgs") - width + 1)


def _spans(reads: DataFrame, width: int) -> DataFrame:
    """Reads with _from and _to, the first and last window that they are in."""
    last = F.least(F.col("pos") + F.length("seq"), n_starts(width)) - 1
    return reads.withColumn("_from", F.greatest(F.lit(0), F.col("furthest") - width + 1)).withColumn("_to", last).where(F.col("_from") <= F.col("_to"))


def clip_start(start: Column) -> Column:
    return F.greatest(F.col("pos"), start)


def clip(start: Column, width: int) -> Column:
    """The part of seq within the window that begins at start."""
    return F.substring(F.col("seq"), (F.greatest(start - F.col("pos"), F.lit(0)) + 1).cast("int"), (F.least(F.col("pos") + F.length("seq"), start + width) - clip_start(start)).cast("int"))


def window_reads(reads: DataFrame, width: int = 10) -> DataFrame:
    """A row for each window and read in it: run_id, chr, w, line_no, pos, seq, both clipped to the window."""
    exploded = _spans(reads, width).withColumn("w", F.explode_outer(F.sequence("_from", "_to")))
    return exploded.select("run_id", "chr", "w", "line_no", clip_start(F.col("w")).alias("pos"), clip(F.col("w"), width).alias("seq"))


def _events(spans: DataFrame, width: int, bits: int) -> DataFrame:
    """run_id, chr, and what reads of _spans() change at window starts w: reads by n, coverage (as a line in w) by its
    height a and slope d.

    Within its windows a read's coverage rises by a site a window, stays, and falls; nothing changes between. Where a
    block of 2 ** bits starts begins within them there is an event of zeros, so that each block's rows begin in it.
    """
    pos, end, first, last = F.col("pos"), F.col("end"), F.col("_from"), F.col("_to")
    zero, minus = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
    rows = spans.select("run_id", "chr", "pos", (F.col("pos") + F.length("seq")).cast("bigint").alias("end"), "_from", "_to")
    rows = rows.select("*", F.least(pos, end - width).alias("flat"), F.greatest(pos, end - width).alias("falls"))
    bends = [(F.col(c), (first < F.col(c)) & (F.col(c) <= last)) for c in ("flat", "falls")]
    slope = F.when(first < F.col("flat"), 1).when(first >= F.col("falls"), -1).otherwise(0).cast("bigint")
    # an event that doesn't come is one of zeros at the first window
    bent = [column for i, (x, here) in enumerate(bends) for column in (F.when(here, x).otherwise(first).alias(f"w{i}"), F.when(here, x).otherwise(zero).alias(f"a{i}"), F.when(here, minus).otherwise(zero).alias(f"d{i}"))]
    rows = rows.select("run_id", "chr", "_from", "_to", (F.least(end, first + width) - F.greatest(pos, first)).alias("here"), slope.alias("d"), *bent)
    rows = rows.select("run_id", "chr", "_from", "_to", "d", (F.col("here") - F.col("d") * first).alias("a"), *[f"{c}{i}" for i in (0, 1) for c in "wad"])
    one = lambda w, n, a, d: F.struct(w.cast("bigint").alias("w"), F.lit(n).cast("bigint").alias("n"), a.alias("a"), d.alias("d"))
    a, d = F.col("a"), F.col("d")
    own = [one(first, 1, a, d), *[one(F.col(f"w{i}"), 0, F.col(f"a{i}"), F.col(f"d{i}")) for i in (0, 1)], one(last + 1, -1, -(a + F.col("a0") + F.col("a1")), -(d + F.col("d0") + F.col("d1")))]
    changes = rows.select("run_id", "chr", F.explode(F.array(*own)).alias("e")).select("run_id", "chr", "e.*")
    block = lambda w: F.shiftright(w, bits)
    begun = spans.where(block(first) < block(last)).select("run_id", "chr", F.explode(F.sequence(block(first) + 1, block(last))).alias("b"))
    return changes.unionByName(begun.distinct().select("run_id", "chr", F.shiftleft("b", bits).alias("w"), *[zero.alias(c) for c in "nad"]))


def window_coverage(reads: DataFrame, width: int = 10, bits: int = START_BITS) -> DataFrame:
    """run_id, chr, w, n_reads and coverage (sites of clipped reads, N included) of each window with reads.

    Events of equal windows are added up before the shuffle, and running sums go over blocks of window starts: the work
    follows the reads and the windows, not their pairs, and no task gets a whole run.
    """
    events = _events(_spans(reads, width), width, bits).groupBy("run_id", "chr", "w").agg(*[F.sum(c).alias(c) for c in "nad"])
    events = cut(events.withColumn("_block", F.shiftright("w", bits)))
    within = W.partitionBy("run_id", "_block").orderBy("w")
    ahead = W.partitionBy("run_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # a row for each block
    blocks = events.groupBy("run_id", "_block").agg(*[F.sum(c).alias(c) for c in "nad"])
    before = blocks.select("run_id", "_block", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}") for c in "nad"])
    so_far = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = events.select("run_id", "chr", "w", "_block", *[F.sum(c).over(so_far).alias(c) for c in "nad"], F.coalesce(F.lead("w").over(within), F.shiftleft(F.col("_block") + 1, bits)).alias("_next"))
    sums = rows.join(before, ["run_id", "_block"]).select("run_id", "chr", "w", "_next", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in "nad"]).where(F.col("n") > 0)
    every = sums.withColumn("w", F.explode(F.sequence("w", F.col("_next") - 1)))
    return every.select("run_id", "chr", "w", F.col("n").alias("n_reads"), (F.col("a") + F.col("d") * F.col("w")).alias("coverage"))


def covered_windows(reads: DataFrame, width: int = 10, min_coverage: int = 4) -> DataFrame:
    """The windows whose coverage is width * min_coverage at least: those that are tested."""
    return window_coverage(reads, width).where(F.col("coverage") >= width * min_coverage)


def site_counts(reads: DataFrame, width: int = 10) -> DataFrame:
    """run_id, chr, w, site, meth and total (reads of state C, and of C or T) for each site of each window.

    A site's reads are counted once, by the first window that they are in there, as late reads come in later; a window has
    the reads that came in with it or before. Sites are dealt by blocks, so that sums by window find them side by side.
    """
    states = reads.select("run_id", "chr", "pos", "furthest", "n_cpgs", F.posexplode(F.split("seq", "")).alias("i", "state")).where(F.col("state").isin("C", "T"))
    states = states.withColumn("site", F.col("pos") + F.col("i")).withColumn("_from", F.greatest(F.lit(0), F.col("site") - width + 1, F.col("furthest") - width + 1))
    last = F.least(F.col("site"), n_starts(width) - 1)
    place = ["run_id", "chr", "n_cpgs", "_block", "site"]
    counts = states.where(F.col("_from") <= last).withColumn("_block", F.shiftright("site", START_BITS)).groupBy(*place, "_from").agg(F.count_if(F.col("state") == "C").alias("meth"), F.count(F.lit(1)).alias("total"))
    sites = counts.repartition("run_id", "_block").groupBy(*place).agg(F.min("_from").alias("_least"), F.collect_list(F.struct("_from", "meth", "total")).alias("_in"))  # width of them at most
    windows = sites.withColumn("w", F.explode(F.sequence("_least", last)))
    upto = lambda c: F.aggregate("_in", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["_from"] <= F.col("w"), x[c]).otherwise(0))
    return windows.select("run_id", "chr", "w", "site", upto("meth").alias("meth"), upto("total").alias("total"))


def single_allele_likelihood(counts: DataFrame, pseudo: float = 1e-10) -> DataFrame:
    """run_id, chr, w and the log-likelihood of the one-allele model by its closed form, from site_counts()."""
    p = (F.col("meth") + pseudo) / (F.col("total") + 2 * pseudo)
    rest = F.col("total") - F.col("meth")
    ll = F.when(F.col("meth") > 0, F.col("meth") * F.ln(p)).otherwise(0.0) + F.when(rest > 0, rest * F.ln(1 - p)).otherwise(0.0)
    return counts.groupBy("run_id", "chr", "w").agg(F.sum(ll).alias("log_likelihood"))
