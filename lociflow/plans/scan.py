"""The scan for allele-specific regions: reads, windows, models, tests, regions."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..operators.cpgs import cpg_sites, to_bases
from ..operators.epialleles import window_fits, with_scores
from ..operators.intervals import collapse, merge_by_gap
from ..operators.ordered import with_before
from ..operators.significance import adjusted, fdr_cutoff
from ..operators.windows import with_runs
from ..sources.epireads import read_epireads
from ..sources.fasta import bases_of_files, read_fasta


@dataclass(frozen=True)
class Options:
    """What a scan can be told; the command line has the same names."""

    max_rounds: int = 10
    width: int = 10
    min_coverage: float = 4
    gap: int = 1000
    critical: float = 0.01
    no_fdr: bool = False
    adjust: bool = False
    bic: bool = False


def tested_windows(runs: DataFrame, options: Options = Options()) -> DataFrame:
    """run_id, chr, w, n_reads, n_cpgs, likelihoods and score of each tested window; runs come from with_runs(reads)."""
    return with_scores(window_fits(runs, options.width, int(options.min_coverage), options.max_rounds), options.bic)


def hits(scored: DataFrame, options: Options = Options()) -> DataFrame:
    """chrom, start, end (CpG numbers, both inclusive), name and score (float) of each significant one of tested_windows()."""
    cutoff = F.col("score") < options.critical
    good = scored.where(cutoff | (F.col("score") < 0) if options.bic else cutoff)
    placed = good.withColumn("short", F.col("run_cpgs") < options.width)
    placed = placed.withColumn("_block", F.struct("run_id", F.floor(F.col("w") / 65536)))
    numbered = with_before(placed.withColumn("_one", F.lit(1)), [], "_block", [F.col("run_id"), F.col("w")], ordinal=("sum", F.col("_one")), _run_before=("max", F.col("run_id")))
    first = ~F.col("short") | F.col("_run_before").isNull() | (F.col("_run_before") < F.col("run_id"))
    end = F.when(F.col("short"), F.col("run_cpgs") - 1).otherwise(F.col("w") + options.width - 1)
    name = F.concat(F.lit("AMR"), F.coalesce("ordinal", F.lit(0)).cast("string"), F.lit(":"), F.col("n_reads").cast("string"))
    return numbered.where(first).select("run_id", F.col("chr").alias("chrom"), F.col("w").alias("start"), end.alias("end"), name.alias("name"), F.col("score").cast("float").alias("score"))


#: Counters of a scan, which its own jobs give.
COUNTERS = ("reads", "runs", "windows_tested", "total_cost", "windows_accepted")


def counted_runs(reads: DataFrame) -> tuple[DataFrame, dict]:
    """Reads with their runs, written, and how many there are."""
    seen = Observation()
    runs = cut(with_runs(reads).observe(seen, F.count(F.lit(1)).alias("reads"), F.count_if(F.col("line_no") == F.col("run_id")).alias("runs")))
    return runs, seen.get


def counted_windows(runs: DataFrame, options: Options) -> tuple[DataFrame, dict]:
    """Tested windows, written, how many there are, how many reads they have in all, and how many are hits."""
    seen = Observation()
    cost = F.coalesce(F.sum("n_reads"), F.lit(0)).alias("total_cost")
    accepted = F.count_if(F.col("score") < options.critical).alias("windows_accepted")
    return cut(tested_windows(runs, options).observe(seen, F.count(F.lit(1)).alias("windows_tested"), cost, accepted)), seen.get


def joined_regions(scored: DataFrame, tests: int, options: Options = Options(), to_base: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Regions of scored windows (tested_windows()), of which there are tests; to_base turns hits in CpG numbers to bases."""
    found = cut(hits(scored, options))
    cutoff = options.critical
    if not options.bic:
        doubled = found.withColumn("p", F.col("score").cast("double"))
        if not (options.no_fdr or options.adjust):
            cutoff = fdr_cutoff(doubled, "p", tests, options.critical)
        if options.adjust:
            found = adjusted(doubled, "p", tests).withColumn("score", F.col("adjusted").cast("float")).drop("p", "adjusted")
    by_run = found.withColumn("_chrom", F.col("chrom")).withColumn("chrom", F.concat_ws("\t", "run_id", "chrom"))
    joined = collapse(by_run, ("name", "_chrom")).withColumn("chrom", F.col("_chrom")).drop("_chrom")
    merged = merge_by_gap(to_base(joined) if to_base else joined, options.gap)
    if not options.bic:
        merged = merged.where(F.col("score").cast("double") < cutoff)
    wide = merged.where(F.greatest(F.col("end") - F.col("start"), F.lit(0)) >= options.gap // 2)
    return wide.select("chrom", "start", "end", "name", "score", F.lit("+").alias("strand"))


def scanned(reads: DataFrame, options: Options = Options(), to_base: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The regions (chrom, start, end, name, score, strand), and the scan's counters (COUNTERS) from the jobs that made them."""
    runs, counters = counted_runs(reads)
    scored, more = counted_windows(runs, options)
    counters = {k: int((counters | more)[k]) for k in COUNTERS}
    return joined_regions(scored, counters["windows_tested"], options, to_base), counters


def regions(spark: SparkSession, reads: DataFrame, options: Options = Options(), sequences: DataFrame | None = None) -> DataFrame:
    """chrom, start, end, name, score, strand of the regions; in CpG numbers without sequences, else in bases."""
    return scanned(reads, options, None if sequences is None else lambda found: to_bases(found, cpg_sites(sequences)))[0]


def stats(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """One row of counters: reads, runs, windows tested, the reads in them, hits."""
    runs, counters = counted_runs(reads)
    counters |= counted_windows(runs, options)[1]
    return reads.sparkSession.createDataFrame([tuple(int(counters[k]) for k in COUNTERS)], ", ".join(f"{k} bigint" for k in COUNTERS))


def score_text(score) -> object:
    """The float32 score with six significant digits, as text."""

    @F.pandas_udf("string")
    def shown(s):
        import numpy as np
        import pandas as pd

        return pd.Series(np.char.mod("%.6g", s.to_numpy(dtype=float))).where(s.notna(), None)

    return shown(score)


def write_regions(found: DataFrame, path: str) -> None:
    """Text files whose names' order is that of chrom and start: a sort by ranges, each of which writes its own file."""
    line = F.concat_ws("\t", "chrom", "start", "end", "name", score_text(F.col("score")), "strand")
    found.orderBy("chrom", "start", "end").select(line.alias("value")).write.text(path)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Regions of allele-specific methylation from reads of methylation states.")
    parser.add_argument("reads")
    parser.add_argument("--output", "-o", required=True)
    parser.add_argument("--chrom", "-c", help="FASTA file or folder; without it, positions are CpG numbers")
    defaults = Options()
    for flag, name in (("-i", "max_rounds"), ("-w", "width"), ("-m", "min_coverage"), ("-g", "gap"), ("-C", "critical")):
        parser.add_argument(flag, f"--{name}", type=type(getattr(defaults, name)), default=getattr(defaults, name))
    for flag, name in (("-f", "no_fdr"), ("-j", "adjust"), ("-b", "bic"), ("-a", "assume")):
        parser.add_argument(flag, f"--{name}", action="store_true")
    parser.add_argument("-s", "--suffix", default=".fa", help="of chromosome files, for -a")
    got = vars(parser.parse_args(arguments))
    if got["assume"] and not got["chrom"]:
        parser.error("-a needs the folder of chromosome files (-c)")
    spark = SparkSession.builder.getOrCreate()
    to_base = None
    if got["assume"]:
        to_base = lambda found: bases_of_files(found, got["chrom"], got["suffix"])
    elif got["chrom"]:
        to_base = lambda found: to_bases(found, cpg_sites(read_fasta(spark, got["chrom"])))
    found, counters = scanned(read_epireads(spark, got["reads"]), Options(**{k: got[k] for k in Options.__dataclass_fields__}), to_base)
    write_regions(found, got["output"])
    print(*[f"{k}: {v}" for k, v in counters.items()], sep="\n", file=sys.stderr)


if __name__ == "__main__":
    main()
