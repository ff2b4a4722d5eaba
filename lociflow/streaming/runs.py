"""The scan over reads that arrive in any micro-batches, and their coverage by event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.epialleles import BATCH, KINDS, _batch_windows, with_scores
from ..plans.scan import Options, joined_regions

READS = "line_no bigint, chr string, pos bigint, seq string"


def read_stream(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """Reads from Parquet files in the order in which they arrive, so many to a micro-batch; runs may go on from file to file."""
    return spark.readStream.schema(f"{READS}, sample string").option("maxFilesPerTrigger", files).parquet(folder)


def timed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Reads from Parquet files that also have ts, when a read was made."""
    return spark.readStream.schema(f"{READS}, ts timestamp").parquet(folder)


STATE = "run_id bigint, chr string, furthest bigint, n_cpgs bigint, first bigint, line_no array<bigint>, pos array<bigint>, seq array<string>"
WINDOW = "sample string, run_id bigint, chr string, run_cpgs bigint, w bigint, n_reads bigint, n_cpgs int, single_ll double, pair_ll double"


class Run:
    """What an open run still needs: reads that a later window can meet, and the first window that isn't told yet."""

    def __init__(self, run_id: int, chrom: str | None) -> None:
        self.run_id, self.chrom, self.furthest, self.n_cpgs, self.first = run_id, chrom, 0, 0, 0
        self.reads: list[tuple[int, int, str, int]] = []  # line_no, pos, seq, first window that it is in

    def add(self, line: int, pos: int, seq: str, width: int) -> None:
        self.furthest, self.n_cpgs = max(self.furthest, pos), max(self.n_cpgs, pos + len(seq))
        self.reads.append((line, pos, seq, max(0, self.furthest - width + 1)))

    def closed(self, options: Options, ended: bool) -> Iterator[pd.DataFrame]:
        """The tested windows that no later read can be in; their reads are let go."""
        width = options.width
        upto = max(1, self.n_cpgs - width + 1) if ended else max(0, self.furthest - width + 1)  # the first window still open
        if upto > self.first:
            spans = [(pos, seq, max(low, self.first), min(pos + len(seq), upto) - 1) for _, pos, seq, low in self.reads]
            yield from self._fits([s for s in spans if s[2] <= s[3]], options)
            self.first = upto
            self.reads = [r for r in self.reads if r[1] + len(r[2]) > upto]

    def _fits(self, spans: list[tuple[int, str, int, int]], options: Options) -> Iterator[pd.DataFrame]:
        batches: dict[int, list[tuple[int, str, int, int]]] = {}
        for s in spans:
            for b in range(s[2] // BATCH, s[3] // BATCH + 1):
                batches.setdefault(b, []).append(s)
        for b, rows in sorted(batches.items()):
            pos, seq, low, high = zip(*rows, strict=True)
            table = pa.table({"pos": pos, "seq": seq, "_from": low, "_to": high, "copies": [1] * len(rows), "batch": [b] * len(rows)})
            found = _batch_windows(table, options.width, int(options.min_coverage), options.max_rounds)
            if found:
                n = len(found["w"])
                yield pd.DataFrame({"run_id": np.full(n, self.run_id), "chr": [self.chrom] * n, **{k: found[k] for k in KINDS}})


def window_stream(reads: DataFrame, options: Options = Options()) -> DataFrame:
    """Fits of the tested windows of a stream of reads (READS and sample, whose reads arrive in the order of line_no).

    The state of a sample is one open run with the reads that a window still open can meet. A window is told once a read
    begins beyond it, or the run ends: with the first read of another chromosome, or with a row without chr, pos and seq,
    which ends the sample. run_cpgs is the run's length where it is known: of the windows of short runs.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = None
        if state.exists:
            run_id, chrom, furthest, n_cpgs, first, lines, places, seqs = state.get
            run = Run(run_id, chrom)
            run.furthest, run.n_cpgs, run.first = furthest, n_cpgs, first
            run.reads = [(line, p, s, first) for line, p, s in zip(lines, places, seqs, strict=True)]
        rows = pd.concat(list(batches)).sort_values("line_no", kind="stable")

        def told(ended: bool) -> Iterator[pd.DataFrame]:
            short = run.n_cpgs if ended and run.n_cpgs < options.width else None
            for found in run.closed(options, ended):
                found.insert(0, "sample", key[0])
                found.insert(3, "run_cpgs", pd.array([short or options.width] * len(found), "Int64"))
                yield found

        for line, chrom, pos, seq in zip(rows["line_no"], rows["chr"], rows["pos"], rows["seq"], strict=True):
            chrom = None if pd.isna(chrom) else chrom
            ends = chrom is None and pd.isna(pos) and seq is None
            if pd.isna(pos) or seq is None:
                if ends and run:
                    yield from told(True)
                    run = None
                continue
            if run is None or run.chrom != chrom:
                if run:
                    yield from told(True)
                run = Run(int(line), chrom)
            run.add(int(line), int(pos), seq, options.width)
        if run is None:
            if state.exists:
                state.remove()
            return
        yield from told(False)
        state.update((run.run_id, run.chrom, run.furthest, run.n_cpgs, run.first, [r[0] for r in run.reads], [r[1] for r in run.reads], [r[2] for r in run.reads]))

    return reads.select("sample", *[x.split()[0] for x in READS.split(", ")]).groupBy("sample").applyInPandasWithState(step, WINDOW, STATE, "append", GroupStateTimeout.NoTimeout)


def scan_stream(reads: DataFrame, output: str, checkpoint: str, options: Options = Options()) -> StreamingQuery:
    """Writes the fits of windows as they close to Parquet files in output; a query that is started again goes on from its checkpoint."""
    return window_stream(reads, options).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(output)


def regions_so_far(spark: SparkSession, output: str, sample: str, options: Options = Options()) -> DataFrame:
    """The regions of a sample's windows that scan_stream() has written; tests are corrected for over all of them."""
    fits = spark.read.parquet(output).where(F.col("sample") == sample).drop("sample")
    return joined_regions(with_scores(fits, options.bic), fits.count(), options)


def coverage_stream(reads: DataFrame, watermark: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Reads of each chromosome by time window, for reads with a timestamp column ts (timed_stream()); late ones go after the watermark."""
    return reads.withWatermark("ts", watermark).groupBy(F.window("ts", width), "chr").agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.length("seq")).alias("sites"))
