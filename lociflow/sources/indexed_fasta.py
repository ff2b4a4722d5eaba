"""FASTA files by an index of offsets, so that only the bytes of the wanted names or regions are read.

The index is a table: name, path, length, offset (of the first base), line_bases and line_width (bytes of a line with its
end), for plain files whose sequences have lines of one length but for the last. Files are opened in the tasks by pyarrow's
file systems.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..operators.ordered import with_before

#: Bases of a piece of a whole sequence.
PIECE = 1 << 20


def _measured(lines: DataFrame) -> DataFrame:
    """What the index needs of each line, in place of its text, which no sort then has to hold."""
    bare, head = F.rtrim(F.col("value"), F.lit("\r")), F.col("value").startswith(">")
    name = F.when(head, F.split(F.substring(bare, 2, 1 << 30), r"[ \t]")[0])
    return lines.select("path", "_split", "_id", (F.octet_length("value") + 1).cast("bigint").alias("width"), head.alias("head"), F.octet_length(bare).cast("bigint").alias("bases"), name.alias("name"))


def fasta_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The index of files of any number of splits: bytes are added up by split, and splits by file.

    A sequence whose lines differ in length before its last, or that has an empty line within, fails the query; of equal
    names in a file each has a row.
    """
    lines = _measured(spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id")))
    splits = cut(lines.groupBy("path", "_split").agg(F.sum("width").alias("_n")))
    ahead = W.partitionBy("path").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    begins = splits.select("path", "_split", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_begin"))  # a row for each split
    within = W.partitionBy("path", "_split").orderBy("_id").rowsBetween(W.unboundedPreceding, -1)
    placed = lines.withColumn("_in", F.coalesce(F.sum("width").over(within), F.lit(0))).join(begins, ["path", "_split"])
    rows = placed.select("path", "_split", (F.col("_begin") + F.col("_in")).alias("at"), "width", "head", "bases", "name")
    rows = rows.where(F.col("head") | (F.col("bases") > 0)).withColumn("_head", F.when(F.col("head"), F.col("at")))
    marked = with_before(rows, ["path"], "_split", [F.col("at")], _prior=("max", F.col("_head"))).withColumn("record", F.coalesce("_head", "_prior"))
    body = lambda c: F.when(~F.col("head"), F.col(c))
    found = marked.where(F.col("record").isNotNull()).groupBy("path", "record").agg(
        F.max("name").alias("name"), F.max(F.when(F.col("head"), F.col("at") + F.col("width"))).alias("offset"), F.count(body("at")).alias("n"), F.coalesce(F.sum(body("bases")), F.lit(0)).alias("length"),
        F.coalesce(F.max(body("bases")), F.lit(1)).alias("line_bases"), F.coalesce(F.max(body("width")), F.lit(2)).alias("line_width"), F.max_by(F.struct("at", "bases"), body("at")).alias("last"),
    )
    even = (F.col("length") == (F.col("n") - 1) * F.col("line_bases") + F.col("last.bases")) & (F.col("last.at") == F.col("offset") + (F.col("n") - 1) * F.col("line_width"))
    wrong = F.raise_error(F.concat(F.lit("lines of different lengths: "), "name")).cast("bigint")
    return found.select("name", "path", "length", F.when((F.col("n") == 0) | even, F.col("offset")).otherwise(wrong).alias("offset"), "line_bases", "line_width")


def _byte_of(base: Column) -> Column:
    return F.col("offset") + F.floor(base / F.col("line_bases")) * F.col("line_width") + base % F.col("line_bases")


def _read(wanted: DataFrame) -> DataFrame:
    """wanted (with path, _from and _n, in bytes) with seq and bytes_read in their place."""
    own = [c for c in wanted.columns if c not in ("path", "_from", "_n")]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.select(*own).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = None, None
        for batch in batches:
            seqs, read = [], []
            for path, start, n in zip(*(batch.column(c).to_pylist() for c in ("path", "_from", "_n")), strict=True):
                if n <= 0:
                    seqs.append("")
                    read.append(0)
                    continue
                if path != name:
                    if held:
                        held.close()
                    system, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if re.match(r"^\w+:", path) else (fs.LocalFileSystem(), path)
                    held, name = system.open_input_file(place), path
                data = held.read_at(n, start)
                seqs.append(data.translate(None, b"\r\n").decode())
                read.append(len(data))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(seqs, pa.string()), pa.array(read, pa.int64())], names=[*own, "seq", "bytes_read"])
        if held:
            held.close()

    return wanted.select(*own, "path", "_from", "_n").mapInArrow(run, f"{kind}, seq string, bytes_read bigint")


def regions_of_index(regions: DataFrame, index: DataFrame) -> DataFrame:
    """regions (chrom, start, end, ...) with seq, as it is in the file, and bytes_read; what lies beyond a sequence is left
    out, and regions of names that aren't in the index go."""
    named = index.select(F.col("name").alias("chrom"), "path", "length", "offset", "line_bases", "line_width")
    first, last = F.greatest(F.col("start"), F.lit(0)), F.least(F.col("end"), F.col("length"))
    ranges = regions.join(named, "chrom").withColumn("_from", _byte_of(first)).withColumn("_n", F.when(last > first, _byte_of(last - 1) + 1 - F.col("_from")).otherwise(0))
    ordered = ranges.select(*regions.columns, "path", F.col("_from").cast("bigint").alias("_from"), F.col("_n").cast("bigint").alias("_n"))
    return _read(ordered)


def sequences_of_index(index: DataFrame, names: list[str], piece: int = PIECE) -> DataFrame:
    """name and seq of some names, read in pieces by many tasks."""
    wanted = index.where(F.col("name").isin(*names)).select(F.col("name").alias("chrom"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(piece).cast("bigint"))).alias("start"))
    parts = regions_of_index(wanted.withColumn("end", F.col("start") + piece).repartition("chrom", "start"), index)
    whole = F.array_sort(F.collect_list(F.struct("start", "seq")))
    return parts.groupBy(F.col("chrom").alias("name")).agg(F.array_join(F.transform(whole, lambda x: x["seq"]), "").alias("seq"))


def read_fasta_target(spark: SparkSession, path: str, name: str, index: DataFrame | None = None) -> DataFrame:
    """name and seq of one sequence: with an index, only its bytes are read after the index."""
    return sequences_of_index(fasta_index(spark, path) if index is None else index, [name])
