"""FASTA and FASTQ files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quality import scores, valid_quality
from ..operators.ordered import with_before
from .epireads import read_lines


def parse_fasta(lines: DataFrame, short_names: bool = False) -> DataFrame:
    """name and seq of each record of (line_no, line); short names end at the first blank."""
    head = F.col("line").startswith(">")
    rows = lines.where(F.length("line") > 0).withColumn("_block", F.shiftright("line_no", 20)).withColumn("_head", F.when(head, F.col("line_no")))
    marked = with_before(rows, [], "_block", [F.col("line_no")], _prior=("max", F.col("_head"))).withColumn("record", F.coalesce("_head", "_prior"))
    parts = F.array_sort(F.collect_list(F.when(~head, F.struct("line_no", F.regexp_replace("line", r"\s+", "").alias("s")))))
    name = F.max(F.when(head, F.substring("line", 2, 1 << 30)))
    found = marked.where(F.col("record").isNotNull()).groupBy("record").agg(name.alias("name"), F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("seq"))
    return found.select(F.split("name", r"[ \t]")[0].alias("name") if short_names else "name", "seq")


def read_fasta(spark: SparkSession, path: str | list[str], short_names: bool = True, suffix: str | None = None) -> DataFrame:
    """Records of a file, or of a folder's files (of one suffix)."""
    return parse_fasta(read_lines(spark, path, **({"pathGlobFilter": f"*{suffix}"} if suffix else {})), short_names)


def chromosomes(spark: SparkSession, folder: str, suffix: str = ".fa", by_content: bool = True) -> DataFrame:
    """name and path of the sequences in a folder's files of a suffix: by their records, or by the names of the files."""
    lines = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder).select("value", F.col("_metadata.file_path").alias("path"))
    if not by_content:
        name = F.regexp_replace(F.substring_index("path", "/", -1), f"{re.escape(suffix)}$", "")
        return lines.select("path").distinct().select(name.alias("name"), "path")
    return lines.where(F.col("value").startswith(">")).select(F.split(F.substring("value", 2, 1 << 30), r"[ \t]")[0].alias("name"), "path")


def read_chromosomes(spark: SparkSession, catalogue: DataFrame, names: list[str]) -> DataFrame:
    """The sequences of some names, from the files that the catalogue (of chromosomes()) has for them alone."""
    found = {r.name: r.path for r in catalogue.where(F.col("name").isin(*names)).collect()}  # as many rows as names
    if missing := sorted(set(names) - set(found)):
        raise ValueError(f"no file of {', '.join(missing)}")
    return read_fasta(spark, sorted(set(found.values()))).where(F.col("name").isin(*names))


def read_assumed(spark: SparkSession, folder: str, names: list[str], suffix: str = ".fa") -> DataFrame:
    """The sequences of some names, each from the file of the folder that is called by it; no other file is opened, and a
    name without a file fails."""
    if not names:
        return spark.createDataFrame([], "name string, seq string")
    return read_fasta(spark, [f"{folder.removesuffix('/')}/{n}{suffix}" for n in sorted(names)]).where(F.col("name").isin(*names))


def bases_of_files(hits: DataFrame, folder: str, suffix: str = ".fa") -> DataFrame:
    """Hits in CpG numbers as bases, with the files of their chromosomes alone."""
    from ..operators.cpgs import cpg_sites, to_bases

    names = [r.chrom for r in hits.select("chrom").distinct().collect()]  # chromosomes
    return to_bases(hits, cpg_sites(read_assumed(hits.sparkSession, folder, names, suffix)))


def file_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a file of file names, one in a line."""
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def parse_fastq(lines: DataFrame) -> DataFrame:
    """name, seq and qual of four-line records; line_no must be gapless from 0, and may be numbered by file.

    A record without its @ and + lines, or whose qualities and bases differ in number, fails the query.
    """
    files = ["file"] if "file" in lines.columns else []
    pick = lambda i: F.max(F.when(F.col("line_no") % 4 == i, F.col("line")))
    rows = lines.groupBy(*files, F.floor(F.col("line_no") / 4).alias("record")).agg(*[pick(i).alias(c) for i, c in enumerate(("head", "seq", "plus", "qual"))])
    good = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    fail = F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("head", F.lit("")))).cast("string")
    return rows.select(F.when(good, F.substring("head", 2, 1 << 30)).otherwise(fail).alias("name"), "seq", "qual")


def read_fastq(spark: SparkSession, path: str | list[str], scored: bool = False) -> DataFrame:
    """Records of files of any number of splits; scored adds scores and coding, the one that sniff_coding() finds."""
    rows = read_lines(spark, path, file_lines=True).select("file", F.col("file_line").alias("line_no"), "line")
    records = parse_fastq(rows)
    if not scored:
        return records
    coding = sniff_coding(records)
    return records.withColumn("coding", F.lit(coding)).withColumn("scores", scores(F.col("qual"), coding))


def is_fastq(lines: DataFrame) -> bool:
    """Whether (line_no, line) begins as FASTQ does."""
    first = lines.where(F.col("line_no") == 0).select(F.col("line").startswith("@")).first()
    return bool(first and first[0])


def sniff_coding(records: DataFrame) -> str:
    """phred where every quality character of all records allows it, else solexa."""
    found = records.agg(F.coalesce(F.bool_and(valid_quality(F.col("qual"), "phred")), F.lit(True))).first()[0]
    return "phred" if found else "solexa"


def write_fasta(records: DataFrame, path: str, width: int = 50) -> None:
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / width).cast("int")), lambda i: F.substring(F.col("seq"), i * width + 1, F.lit(width))), "\n")
    records.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), body).alias("value")).write.text(path)
