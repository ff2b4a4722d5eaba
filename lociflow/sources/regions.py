"""BED, methylation sites, mapped reads and SAM as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SITE_SCHEMA = "chrom string, pos bigint, strand string, context string, meth double, n_reads bigint"
SAM_FIELDS = (("qname", "string"), ("flags", "int"), ("rname", "string"), ("pos", "bigint"), ("mapq", "smallint"), ("cigar", "string"), ("rnext", "string"), ("pnext", "bigint"), ("tlen", "int"), ("seq", "string"), ("qual", "string"))


def parse_regions(lines: DataFrame) -> DataFrame:
    """chrom, start, end, name, score (float), strand of BED lines; browser and track lines go. Strand is + unless -."""
    p = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("browser") & ~F.col("value").startswith("track") & (F.trim("value") != ""))
    number = lambda i: F.coalesce(F.regexp_extract(F.coalesce(F.get(p, F.lit(i)), F.lit("")), r"^\s*(-?\d+)", 1).try_cast("bigint"), F.lit(0))
    return rows.select(
        F.get(p, F.lit(0)).alias("chrom"), number(1).alias("start"), number(2).alias("end"), F.coalesce(F.get(p, F.lit(3)), F.lit("")).alias("name"),
        F.coalesce(F.get(p, F.lit(4)).try_cast("float"), F.lit(0).cast("float")).alias("score"), F.when(F.get(p, F.lit(5)) == "-", "-").otherwise("+").alias("strand"),
    )


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return parse_regions(spark.read.text(path))


def region_line() -> Column:
    """Six columns, or three where the name is empty; scores with six significant digits."""
    from ..plans.scan import score_text

    three = F.concat_ws("\t", "chrom", "start", "end")
    return F.when(F.col("name") == "", three).otherwise(F.concat_ws("\t", three, "name", score_text(F.col("score")), "strand"))


def write_regions(regions: DataFrame, path: str, track: str | None = None) -> None:
    """Text files in the order of chrom, start and end; the track line is the first one of the first file."""
    order = [F.col(c) for c in ("chrom", "start", "end")]
    lines = regions.select(F.lit(1).alias("_part"), *order, region_line().alias("value"))
    if track is not None:
        head = regions.sparkSession.range(1).select(F.lit(0).alias("_part"), *[F.lit(None).cast(regions.schema[c].dataType).alias(c) for c in ("chrom", "start", "end")], F.lit(f"track name={track}").alias("value"))
        lines = head.unionByName(lines)
    lines.orderBy("_part", *order).select("value").write.text(path)


def parse_sites(lines: DataFrame) -> DataFrame:
    """chrom, pos, strand, context, meth, n_reads of lines of six fields; another strand, or a field too few, fails the query."""
    p = F.split("value", r"\s+")
    wrong = F.raise_error(F.concat(F.lit("not a site: "), F.col("value"))).cast("array<string>")
    good = (F.size(p) >= 6) & F.get(p, F.lit(1)).rlike("^[0-9]+$") & F.get(p, F.lit(2)).isin("+", "-")
    rows = lines.where(F.trim("value") != "").select(F.when(good, p).otherwise(wrong).alias("p"))
    names = [x.split() for x in SITE_SCHEMA.split(", ")]
    return rows.select(*[F.get("p", F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return parse_sites(spark.read.text(path))


#: Rows of a row group of a table of sites.
GROUP_ROWS = 100_000


def write_site_table(sites: DataFrame, path: str, group_rows: int = GROUP_ROWS) -> None:
    """Parquet files by ranges of chromosome and position, sorted, with row groups of bounded rows whose least and greatest
    values let sites_between() pass over them."""
    ordered = sites.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
    ordered.write.option("parquet.block.row.count.limit", str(group_rows)).option("parquet.page.row.count.limit", str(max(100, group_rows // 5))).parquet(path)


def sites_between(sites: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """The sites of a stretch; of a table of write_site_table() only the row groups that it meets are read."""
    return sites.where((F.col("chrom") == chrom) & F.col("pos").between(start, end - 1))


def cpg_sites_of(sites: DataFrame) -> DataFrame:
    """The sites of CpG context, mutated ones left out."""
    return sites.where(F.col("context").startswith("CpG") & ~F.col("context").endswith("x"))


def site_line() -> Column:
    return F.concat_ws("\t", "chrom", "pos", "strand", "context", "meth", "n_reads")


def write_sites(sites: DataFrame, path: str) -> None:
    sites.select(site_line().alias("value")).write.text(path)


METHDIFF_SCHEMA = "chrom string, pos bigint, strand string, context string, diffscore double, meth_a bigint, unmeth_a bigint, meth_b bigint, unmeth_b bigint"


def parse_methdiff(lines: DataFrame) -> DataFrame:
    """The columns of METHDIFF_SCHEMA of lines of nine fields; a field too few fails the query."""
    p = F.split("value", r"\s+")
    wrong = F.raise_error(F.concat(F.lit("not a site of two samples: "), F.col("value"))).cast("array<string>")
    rows = lines.where(F.trim("value") != "").select(F.when(F.size(p) >= 9, p).otherwise(wrong).alias("p"))
    names = [x.split() for x in METHDIFF_SCHEMA.split(", ")]
    return rows.select(*[F.get("p", F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def methdiff_line() -> Column:
    return F.concat_ws("\t", *[x.split()[0] for x in METHDIFF_SCHEMA.split(", ")])


def site_counts(sites: DataFrame) -> DataFrame:
    """chrom, start, end, m, u, n_reads: sites as regions of a base with their reads by state."""
    from ..operators.levels import n_meth, n_unmeth

    return sites.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), n_meth().alias("m"), n_unmeth().alias("u"), "n_reads")


def parse_mapped_reads(lines: DataFrame) -> DataFrame:
    """BED columns, seq and scr; without an end column, the end is start plus the sequence's length."""
    p = F.split(F.trim("value"), r"\s+")
    has_end = F.get(p, F.lit(2)).rlike("^[0-9]+$")
    at = lambda i: F.when(has_end, F.get(p, F.lit(i))).otherwise(F.get(p, F.lit(i - 1)))
    start = F.get(p, F.lit(1)).cast("bigint")
    end = F.when(has_end, F.get(p, F.lit(2)).try_cast("bigint")).otherwise(start + F.length(at(6)))
    return lines.select(F.get(p, F.lit(0)).alias("chrom"), start.alias("start"), end.alias("end"), at(3).alias("name"), at(4).try_cast("float").alias("score"), at(5).alias("strand"), at(6).alias("seq"), at(7).alias("scr"))


def mapped_read_line() -> Column:
    return F.concat_ws("\t", "chrom", "start", "end", "name", "score", "strand", "seq", "scr")


def parse_sam(lines: DataFrame) -> DataFrame:
    """The eleven fields and tags of SAM lines; header lines go."""
    p = F.split("value", "\t")
    record = ~F.col("value").startswith("@") & (F.size(p) >= 11)
    fields = [F.when(record, F.get(p, F.lit(i))).cast(kind).alias(name) for i, (name, kind) in enumerate(SAM_FIELDS)]
    return lines.where(record).select(*fields, F.slice(p, F.lit(12), F.greatest(F.size(p) - 11, F.lit(0))).alias("tags"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text, also compressed. BAM files are read by bam.read_bam(); CRAM needs a decoder that isn't here."""
    return parse_sam(spark.read.text(path))


def sam_line() -> Column:
    return F.concat_ws("\t", *[name for name, _ in SAM_FIELDS], F.col("tags"))


def sam_header(sequences: DataFrame, program: str, command: str) -> DataFrame:
    """value: @HD, a line for each (name, n) and @PG."""
    spark = sequences.sparkSession
    one = lambda s: spark.range(1).select(F.lit(s).alias("value"))
    lines = sequences.select(F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("n").cast("string")).alias("value"))
    return one("@HD\tVN:1.0").unionByName(lines).unionByName(one(f"@PG\tID:{program}\tCL:{command}"))


def write_lines(lines: DataFrame, path: str, gzip: bool = False) -> None:
    lines.select("value").write.text(path, **({"compression": "gzip"} if gzip else {}))


def region_sequences(regions: DataFrame, sequences: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """regions with seq: the upper-cased bases of each, reverse complement on the minus strand.

    Sequences are joined in pieces, so that a region meets only those it touches; regions of other chromosomes go.
    """
    from ..functions.dna import pieces, reverse_complement

    own = regions.columns
    counted = regions.groupBy(*own).agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    last = F.greatest(F.col("end") - 1, F.col("start"))
    numbers = F.sequence(F.floor(F.col("start") / piece).cast("int"), F.floor(last / piece).cast("int"))
    touched = counted.withColumn("piece", F.explode(numbers))
    joined = touched.join(pieces(sequences, piece).withColumnRenamed("name", "chrom"), ["chrom", "piece"])
    first = F.greatest(F.col("start") - F.col("piece").cast("bigint") * piece, F.lit(0))
    upto = F.least(F.col("end") - F.col("piece").cast("bigint") * piece, F.lit(piece))
    part = F.struct("piece", F.substring("s", (first + 1).cast("int"), (upto - first).cast("int")).alias("s"))
    whole = joined.groupBy(*own, "_copies").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    bases = F.array_join(F.transform("_parts", lambda x: x["s"]), "")
    told = whole.select(*own, bases.alias("_seq"), F.explode(F.array_repeat(F.lit(0), F.col("_copies"))))
    return told.select(*own, F.when(F.col("strand") == "-", reverse_complement(F.col("_seq"))).otherwise(F.col("_seq")).alias("seq"))


def mapped_reads_coding(reads: DataFrame) -> str:
    """phred where every score character of mapped reads (scr) allows it, else solexa."""
    from .fasta import sniff_coding

    return sniff_coding(reads.select(F.col("scr").alias("qual")))


def level_lines() -> Column:
    """The labelled block of a row of levels()."""
    names = ("total_sites", "sites_covered", "total_c", "total_t", "max_depth", "mutations", "called_meth", "called_unmeth", "mean_agg")
    return F.concat(F.col("context"), F.lit(":\n"), F.concat_ws("\n", *[F.concat(F.lit(f"    {n}: "), F.col(n).cast("string")) for n in names]))


def parse_levels(block: Column) -> Column:
    """Map of names to numbers of such a block."""
    body = F.regexp_replace(F.regexp_replace(block, r"^[^\n]*\n", ""), r"\s*\n\s*", "\n")
    return F.str_to_map(F.trim(body), F.lit("\n"), F.lit(": "))
