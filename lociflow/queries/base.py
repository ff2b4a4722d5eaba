"""The queries by name with their SQL, and the inputs that they make from the driver's tables.

Inputs are made from the tables: line items as reads (chromosome l_returnflag, sorted by place), as intervals
(chromosome l_suppkey, days of l_shipdate) and as methylation sites; documents as sequences; events as series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The states of a read: a cut of a fixed pattern.
PATTERN = "CTTNCCTCTT"
#: Reads of a range of their sort.
RANGE_ROWS = 1 << 19


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, chr, pos, seq; line_no ascends by chromosome and place, as in a sorted file (a sort by ranges, with gaps between them).

    The ranges follow the rows: equal reads take so few bytes that Spark would put all of them into a few tasks.
    """
    long = F.floor(F.col("l_quantity") / 5).cast("int") + 1
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.col("l_returnflag").alias("chr"), F.col("l_partkey").alias("pos"), F.substring(F.lit(PATTERN * 3), F.col("l_linenumber").cast("int"), long).alias("seq")
    )
    ranges = rows.repartitionByRange(max(8, -(-lines.count() // RANGE_ROWS)), "chr", "pos", "seq").sortWithinPartitions("chr", "pos", "seq")
    return ranges.select(F.monotonically_increasing_id().alias("line_no"), "chr", "pos", "seq")


READS_SQL = f"reads AS (SELECT l_returnflag AS chr, l_partkey AS pos, substr('{PATTERN * 3}', l_linenumber, CAST(floor(l_quantity / 5) AS INTEGER) + 1) AS seq FROM lineitem WHERE l_partkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_quantity IS NOT NULL)"
LIMITS_SQL = "lims AS (SELECT chr, greatest(1, max(pos + length(seq)) - 9) AS lim FROM reads GROUP BY chr)"
EXPLODED_SQL = "ex AS (SELECT chr, pos, seq, unnest(generate_series(greatest(0, pos - 9), least(pos + length(seq), lim) - 1)) AS w FROM reads JOIN lims USING (chr))"


def line_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_date(F.to_date("l_shipdate")).cast("bigint")
    name = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("bigint")).alias("end"), name.alias("name"), F.col("l_discount").cast("float").alias("score"))


def order_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_date(F.to_date("o_orderdate")).cast("bigint")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).cast("string").alias("chrom"), start.alias("start"), (start + F.col("o_orderkey") % 40 + 1).alias("end"), F.col("o_orderkey").alias("id"))


L_SQL = "l AS (SELECT CAST(l_suppkey AS VARCHAR) AS chrom, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) + CAST(l_quantity AS BIGINT) AS e, concat_ws(':', l_orderkey, l_linenumber, l_partkey) AS name, CAST(l_discount AS FLOAT) AS score FROM lineitem)"
O_SQL = "o AS (SELECT CAST(o_custkey % 100 AS VARCHAR) AS chrom, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + o_orderkey % 40 + 1 AS e, o_orderkey AS id FROM orders)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name and seq of letters A, C, G, T, N from the documents' ASCII letters."""
    ascii_text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), dna.five_letters(F.translate(ascii_text, "eiouEIOUhH", "CGTACGTACC")).alias("seq"))


Q_SQL = "q AS (SELECT CAST(doc_id AS VARCHAR) AS name, regexp_replace(upper(translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), 'eiouEIOUhH', 'CGTACGTACC')), '[^ACGT]', 'N', 'g') AS seq FROM documents)"


SERIES_SQL = "e AS (SELECT user_id AS key, epoch(ts) / 3600.0 AS x, value AS y FROM events)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1e6 / 3600.0).alias("x"), F.col("value").alias("y"))
