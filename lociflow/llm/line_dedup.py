"""Removal of lines that many documents share.

Lines are keyed by 128 bits of their normalised text. (hash, document, position) rows are range-partitioned by hash and
sorted by hash, document and position. Windows stream over that one order: they mark the first occurrence of each hash
and count its documents, without another exchange, and only rows of lines that may go leave the stage. What comes back
for a document is not its text but the runs of its keep bitmap, from which its kept text is cut.

A line that makes up more than a share of 1 / HOT_KEYS of a sample of documents, or of which the sample tells PART_ROWS rows
or more in all, is dealt by hash and document to so many parts that each has about PART_ROWS rows, and SALTS at least;
first places and counts of the parts are put together in a table with a row for each such line, which is broadcast if a
count finds it small. The sample decides how rows are dealt, not what is found: every line is counted over all documents.

Defined cases: a null or empty text is one empty line; lines whose key is shorter than min_chars are always kept; a
document is a row, so that rows of equal doc_id and text share one bitmap but each counts as a document of its own; null
doc_ids come before others; a text of any length is split as a whole; an empty table gives an empty result; columns
other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, cut, documents, if_small, kept_runs, kept_text, row_key, sha256_hex

MIN_DOCUMENTS = 10
MIN_CHARS = 1
#: Lines are dealt in parts if they have HOT_ROWS rows in a sample of so many documents, and a share of 1 / HOT_KEYS of it or
#: PART_ROWS rows in all by its estimate.
SAMPLED, HOT_ROWS, HOT_KEYS, SALTS, PART_ROWS = 1 / 64, 8, 4096, 256, 1 << 16


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def line_places(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, k (the row_key), n_lines, at (from 0) and h1, h2 of every line whose key has min_chars or more."""
    lines = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("k"), lines_of(F.col("text")).alias("lines"))
    # explode_outer: for explode, Spark adds a filter that splits the text again
    placed = lines.select("doc_id", "k", F.size("lines").alias("n_lines"), F.posexplode_outer("lines").alias("at", "line"))
    keyed = placed.select("doc_id", "k", "n_lines", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "k", "n_lines", "at", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))


def hot_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1 and parts of the lines that a sample shows to be very common."""
    counts = cut(line_places(docs.sample(SAMPLED, seed=0), min_chars).groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_ROWS))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = F.col("n") / SAMPLED
    parts = F.greatest(F.lit(SALTS), F.ceil(rows / PART_ROWS)).cast("long")
    return counts.where((F.col("n") * HOT_KEYS >= total) | (rows >= PART_ROWS)).select("h1", parts.alias("parts"))


def streamed(places: DataFrame) -> DataFrame:
    """places (with part) in ranges of hashes, and of each line in a part: first, the place of its first occurrence, and
    documents; leads is 1 where a document has the line first."""
    dealt = places.repartitionByRange("h1", "part")
    line = W.partitionBy("h1", "part")
    leads = F.rank().over(W.partitionBy("h1", "part", "doc_id", "k").orderBy("at")) == 1  # equal rows lead together
    place = F.struct("doc_id", "k", "at")
    return dealt.withColumn("leads", leads.cast("int")).select(
        "*",
        F.first(place).over(line.orderBy("doc_id", "k", "at").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("first"),
        F.sum("leads").over(line).alias("documents"),
    )


def keep_bitmaps(docs: DataFrame, min_documents: int = 2, min_chars: int = MIN_CHARS, keep_first: bool = True) -> DataFrame:
    """k, n_lines, keep_runs for each distinct (doc_id, text) that loses lines; k is its row_key.

    A line goes if its key is found in min_documents documents or more; with keep_first its first occurrence stays.
    keep_runs has the start and length of each run of kept lines, ascending.
    """
    places = if_small(line_places(docs, min_chars), hot_lines(docs, min_chars), "h1", "left")
    hot = F.col("parts").isNotNull()
    part = F.xxhash64("h2", F.coalesce(F.pmod("k.a", "parts"), F.lit(-1)))
    rows = streamed(places.select("h1", "h2", part.alias("part"), hot.alias("hot"), "doc_id", "k", "at", "n_lines"))
    found = cut(rows.where(F.col("hot") | (F.col("documents") >= min_documents)))
    parts = found.where("hot").groupBy("h1", "h2").agg(F.sum("leads").alias("all_documents"), F.min("first").alias("all_first"))
    whole = if_small(found, parts, ["h1", "h2"], "left")
    lost = whole.where(~F.col("hot") | (F.col("all_documents") >= min_documents))
    if keep_first:
        kept = F.when(F.col("hot"), F.col("all_first")).otherwise(F.col("first"))
        lost = lost.where((F.col("k") != kept["k"]) | (F.col("at") != kept["at"]))
    per_document = lost.groupBy("k").agg(F.array_sort(F.collect_set("at")).alias("dropped"), F.max("n_lines").alias("n_lines"))
    return per_document.select("k", "n_lines", kept_runs(F.col("dropped"), F.col("n_lines")).alias("keep_runs"))


def dedup_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """docs with n_lines, n_dropped, keep_runs and kept, the text without its dropped lines; columns of these names go."""
    maps = keep_bitmaps(docs, min_documents, min_chars, keep_first)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "keep_runs", "kept")]
    text = F.col("row.text")
    rows = docs.select(F.struct(*own).alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("k"))
    lines = lines_of(text)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size(lines).alias("length")))
    left = F.aggregate("keep_runs", F.lit(0), lambda a, r: a + r["length"])
    return rows.join(maps, "k", "left").select(
        "row.*",
        F.coalesce(F.col("n_lines"), F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.col("n_lines") - left, F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("keep_runs", whole).alias("keep_runs"),
        F.when(F.col("keep_runs").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept_text(lines, F.col("keep_runs"), "\n")).alias("kept"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops every line that at least ten documents have."""
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept")).alias("kept_sha256")
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP3_SQL = f"""
WITH lines AS (
  SELECT place, doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT row_number() OVER () AS place, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT place, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM lines
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT place) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN common.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY place, doc_id
"""
