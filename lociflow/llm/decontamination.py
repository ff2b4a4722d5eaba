"""Benchmark decontamination: document words inside any benchmark window, and the removal of them or their documents.

A window is WINDOW consecutive words of an item, or the whole item where it is shorter. Any occurrence of a window of
L words contains a gram of (L + 1) // 2 words that begins at a multiple of L - (L + 1) // 2 + 1 in the document. So
only grams at those positions are hashed (one in six words for L = 10) and looked up among the hashes of all grams of
the benchmark; a hit is verified word by word for every window around the gram.

A row of the benchmark's index has a gram and the words of the item that a window around it can have, no whole item.
The index is broadcast after its rows and bytes are counted; above INDEX_ROWS or INDEX_BYTES both lookups are shuffle
joins, where Spark's skew join splits grams of many documents.

Defined cases: a null text has no words; an item without words has no window; items of equal text all count; repeated
rows of a document each give a row; texts of any length are looked at as a whole; null item ids are left out of the list of items, their windows still hit; an empty
table of documents gives an empty result, an empty benchmark hits nothing; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, documents, kept_runs, kept_text, row_key, sha256_hex, without

WINDOW = 10
INDEX_ROWS, INDEX_BYTES = 500_000, 64 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same on text whose capitals still stand.
CASED = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: A word with what separates it from the next one, or what stands before the first word.
PIECES = f"[^{CASED}]+[{CASED}]*|[{CASED}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def gram_size(length: int) -> tuple[int, int]:
    """Words of a gram, and the stride of document positions, for windows of so many words."""
    size = (length + 1) // 2
    return size, length - size + 1


def _gram(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), F.slice(words, at + 1, F.lit(gram_size(length)[0])))


def _positions(words: Column, length: int, stride: int) -> Column:
    """0, stride, ... as long as a gram fits."""
    last = F.size(words) - gram_size(length)[0]
    return F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, lengths: list[int], stride: bool) -> Column:
    """Array of struct(length, at, h) of all grams, or of those at the strides."""
    def of(n: int) -> Column:
        at_each = _positions(words, n, gram_size(n)[1] if stride else 1)
        return F.transform(at_each, lambda at: F.struct(F.lit(n).alias("length"), at.cast("int").alias("at"), _gram(words, at, n).alias("h")))

    return F.concat(F.array().cast("array<struct<length:int,at:int,h:bigint>>"), *[of(n) for n in lengths])


def _starts(words: Column, at: Column, item: Column, item_at: Column, length: Column) -> Column:
    """Where windows around the gram begin in the document, compared word by word."""
    back = F.floor(length / 2)

    def same(p: Column) -> Column:
        r = item_at - at + p
        inside = (p >= 0) & (r >= 0) & (p + length <= F.size(words)) & (r + length <= F.size(item))
        return inside & (F.slice(words, p + 1, length) == F.slice(item, r + 1, length))

    return F.filter(F.transform(F.sequence(F.lit(0), back.cast("int")), lambda k: at - k), same)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, index_rows: int = INDEX_ROWS) -> DataFrame:
    """doc_id, text_key, n_words, hit (ascending word positions) and items (ascending ids as text) of every row of docs."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item")).where(F.size("item") > 0)
    width = F.least(F.size("item"), F.lit(window))
    lengths = sorted(r[0] for r in items.select(width.alias("n")).distinct().collect())  # at most window values
    grams = items.withColumn("width", width).select(
        "item_id", "item", "width", F.explode_outer(_grams(F.col("item"), lengths, stride=False)).alias("g")
    )
    # of the item, the words that windows around the gram have
    at, back = F.col("g.at"), F.floor(F.col("width") / 2).cast("int")
    near = F.slice("item", F.greatest(at - back, F.lit(0)) + 1, F.least(at, back) + F.col("width"))
    index = cut(grams.where(F.col("g.length") == F.col("width")).select(F.col("g.h").alias("h"), F.least(at, back).alias("item_at"), "item_id", near.alias("item")))
    size = index.agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("item", F.lit(0), lambda a, w: a + F.octet_length(w) + 8)).alias("bytes")).first()
    small = size.n <= index_rows and (size.bytes or 0) <= INDEX_BYTES

    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("k"), words_of(F.col("text")).alias("words"))
    # explode_outer: for explode, Spark adds a filter that repeats the expression of the array with its words inlined
    probes = F.concat(
        F.array(F.struct(F.lit(0).alias("length"), F.lit(-1).alias("at"), F.lit(None).cast("bigint").alias("h"))),
        _grams(F.col("words"), lengths, stride=True),
    )
    probed = rows.select("doc_id", "k", "words", F.size("words").alias("n_words"), probes.alias("probes")).select(
        "doc_id", "k", "words", "n_words", F.explode_outer("probes").alias("p")
    )
    probed = probed.select("doc_id", "k", "words", "n_words", F.col("p.length").alias("length"), F.col("p.at").alias("at"), F.col("p.h").alias("h"))
    starts = _starts(F.col("words"), F.col("at"), F.col("item"), F.col("item_at"), F.col("length"))
    columns = ["doc_id", "k", "n_words", "at", "length", "item_id"]
    if small:
        joined = probed.join(F.broadcast(index), "h", "left").where(F.col("item").isNotNull() | (F.col("at") < 0))
        found = joined.select(*columns, F.when(F.col("at") >= 0, starts).alias("starts"))
    else:
        near = probed.drop("words").join(index, "h").distinct()
        verified = near.join(rows.select("k", "words").dropDuplicates(["k"]), "k").select(*columns, starts.alias("starts"))
        found = probed.where(F.col("at") < 0).select(*columns[:-1], F.lit(None).cast(dict(index.dtypes)["item_id"]).alias("item_id"), F.lit(None).cast("array<int>").alias("starts")).unionByName(verified)
    covered = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + F.col("length") - 1)))
    merged = found.groupBy("doc_id", "k").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("at") < 0, 1).otherwise(0)).alias("copies"),
        F.collect_list(F.when(F.size("starts") > 0, covered)).alias("hit"),
        F.collect_set(F.when(F.size("starts") > 0, F.col("item_id").cast("string"))).alias("items"),
    )
    return merged.select(
        "doc_id",
        F.col("k").alias("text_key"),
        F.col("n_words").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten("hit"))).alias("hit"),
        F.array_sort("items").alias("items"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, spans_only: bool = False) -> DataFrame:
    """docs without the contaminated rows; with spans_only, all rows, but their texts without the hit words."""
    found = hits(docs, benchmark, window).where(F.size("hit") > 0).select(F.col("text_key").alias("k"), "hit").dropDuplicates(["k"])
    keyed = docs.select(F.struct(*docs.columns).alias("row"), row_key(F.col("doc_id"), F.col("text")).alias("k"))
    if not spans_only:
        return without(keyed, found, "k").select("row.*")
    text = F.col("row.text")
    lead = F.when(text.rlike(f"^[{CASED}]"), 1).otherwise(0)
    parts = F.regexp_extract_all(text, F.lit(PIECES), 0)
    places = F.transform("hit", lambda i: (i + lead).cast("int"))
    left = kept_text(parts, kept_runs(places, F.size(parts)), "")
    cleaned = F.when(F.col("hit").isNull(), text).otherwise(left)
    return keyed.join(found, "k", "left").select(*[cleaned.alias(c) if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns])


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return hits(documents(spark, sf_dir), benchmark).select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256_hex(F.array_join("items", ",")).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, i, windows.n AS n FROM places JOIN windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
