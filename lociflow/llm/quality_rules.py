r"""Quality rules as a ledger: every rule is evaluated once, and policies are read off the stored bits.

ledger() measures a text in one pass of column expressions and stores, beside the measurements, a bit for each rule that
the text fails. A policy is a version and the rules that it rejects by: applied() compares its mask with the bits, so
that a new version, or the same rules over last year's ledger, reads no text. ablations() counts the documents of each
pattern of bits, and from these few rows what each policy rejects, by each rule alone and with each rule left out.

A word is what lies between characters of [\x20\x09-\x0D]; a repeated window is 8 consecutive words found twice or more
in the text, by 64-bit hashes. All work is linear in the text but for a sort of the windows of texts that repeat one.

Defined cases: a null text has no words, and so fails few_words; an empty text is the same; a null doc_id stays null;
repeated rows are rows each; a tie with a threshold passes; a text of any length is measured whole; an empty table gives
an empty ledger and no ablations; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, documents

#: What words lie between; all of one byte.
SPACES = " \t\n\x0b\x0c\r"
#: The words of a window, of which hashes are joined by twos, fours and eights.
WINDOW = 8
#: Rules by bit, lowest first: the name and when a text fails it, in whole numbers of the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("capitals", "2 * n_capitals > word_chars"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


@dataclass(frozen=True)
class Policy:
    """A version of what is rejected: documents that fail any of the rules."""

    version: str
    rules: tuple[str, ...]

    def mask(self) -> int:
        bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
        if unknown := [r for r in self.rules if r not in bits]:
            raise ValueError(f"no such rule: {', '.join(unknown)}")
        return reduce(int.__or__, (bits[r] for r in self.rules), 0)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = (BASE, Policy("v1", (*BASE.rules, "symbols", "duplicate_lines")), Policy("v2", tuple(name for name, _ in RULES)))


def repeated_words(hashes: Column) -> Column:
    """How many places of an array of hashes lie in a window of WINDOW of it that comes twice or more."""
    n = F.size(hashes)

    def joined(own: Column, by: int) -> Column:
        """A hash of each place and the one by places on."""
        return F.zip_with(own, F.slice(own, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))

    def covered(places: Column) -> Column:
        """Of windows at ascending places, the places in any of them."""
        own = F.transform(places, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(x - F.get(places, k - 1), F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def twice(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        same = lambda x, other: x["g"] == other["g"]
        marked = lambda own: F.transform(own, lambda x, k: F.when(same(x, F.get(own, k - 1)) | same(x, F.get(own, k + 1)), x["i"]))
        places = bound(placed, lambda own: F.sort_array(F.filter(marked(own), lambda i: i.isNotNull())))
        return bound(places, covered)

    pairs = lambda own: bound(joined(own, 1), lambda two: bound(joined(two, 2), lambda four: joined(four, 4)))
    grams = F.slice(pairs(hashes), F.lit(1), n - (WINDOW - 1))
    return F.when(n <= WINDOW, 0).otherwise(bound(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(twice(g))))


def measured(text: Column) -> Column:
    """A struct of MEASURES of a whole text, all whole numbers."""
    text = F.coalesce(text, F.lit(""))
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACES[1:], text)
    said = F.filter(F.split(spaced, " "), lambda w: w != "")
    with_word = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    spaces = F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))
    marks = F.regexp_replace(text, r"[^A-Z#*$%&|<>]+", "")

    def lines(own: Column) -> Column:
        return F.struct(F.size(own).cast("long").alias("n"), (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("again"))

    def words(own: Column) -> Column:
        return F.struct(F.size(own).cast("long").alias("n"), repeated_words(own).cast("long").alias("again"))

    def marked(own: Column) -> Column:
        capitals = F.length(F.regexp_replace(own, "[^A-Z]+", ""))
        return F.struct(capitals.cast("long").alias("capitals"), (F.length(own) - capitals).cast("long").alias("symbols"))

    w = bound(F.transform(said, lambda x: F.xxhash64(x)), words)
    each = F.struct(w.alias("w"), bound(with_word, lines).alias("l"), bound(marks, marked).alias("s"))
    return bound(
        each,
        lambda m: F.struct(
            m["w"]["n"].alias("n_words"), (F.length(text) - spaces).cast("long").alias("word_chars"), m["s"]["symbols"].alias("n_symbols"), m["l"]["n"].alias("n_lines"),
            m["l"]["again"].alias("n_dup_lines"), m["w"]["again"].alias("n_repeat_words"), m["s"]["capitals"].alias("n_capitals"),
        ),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and failures (a bit for each rule that the text fails) of every row."""
    rows = docs.select("doc_id", measured(F.col("text")).alias("m")).select("doc_id", "m.*")
    bits = [F.when(F.expr(fails), F.lit(1 << i)).otherwise(0).cast("long") for i, (_, fails) in enumerate(RULES)]
    return rows.select("*", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("failures"))


def rejects(policy: Policy) -> Column:
    """Whether a row of the ledger fails any rule of the policy."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask()).cast("long")) != 0


def applied(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger with a column kept_<version> for each policy."""
    return rows.select("*", *[(~rejects(p)).alias(f"kept_{p.version}") for p in policies])


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """version, rule, n_docs, n_rejected, n_failed (the rule), n_alone (by that rule only: what leaving it out would keep)
    and others (the bits of the policy's other rules that documents failing it also fail), a row for each rule of each
    policy.

    The ledger is counted by pattern first: at most 2 ** rules rows, whatever the number of documents, meet the policies.
    """
    patterns = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    masks = F.array(*[F.struct(F.lit(p.version).alias("version"), F.lit(p.mask()).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(Policy("", (r,)).mask()).cast("long").alias("bit")) for p in policies for r in p.rules])
    each = patterns.select("n", "failures", F.explode(masks).alias("p")).select("n", "p.*", F.col("failures").bitwiseAND(F.col("p.mask")).alias("bits"))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("version", "rule").agg(
        F.sum("n").alias("n_docs"),
        total(F.col("bits") != 0).alias("n_rejected"),
        total(fails).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_alone"),
        F.coalesce(F.bit_or(F.when(fails, F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))))), F.lit(0)).cast("long").alias("others"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the newest policy."""
    rows = ledger(documents(spark, sf_dir))
    base, newest = rejects(BASE), rejects(POLICIES[-1])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~newest).alias("kept"), "failures")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(ledger(documents(spark, sf_dir)))


_LEDGER_SQL = rf"""
d AS (SELECT row_number() OVER () AS place, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT place, i, x[i] AS w FROM (SELECT place, x, unnest(generate_series(1, len(x))) AS i FROM (SELECT place, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS x FROM d))),
g AS (SELECT place, i, concat_ws(' ', w, {', '.join(f'lead(w, {k}) OVER o' for k in range(1, WINDOW))}) AS g, lead(w, {WINDOW - 1}) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY place ORDER BY i)),
twice AS (SELECT place, i, CASE WHEN whole AND count(*) FILTER (WHERE whole) OVER (PARTITION BY place, g) > 1 THEN i END AS found FROM g),
c AS (SELECT place, count(*) AS n_words, count(*) FILTER (WHERE i - seen < {WINDOW}) AS n_repeat_words
  FROM (SELECT place, i, max(found) OVER (PARTITION BY place ORDER BY i) AS seen FROM twice) GROUP BY place),
l AS (SELECT place, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT place, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY place),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM d LEFT JOIN c USING (place) LEFT JOIN l USING (place)),
ledger AS (SELECT *, CAST({' + '.join(f'CASE WHEN {fails} THEN {1 << i} ELSE 0 END' for i, (_, fails) in enumerate(RULES))} AS BIGINT) AS failures FROM m)"""

OP12_SQL = f"WITH {_LEDGER_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & {BASE.mask()} <> 0 AS base_failed, failures & {BASE.mask() | POLICIES[-1].mask()} = 0 AS kept, failures FROM ledger"

ABLATIONS_SQL = f"""WITH {_LEDGER_SQL}, p(version, mask, rule, bit) AS (VALUES {', '.join(f"('{p.version}', {p.mask()}, '{r}', {Policy('', (r,)).mask()})" for p in POLICIES for r in p.rules)})
SELECT version, rule, count(*) AS n_docs, count(*) FILTER (WHERE failures & mask <> 0) AS n_rejected, count(*) FILTER (WHERE failures & bit <> 0) AS n_failed, count(*) FILTER (WHERE failures & mask = bit) AS n_alone,
CAST(coalesce(bit_or(CASE WHEN failures & bit <> 0 THEN failures & mask & ~bit END), 0) AS BIGINT) AS others FROM ledger, p GROUP BY version, rule"""
