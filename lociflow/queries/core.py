"""Reads, windows, tests, intervals, levels, sequences and distributions."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna, quality, sam, text
from ..operators import cpgs, distributions, intervals, levels, significance, smoothing, windows
from ..operators.ordered import with_before
from ..sources import fasta, regions
from .base import EXPLODED_SQL, L_SQL, LIMITS_SQL, O_SQL, Q_SQL, READS_SQL, SERIES_SQL, line_regions, order_regions, query, reads, sequences, series, table


@query(f"WITH {READS_SQL}, {LIMITS_SQL}, {EXPLODED_SQL} SELECT chr, w, count(*) AS n_reads, CAST(sum(least(pos + length(seq), w + 10) - greatest(pos, w)) AS BIGINT) AS coverage FROM ex GROUP BY chr, w")
def windows_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_coverage(windows.with_runs(reads(spark, sf_dir))).drop("run_id")


@query(f"WITH {READS_SQL}, {LIMITS_SQL}, {EXPLODED_SQL} SELECT chr, count(*) AS windows_tested FROM (SELECT chr, w FROM ex GROUP BY chr, w HAVING sum(least(pos + length(seq), w + 10) - greatest(pos, w)) >= 40) GROUP BY chr")
def windows_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.covered_windows(windows.with_runs(reads(spark, sf_dir))).groupBy("chr").agg(F.count(F.lit(1)).alias("windows_tested"))


@query(
    f"""WITH {READS_SQL}, {LIMITS_SQL}, {EXPLODED_SQL},
clipped AS (SELECT chr, w, greatest(pos, w) AS p, substr(seq, greatest(w - pos, 0) + 1, least(pos + length(seq), w + 10) - greatest(pos, w)) AS s, count(*) AS n FROM ex GROUP BY ALL),
states AS (SELECT chr, w, p + i AS site, s[i + 1] AS state, n FROM (SELECT *, unnest(generate_series(0, length(s) - 1)) AS i FROM clipped)),
counts AS (SELECT chr, w, site, sum(CASE WHEN state = 'C' THEN n ELSE 0 END) AS m, sum(n) AS t FROM states WHERE state IN ('C', 'T') GROUP BY ALL)
SELECT chr, w, round(sum(m * ln((m + 1e-10) / (t + 2e-10)) + (t - m) * ln(1 - (m + 1e-10) / (t + 2e-10))), 4) AS log_likelihood FROM counts GROUP BY chr, w"""
)
def single_allele_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = windows.site_counts(windows.with_runs(reads(spark, sf_dir)))
    return windows.single_allele_likelihood(counts).select("chr", "w", F.round("log_likelihood", 4).alias("log_likelihood"))


EVENT_RUNS_SQL = """WITH c AS (SELECT event_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER (ORDER BY ts) THEN 0 ELSE 1 END AS f FROM events)
SELECT event_id, CAST(sum(f) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c"""


@query(EVENT_RUNS_SQL)
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type").withColumn("_day", F.to_date("ts"))
    marked = with_before(rows, [], "_day", [F.col("ts")], last=("lag", F.col("event_type")))
    marked = marked.withColumn("new", F.when(F.col("last") == F.col("event_type"), 0).otherwise(1))
    return with_before(marked, [], "_day", [F.col("ts")], runs=("sum", F.col("new"))).select("event_id", (F.coalesce("runs", F.lit(0)) + F.col("new")).alias("run"))


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.round(F.pow(F.col("l_discount") * 10, 3) * F.col("l_quantity") / 50 + F.col("l_partkey") / 1e6, 9)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"))


P_SQL = "v AS (SELECT l_orderkey, l_linenumber, round(pow(l_discount * 10, 3) * l_quantity / 50 + l_partkey / 1e6, 9) AS p FROM lineitem)"


@query(f"WITH {P_SQL}, r AS (SELECT p, row_number() OVER (ORDER BY p) AS i, lead(p) OVER (ORDER BY p) AS q, count(*) OVER () AS n FROM v) SELECT round(min(p), 6) AS cutoff FROM r WHERE q IS NULL OR q >= 0.05 * i / n")
def fdr_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p_values(spark, sf_dir)
    return spark.range(1).select(F.round(F.lit(significance.fdr_cutoff(rows, "p", rows.count(), 0.05)), 6).alias("cutoff"))


@query(f"WITH {P_SQL}, g AS (SELECT p, count(*) AS c FROM v GROUP BY p), u AS (SELECT p, sum(c) OVER (ORDER BY p) AS k FROM g), a AS (SELECT p, max(p * ((SELECT count(*) FROM v) / k)) OVER (ORDER BY p) AS adjusted FROM u) SELECT l_orderkey, l_linenumber, round(p, 6) AS p, round(adjusted, 6) AS adjusted FROM v JOIN a USING (p)")
def adjusted_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p_values(spark, sf_dir)
    return significance.adjusted(rows, "p", rows.count()).select("l_orderkey", "l_linenumber", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


def _island_sql(gap: int, out: str) -> str:
    return f"""WITH {L_SQL}, m AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY chrom ORDER BY s, e, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} >= s THEN 0 ELSE 1 END AS f FROM l),
g AS (SELECT *, sum(f) OVER (PARTITION BY chrom ORDER BY s, e, name ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT chrom, min(s) AS "start", max(e) AS "end"{out} FROM g GROUP BY chrom, i"""


@query(_island_sql(1, ", min(name ORDER BY s, e, name) FILTER (WHERE f = 1) AS name, round(min(score), 4) AS score"))
def collapse_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.collapse(line_regions(spark, sf_dir))
    return found.select("chrom", "start", "end", "name", F.round("score", 4).alias("score"))


@query(_island_sql(5, ", round(min(score), 4) AS score"))
def merge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_by_gap(line_regions(spark, sf_dir), 5).select("chrom", "start", "end", F.round("score", 4).alias("score"))


@query(_island_sql(0, ""))
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_intervals(line_regions(spark, sf_dir), order=("name",)).select("chrom", "start", "end")


@query(f"WITH {L_SQL}, {O_SQL} SELECT l.chrom AS chrom, l.s AS \"start\", l.e AS \"end\", l.name AS name, o.id AS b_id FROM l JOIN o ON l.chrom = o.chrom AND l.s < o.e AND o.s < l.e")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_join(line_regions(spark, sf_dir), order_regions(spark, sf_dir), 64).select("chrom", "start", "end", "name", "b_id")


@query(f"WITH {L_SQL}, {O_SQL} SELECT l.chrom AS chrom, greatest(l.s, o.s) AS \"start\", least(l.e, o.e) AS \"end\" FROM l JOIN o ON l.chrom = o.chrom AND l.s < o.e AND o.s < l.e")
def intersect_by_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intersect_by_base(line_regions(spark, sf_dir), order_regions(spark, sf_dir), 64)


@query(f"WITH {L_SQL}, {O_SQL}, r AS (SELECT *, row_number() OVER () AS place FROM l) SELECT r.name AS name, r.s AS \"start\", first(o.id ORDER BY o.s, o.e, o.id) AS n FROM r JOIN o ON r.chrom = o.chrom AND r.s >= o.s AND r.s < o.e GROUP BY r.place, r.name, r.s")
def assign_by_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.assign_by_start(line_regions(spark, sf_dir), order_regions(spark, sf_dir), 64, ("id",)).select("name", "start", F.col("big_id").alias("n"))


S_SQL = "s AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'CpG' WHEN 1 THEN 'CHH' ELSE 'CXGx' END AS context, round(l_discount * 10, 6) AS meth, CAST(l_quantity AS BIGINT) - 1 AS n FROM lineitem)"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.when(F.col("l_linenumber") % 3 == 0, "CpG").when(F.col("l_linenumber") % 3 == 1, "CHH").otherwise("CXGx")
    return table(spark, sf_dir, "lineitem").select(context.alias("context"), F.round(F.col("l_discount") * 10, 6).alias("meth"), (F.col("l_quantity").cast("bigint") - 1).alias("n_reads"))


_Z = NormalDist().inv_cdf(1 - levels.ALPHA / 2)
_W = f"(meth + {_Z * _Z!r} / (2 * m) {{}} {_Z!r} * sqrt(meth * (1 - meth) / m + {_Z * _Z!r} / (4 * m * m))) / (1 + {_Z * _Z!r} / m)"
LEVELS_SQL = f"""WITH {S_SQL}, c AS (SELECT *, n > 0 AND context NOT LIKE '%x' AS ok, CAST(greatest(n, 1) AS DOUBLE) AS m, CAST(round(meth * n) AS BIGINT) AS k FROM s),
w AS (SELECT *, {_W.format('-')} AS lo, {_W.format('+')} AS hi FROM c)
SELECT context, count(*) AS total_sites, count(*) FILTER (WHERE ok) AS sites_covered, coalesce(max(n) FILTER (WHERE ok), 0) AS max_depth, count(*) FILTER (WHERE context LIKE '%x') AS mutations,
CAST(coalesce(sum(k) FILTER (WHERE ok), 0) AS BIGINT) AS total_c, CAST(coalesce(sum(n - k) FILTER (WHERE ok), 0) AS BIGINT) AS total_t,
count(*) FILTER (WHERE ok AND lo > 0.5) AS called_meth, count(*) FILTER (WHERE ok AND hi < 0.5) AS called_unmeth, round(avg(meth) FILTER (WHERE ok), 6) AS mean_meth FROM w GROUP BY context"""


@query(LEVELS_SQL)
def methylation_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = levels.levels(sites(spark, sf_dir))
    return found.select("context", "total_sites", "sites_covered", "max_depth", "mutations", "total_c", "total_t", "called_meth", "called_unmeth", F.round("mean_meth", 6).alias("mean_meth"))


def stranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("strand", F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-"))
    grouped = rows.groupBy(F.col("l_suppkey").cast("string").alias("chrom"), F.col("l_partkey").alias("pos"), "strand").agg(F.round(F.avg("l_discount") * 10, 6).alias("meth"), F.count(F.lit(1)).alias("n_reads"))
    return grouped.withColumn("context", F.lit("CpG"))


@query(
    """WITH t AS (SELECT CAST(l_suppkey AS VARCHAR) AS chrom, l_partkey AS pos, l_linenumber % 2 = 0 AS plus, count(*) AS n, CAST(round(round(avg(l_discount) * 10, 6) * count(*)) AS BIGINT) AS m FROM lineitem GROUP BY ALL)
SELECT a.chrom AS chrom, a.pos AS pos, a.n + b.n AS n_reads, round((a.m + b.m) / greatest(a.n + b.n, 1), 6) AS meth FROM t a JOIN t b ON a.chrom = b.chrom AND a.pos + 1 = b.pos AND a.plus AND NOT b.plus"""
)
def mate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.merge_mates(stranded(spark, sf_dir)).select("chrom", "pos", "n_reads", F.round("meth", 6).alias("meth"))


@query(f"WITH {Q_SQL}, p AS (SELECT name, seq, unnest(generate_series(1, length(seq) - 1)) AS i FROM q WHERE length(seq) > 1) SELECT name AS chrom, row_number() OVER (PARTITION BY name ORDER BY i) - 1 AS ordinal, i - 1 AS position FROM p WHERE substr(seq, i, 2) = 'CG'")
def cpg_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cpgs.cpg_sites(sequences(spark, sf_dir), 4096)


@query(f"WITH {Q_SQL}, k AS (SELECT substr(seq, i, 3) AS kmer FROM (SELECT seq, unnest(generate_series(1, length(seq) - 2)) AS i FROM q WHERE length(seq) > 2)) SELECT kmer, count(*) AS n FROM k WHERE NOT contains(kmer, 'N') GROUP BY kmer")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.kmer_counts(sequences(spark, sf_dir), 3)


@query(f"WITH {Q_SQL} SELECT name, reverse(translate(seq, 'ACGT', 'TGCA')) AS revcomp, length(seq) AS n FROM q")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("name", dna.reverse_complement(F.col("seq")).alias("revcomp"), F.length("seq").cast("bigint").alias("n"))


@query(f"WITH {Q_SQL} SELECT name, seq FROM q")
def four_bit_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("name", dna.four_bit_text(dna.four_bit_words(F.col("seq")), F.length("seq")).alias("seq"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 1024 AS number FROM lineitem")
def kmer_number_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kmer = dna.number_kmer(F.col("l_partkey") % 1024, 5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", dna.kmer_number(kmer).alias("number"))


@query(
    r"""WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^!-\]]', '', 'g') AS t FROM documents)
SELECT doc_id, length(t) AS n, round(coalesce(list_sum(list_transform(string_split(t, ''), lambda c: CASE WHEN c = '' THEN 0.0 ELSE pow(10.0, -(ascii(c) - 33) / 10.0) END)), 0), 6) AS expected_errors FROM a"""
)
def phred_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[^!-\\]]", "")
    errors = F.aggregate(quality.scores(F.col("t")), F.lit(0.0), lambda a, s: a + quality.score_to_error(s))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("bigint").alias("n"), F.round(errors, 6).alias("expected_errors"))


@query(
    """SELECT f AS flags, (f & 16) <> 0 AS reverse, f | 1024 AS marked, f & ~4 AS mapped, xor(f, 64) AS flipped, concat_ws(' ', """
    + ", ".join(f"'{n}=' || CAST((f >> {i}) & 1 AS VARCHAR)" for i, n in enumerate(sam.FLAGS))
    + ") AS shown FROM (SELECT DISTINCT CAST(l_orderkey % 4096 AS INTEGER) AS f FROM lineitem)"
)
def sam_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("flags")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4096).cast("int").alias("flags")).distinct()
    return rows.select(f, sam.has_flag(f, "reverse").alias("reverse"), sam.set_flag(f, "duplicate").alias("marked"), sam.unset_flag(f, "unmapped").alias("mapped"), sam.flip_flag(f, "first").alias("flipped"), sam.flags_text(f).alias("shown"))


CIGAR_SQL = "c AS (SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS a, CAST(l_quantity AS INTEGER) AS b FROM lineitem)"


@query(
    f"""WITH {CIGAR_SQL} SELECT a || 'S' || b || 'M' || a || 'I' || b || 'D' || b || 'M' AS cigar, a + b + a + b + b AS total, a + b + a + b AS query_ops, b + b + b AS reference_ops,
b || 'M' || b || 'D' || a || 'I' || b || 'M' || a || 'S' AS reversed, a AS clipped, repeat('S', a) || repeat('M', b) || repeat('I', a) || repeat('D', b) || repeat('M', b) AS letters,
CASE WHEN b >= 7 THEN a || 'S7M' ELSE a || 'S' || b || 'M' || a || 'I' || CASE WHEN 7 - b <= b THEN (7 - b) || 'D' ELSE b || 'D' || least(7 - 2 * b, b) || 'M' END END AS cut FROM c"""
)
def cigar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("a"), F.col("l_quantity").cast("int").alias("b")).distinct()
    c = F.col("cigar")
    rows = rows.select("a", "b", F.concat(s("a"), F.lit("S"), s("b"), F.lit("M"), s("a"), F.lit("I"), s("b"), F.lit("D"), s("b"), F.lit("M")).alias("cigar"))
    return rows.select(
        "cigar", sam.length(c).alias("total"), sam.length(c, "query").alias("query_ops"), sam.length(c, "reference").alias("reference_ops"), sam.reverse(c).alias("reversed"),
        sam.soft_clip(c).alias("clipped"), sam.expand(c).alias("letters"), sam.truncate(c, F.lit(7), "reference").alias("cut"),
    )


@query("SELECT DISTINCT 'chr' || CAST(l_suppkey AS VARCHAR) AS chrom, l_partkey AS \"start\", l_partkey + CAST(l_quantity AS BIGINT) AS \"end\" FROM lineitem")
def region_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.region_name(F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")), F.col("l_partkey"), F.col("l_partkey") + F.col("l_quantity").cast("bigint"))
    return table(spark, sf_dir, "lineitem").select(text.parse_region_name(name).alias("r")).select("r.*").distinct()


@query(f"WITH {L_SQL} SELECT chrom, s AS \"start\", e AS \"end\", name, round(score, 4) AS score, '+' AS strand FROM l")
def bed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_regions(spark, sf_dir).withColumn("strand", F.lit("+")).select(regions.region_line().alias("value"))
    return regions.parse_regions(lines).select("chrom", "start", "end", "name", F.round("score", 4).alias("score"), "strand")


@query("SELECT CAST(doc_id AS VARCHAR) AS name, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS seq FROM documents")
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z\n]", "")
    lines = F.split(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("\n"), letters), "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(lines).alias("i", "line"))
    return fasta.parse_fasta(rows.select((F.shiftleft("doc_id", 20) + F.col("i")).alias("line_no"), "line"))


@query(
    """SELECT round(avg(value), 6) AS exponential, round((SELECT avg(l_quantity) FROM lineitem), 6) AS poisson, round((SELECT 1 / (1 + avg(l_quantity)) FROM lineitem), 6) AS geometric,
round((SELECT avg(l_quantity) / 50 FROM lineitem), 6) AS binomial, round(sum(-ln(100) - value / 100) / count(*), 6) AS exponential_ll FROM events"""
)
def fit_closed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, lines = table(spark, sf_dir, "events"), table(spark, sf_dir, "lineitem")
    found = [distributions.fit(events, "exp", "value")[0], distributions.fit(lines, "pois", "l_quantity")[0], distributions.fit(lines, "geo", "l_quantity")[0], distributions.fit(lines, "binom", "l_quantity", n=50)[1]]
    mean = events.agg((F.sum(distributions.log_likelihood("exp", F.col("value"), [100.0])) / F.count(F.lit(1))).alias("ll"))
    names = ("exponential", "poisson", "geometric", "binomial")
    return mean.select(*[F.round(F.lit(float(x)), 6).alias(n) for n, x in zip(names, found, strict=True)], F.round("ll", 6).alias("exponential_ll"))


@query("SELECT CAST(floor(l_quantity / 5) AS INTEGER) AS bin, count(*) AS n, CAST(floor(l_quantity / 5) * 5 AS DOUBLE) AS low FROM lineitem GROUP BY ALL")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", [5.0 * i for i in range(11)])


@query(f"WITH {SERIES_SQL}, p AS (SELECT a.key AS key, a.x AS x, b.y AS y, 0.75 * (1 - pow((b.x - a.x) / 24.0, 2)) AS w FROM (SELECT DISTINCT key, x FROM e) a JOIN e b ON a.key = b.key AND b.x - a.x >= -24 AND b.x - a.x < 24) SELECT key, round(x, 4) AS x, round(sum(w * y) / sum(w), 6) AS y FROM p GROUP BY key, p.x")
def kernel_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.kernel_smooth(series(spark, sf_dir), 24.0).select("key", F.round("x", 4).alias("x"), F.round("y", 6).alias("y"))
