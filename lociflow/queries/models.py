"""The scan and its models, nearest regions, local lines and hidden Markov models; SQL goes step by step as the models do."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distributions, epialleles, hmm, intervals, smoothing, windows
from ..plans import scan
from .base import EXPLODED_SQL, L_SQL, LIMITS_SQL, O_SQL, READS_SQL, SERIES_SQL, line_regions, order_regions, query, reads, series, table


def clipped_sql(width: int = 10) -> str:
    """Clipped reads of the tested windows (c: chr, w, id, p, s, n), their states (st) and the windows (win)."""
    exploded = LIMITS_SQL.replace("- 9)", f"- {width - 1})") + ", " + EXPLODED_SQL.replace("pos - 9", f"pos - {width - 1}")
    size = f"least(pos + length(seq), w + {width}) - greatest(pos, w)"
    return f"""{READS_SQL}, {exploded},
c AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM (SELECT chr, w, greatest(pos, w) AS p, substr(seq, greatest(w - pos, 0) + 1, {size}) AS s, count(*) AS n FROM ex GROUP BY ALL)),
win AS MATERIALIZED (SELECT chr, w, CAST(sum(n) AS BIGINT) AS n_reads, max(p + length(s)) - min(p) AS n_cpgs FROM c GROUP BY chr, w HAVING sum(length(s) * n) >= {width * 4}),
st AS MATERIALIZED (SELECT * FROM (SELECT chr, w, id, n, p + i AS site, s[i + 1] AS state FROM (SELECT c.*, unnest(generate_series(0, length(s) - 1)) AS i FROM c JOIN win USING (chr, w))) WHERE state <> 'N')"""


def models_sql(rounds: int = 10) -> str:
    """fits: the likelihoods of both models in each window, from clipped_sql(), by rounds of expectation and maximisation."""
    yes = lambda a: f"CASE state WHEN 'C' THEN ln({a}) ELSE ln(1 - {a}) END"
    steps = [
        "one AS MATERIALIZED (SELECT chr, w, site, (sum(CASE state WHEN 'C' THEN n ELSE 0 END) + 1e-10) / (sum(n) + 2e-10) AS a FROM st GROUP BY ALL)",
        f"single AS MATERIALIZED (SELECT chr, w, sum(n * {yes('a')}) AS ll FROM st JOIN one USING (chr, w, site) GROUP BY ALL)",
        "a0 AS MATERIALIZED (SELECT DISTINCT chr, w, site, 0.25::DOUBLE AS a1, 0.75::DOUBLE AS a2 FROM st)",
        "k0 AS MATERIALIZED (SELECT chr, w, -1.7976931348623157e308::DOUBLE AS score, TRUE AS going FROM win)",
    ]
    for i in range(rounds):
        steps += [
            f"l{i} AS MATERIALIZED (SELECT c.chr, c.w, c.id, any_value(c.n) AS n, ln(0.5) + coalesce(sum({yes('a1')}), 0) AS l1, ln(0.5) + coalesce(sum({yes('a2')}), 0) AS l2 FROM c JOIN win USING (chr, w) LEFT JOIN st ON st.id = c.id LEFT JOIN a{i} a ON a.chr = st.chr AND a.w = st.w AND a.site = st.site GROUP BY c.chr, c.w, c.id)",
            f"p{i} AS MATERIALIZED (SELECT *, exp(l1 - t) AS q FROM (SELECT *, ln(exp(l1) + exp(l2)) AS t FROM l{i}))",
            f"m{i} AS MATERIALIZED (SELECT chr, w, sum(n * q) / sum(n) AS mean, sum(n * t) AS now FROM p{i} GROUP BY chr, w)",
            f"q{i} AS MATERIALIZED (SELECT id, CASE WHEN mean > 0.5 THEN q * (0.5 / mean) ELSE 1 - (1 - q) * (0.5 / (1 - mean)) END AS q FROM p{i} JOIN m{i} USING (chr, w))",
            f"n{i} AS MATERIALIZED (SELECT chr, w, site, (sum(n * q * (state = 'C')::INT) + 0.5e-10) / (sum(n * q) + 1e-10) AS b1, (sum(n * (1 - q) * (state = 'C')::INT) + 0.5e-10) / (sum(n * (1 - q)) + 1e-10) AS b2 FROM st JOIN q{i} USING (id) GROUP BY ALL)",
            f"a{i + 1} AS MATERIALIZED (SELECT chr, w, site, CASE WHEN going THEN b1 ELSE a1 END AS a1, CASE WHEN going THEN b2 ELSE a2 END AS a2 FROM a{i} JOIN n{i} USING (chr, w, site) JOIN k{i} USING (chr, w))",
            f"k{i + 1} AS MATERIALIZED (SELECT chr, w, CASE WHEN going AND NOT (score - now) / score < 1e-20 THEN now ELSE score END AS score, going AND NOT (score - now) / score < 1e-20 AS going FROM k{i} JOIN m{i} USING (chr, w))",
        ]
    last = f"a{rounds}"
    steps += [
        f"mix AS MATERIALIZED (SELECT c.chr, c.w, c.id, any_value(c.n) AS n, ln(0.5 * exp(coalesce(sum({yes('a1')}), 0)) + 0.5 * exp(coalesce(sum({yes('a2')}), 0))) AS l FROM c JOIN win USING (chr, w) LEFT JOIN st ON st.id = c.id LEFT JOIN {last} a ON a.chr = st.chr AND a.w = st.w AND a.site = st.site GROUP BY c.chr, c.w, c.id)",
        "pair AS MATERIALIZED (SELECT chr, w, sum(n * l) AS ll FROM mix GROUP BY chr, w)",
        "fits AS MATERIALIZED (SELECT chr, w, n_reads, n_cpgs, coalesce(single.ll, 0) AS single_ll, pair.ll AS pair_ll FROM win JOIN pair USING (chr, w) LEFT JOIN single USING (chr, w))",
    ]
    return ",\n".join(steps)


#: P(X > x) of chi-square with n_cpgs degrees of freedom, by the series of the incomplete gamma function.
TEST_SQL = """scored AS MATERIALIZED (SELECT *, CASE WHEN h <= 0 THEN 1.0 ELSE 1 - least(1, list_sum(list_transform(range(0, 2000), lambda k: exp((n_cpgs / 2.0 + k) * ln(h) - h - lgamma(n_cpgs / 2.0 + k + 1))))) END AS score
FROM (SELECT *, pair_ll - single_ll AS h FROM fits))"""


@query(f"WITH {clipped_sql()}, {models_sql()}, {TEST_SQL} SELECT chr, w, n_reads, CAST(n_cpgs AS INTEGER) AS n_cpgs, round(single_ll, 4) AS single_ll, round(pair_ll, 4) AS pair_ll, round(score, 6) AS score FROM scored")
def allele_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models and the test in every covered window."""
    found = epialleles.with_scores(epialleles.window_fits(windows.with_runs(reads(spark, sf_dir))))
    return found.select("chr", "w", "n_reads", "n_cpgs", F.round("single_ll", 4).alias("single_ll"), F.round("pair_ll", 4).alias("pair_ll"), F.round("score", 6).alias("score"))


@query(f"WITH {clipped_sql(15)}, {models_sql()} SELECT chr, w, n_reads, CAST(n_cpgs AS INTEGER) AS n_cpgs, round((2 * n_cpgs * ln(n_reads) - 2 * pair_ll) - (n_cpgs * ln(n_reads) - 2 * single_ll), 4) AS score FROM fits")
def allele_scan_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = epialleles.with_scores(epialleles.window_fits(windows.with_runs(reads(spark, sf_dir)), width=15), bic=True)
    return found.select("chr", "w", "n_reads", "n_cpgs", F.round("score", 4).alias("score"))


HITS_SQL = """hit AS MATERIALIZED (SELECT chr AS chrom, w AS s, w + 9 AS e, 'AMR' || (row_number() OVER (ORDER BY chr, w) - 1) || ':' || n_reads AS name, CAST(score AS FLOAT) AS score FROM scored WHERE score < 0.01)"""


def _islands_sql(source: str, gap: int, name: str) -> str:
    """Groups of intervals no more than gap apart: the first one's name, the least score."""
    window = "OVER (PARTITION BY chrom ORDER BY s, e, name"
    return f"""{name}_new AS (SELECT *, CASE WHEN max(e) {window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} >= s THEN 0 ELSE 1 END AS f FROM {source}),
{name}_of AS (SELECT *, sum(f) {window} ROWS UNBOUNDED PRECEDING) AS i FROM {name}_new),
{name} AS MATERIALIZED (SELECT chrom, min(s) AS s, max(e) AS e, first(name ORDER BY s, e, name) AS name, min(score) AS score FROM {name}_of GROUP BY chrom, i)"""


REGIONS_SQL = f"{HITS_SQL}, {_islands_sql('hit', 1, 'joined')}, {_islands_sql('joined', 4, 'merged')}"


def _shown(found: DataFrame) -> DataFrame:
    return found.select("chrom", "start", "end", "name", F.round(F.col("score").cast("double"), 6).alias("score"), "strand")


def regions_sql(cutoff: str, hits: str = REGIONS_SQL) -> str:
    return f"WITH {clipped_sql()}, {models_sql()}, {TEST_SQL}, {hits} SELECT chrom, s AS \"start\", e AS \"end\", name, round(CAST(score AS DOUBLE), 6) AS score, '+' AS strand FROM merged WHERE CAST(score AS DOUBLE) < {cutoff} AND e - s >= 2"


#: The cutoff of the false discovery rate of the hits among all tests: the least p-value after which the next is too large.
FDR_SQL = "(SELECT coalesce(min(p), 1e308) FROM (SELECT p, row_number() OVER (ORDER BY p) AS i, lead(p) OVER (ORDER BY p) AS q FROM (SELECT CAST(score AS DOUBLE) AS p FROM hit)) WHERE q IS NULL OR q >= 0.01 * i / (SELECT count(*) FROM scored))"


@query(regions_sql(FDR_SQL))
def allele_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: reads to regions, in CpG numbers, with the cutoff of the false discovery rate."""
    return _shown(scan.regions(spark, reads(spark, sf_dir), scan.Options(gap=4)))


ADJUSTED_SQL = HITS_SQL.replace("hit AS", "raw AS") + """, hit AS MATERIALIZED (SELECT chrom, s, e, name, CAST(max(p * ((SELECT count(*) FROM scored) / k)) OVER (ORDER BY p) AS FLOAT) AS score
FROM (SELECT *, CAST(score AS DOUBLE) AS p, CAST(count(*) OVER (ORDER BY score) AS DOUBLE) AS k FROM raw))"""


@query(regions_sql("0.01", REGIONS_SQL.replace(HITS_SQL, ADJUSTED_SQL)))
def allele_regions_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with adjusted p-values as scores, in place of the cutoff."""
    return _shown(scan.regions(spark, reads(spark, sf_dir), scan.Options(gap=4, adjust=True)))


@query(f"WITH {clipped_sql()}, {models_sql()}, {TEST_SQL} SELECT (SELECT count(*) FROM reads) AS reads, (SELECT count(DISTINCT chr) FROM reads) AS runs, count(*) AS windows_tested, CAST(sum(n_reads) AS BIGINT) AS total_cost, count(*) FILTER (WHERE score < 0.01) AS windows_accepted FROM scored")
def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.stats(reads(spark, sf_dir))


@query(
    f"""WITH {clipped_sql()}, {models_sql()}, b AS (SELECT chr, w, max(abs(a1 - a2)) AS far, avg(a1) AS mean FROM a10 JOIN win USING (chr, w) GROUP BY chr, w),
r AS (SELECT chr, w, sum(n * q) AS q FROM (SELECT mix.chr, mix.w, mix.n, 0.5 * exp(coalesce(sum(CASE state WHEN 'C' THEN ln(a1) ELSE ln(1 - a1) END), 0)) / exp(any_value(l)) AS q FROM mix LEFT JOIN st USING (id) LEFT JOIN a10 a ON a.chr = st.chr AND a.w = st.w AND a.site = st.site GROUP BY mix.chr, mix.w, mix.id, mix.n) GROUP BY chr, w)
SELECT chr, w, round(far, 4) AS far, round(q / n_reads, 4) AS first_share FROM b JOIN r USING (chr, w) JOIN win USING (chr, w)"""
)
def resolved_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart the two alleles of each window are, and the share of its reads in the first."""
    found = epialleles.window_fits(windows.with_runs(reads(spark, sf_dir)), alleles=True)
    seen = F.array_distinct(F.flatten(F.transform("reads", lambda r: F.filter(F.transform(F.split(r["seq"], ""), lambda c, i: F.when(c.isin("C", "T"), r["pos"] + i - F.col("site"))), lambda x: x.isNotNull()))))
    apart = F.array_max(F.transform(seen, lambda i: F.abs(F.get("first", i.cast("int")) - F.get("second", i.cast("int")))))
    share = F.aggregate("reads", F.lit(0.0), lambda a, r: a + r["copies"] * r["share"]) / F.col("n_reads")
    return found.where(apart.isNotNull()).select("chr", "w", F.round(apart, 4).alias("far"), F.round(share, 4).alias("first_share"))


@query()
def fit_iterative(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, lines = table(spark, sf_dir, "events"), table(spark, sf_dir, "lineitem")
    shares = lines.select((F.col("l_quantity") / 51).alias("x"))
    found = {"gamma": distributions.fit(events, "gamma", "value"), "beta": distributions.fit(shares, "beta", "x"), "nbd": distributions.fit(lines, "nbd", "l_quantity")}
    rows = [(k, float(a), float(b)) for k, (a, b) in found.items()]
    return spark.createDataFrame(rows, "family string, first double, second double")


@query(
    f"""WITH {L_SQL}, {O_SQL}, u AS (SELECT chrom, s, e, 0 AS side, id, NULL AS b FROM o UNION ALL SELECT chrom, s, e, 1, NULL, struct_pack(s := s, e := e, name := name, score := score) FROM l),
v AS (SELECT *, last_value(b IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY s, e, side, b.name, b.score, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
first_value(b IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY s, e, side, b.name, b.score, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM u),
g AS (SELECT *, CASE WHEN s < p.e AND p.s < e THEN 0 ELSE greatest(p.s - e, s - p.e) + 1 END AS dp, CASE WHEN s < q.e AND q.s < e THEN 0 ELSE greatest(q.s - e, s - q.e) + 1 END AS dq FROM v WHERE side = 0),
n AS (SELECT *, CASE WHEN p IS NULL THEN q WHEN q IS NULL OR dp <= dq THEN p ELSE q END AS b2 FROM g)
SELECT chrom, s AS "start", e AS "end", id, b2.s AS near_start, b2.e AS near_end, b2.name AS near_name, round(CAST(b2.score AS DOUBLE), 4) AS near_score FROM n"""
)
def nearest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.nearest(order_regions(spark, sf_dir), line_regions(spark, sf_dir), block=64)
    return found.select("chrom", "start", "end", "id", "near_start", "near_end", "near_name", F.round(F.col("near_score").cast("double"), 4).alias("near_score"))


@query(
    f"""WITH {SERIES_SQL}, p AS (SELECT a.key AS key, a.x AS x, b.y AS y, b.x - a.x AS d, 0.75 * (1 - pow((b.x - a.x) / 48.0, 2)) AS w FROM (SELECT DISTINCT key, x FROM e) a JOIN e b ON a.key = b.key AND b.x - a.x >= -48 AND b.x - a.x < 48),
t AS (SELECT key, x, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1 FROM p GROUP BY key, x)
SELECT key, round(x, 4) AS x, round(CASE WHEN abs(s0 * s2 - s1 * s1) > 1e-12 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END, 5) AS y FROM t"""
)
def local_linear_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.local_linear(series(spark, sf_dir), 48.0).select("key", F.round("x", 4).alias("x"), F.round("y", 5).alias("y"))


@query(
    f"""WITH {SERIES_SQL}, r AS (SELECT key, x, y, row_number() OVER (PARTITION BY key ORDER BY x, y) - 1 AS i FROM e)
SELECT a.key AS key, round(a.x, 4) AS x, round(sum(0.75 * (1 - pow((b.i - a.i) / 4.0, 2)) * b.y) / sum(0.75 * (1 - pow((b.i - a.i) / 4.0, 2))), 6) AS y FROM r a JOIN r b ON a.key = b.key AND b.i >= a.i - 4 AND b.i < a.i + 4 GROUP BY a.key, a.x, a.i"""
)
def kernel_smoothing_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return smoothing.kernel_smooth_by_rank(series(spark, sf_dir), 4.0).select("key", F.round("x", 4).alias("x"), F.round("y", 6).alias("y"))


def sweep_sql(first: str, second: str) -> str:
    """t: the steps (chrom, i, j) of a pass over l and o, each sorted by start, that drops l's region if it is less by (first, second)."""
    return f"""WITH RECURSIVE {L_SQL}, {O_SQL}, a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY s, e, name) AS i FROM l), b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY s, e, id) AS j FROM o),
t AS (SELECT chrom, 1::BIGINT AS i, 1::BIGINT AS j FROM (SELECT DISTINCT chrom FROM a) SEMI JOIN b USING (chrom)
UNION ALL SELECT t.chrom, t.i + k, t.j + 1 - k FROM (SELECT t.chrom, t.i, t.j, CASE WHEN a.{first} < b.{first} OR a.{first} = b.{first} AND a.{second} < b.{second} THEN 1 ELSE 0 END AS k FROM t JOIN a ON a.chrom = t.chrom AND a.i = t.i JOIN b ON b.chrom = t.chrom AND b.j = t.j) t),
met AS (SELECT a.chrom AS chrom, a.s AS s1, a.e AS e1, b.s AS s2, b.e AS e2, b.id AS id FROM t JOIN a ON a.chrom = t.chrom AND a.i = t.i JOIN b ON b.chrom = t.chrom AND b.j = t.j WHERE a.s < b.e AND b.s < a.e)"""


@query(sweep_sql("s", "e") + ' SELECT chrom, s2 AS "start", e2 AS "end", id FROM met')
def sweep_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one pass over two sorted lists with nested regions tells."""
    return intervals.sweep_intersection(line_regions(spark, sf_dir), order_regions(spark, sf_dir), (("name",), ("id",)), 64)


@query(sweep_sql("e", "s") + ' SELECT chrom, greatest(s1, s2) AS "start", least(e1, e2) AS "end" FROM met')
def sweep_by_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sweep_by_base(line_regions(spark, sf_dir), order_regions(spark, sf_dir), (("name",), ("id",)), 64)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.floor(F.col("value") / 50)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("segment"), F.col("event_id").alias("i"), m.cast("double").alias("m"), F.greatest(10 - m, F.lit(0)).cast("double").alias("u"))


TWO = hmm.two_states(0.1, 0.1, (0.8, 2.0), (2.0, 0.8))
THREE = hmm.three_states(((0.8, 0.12, 0.08), (0.11, 0.8, 0.09), (0.1, 0.07, 0.83)), (0.5, 3.1), (2.9, 0.6), (2.0, 2.3))


def emissions_sql(model: hmm.Model) -> str:
    """ob: segment, i, r (from 1), last and the log-likelihood of each state (e0, e1, ...)."""
    ways = "lgamma(m + u + 1) - lgamma(m + 1) - lgamma(u + 1)"
    each = ", ".join(
        f"CASE WHEN m + u > 0 THEN {ways} + lgamma({a!r} + m) + lgamma({b!r} + u) - lgamma({a + b!r} + m + u) - (lgamma({a!r}) + lgamma({b!r}) - lgamma({a + b!r})) ELSE 0 END AS e{k}" for k, (a, b) in enumerate(model.shapes)
    )
    return f"""ob AS MATERIALIZED (SELECT segment, i, row_number() OVER (PARTITION BY segment ORDER BY i) AS r, count(*) OVER (PARTITION BY segment) AS last, {each}
FROM (SELECT user_id AS segment, event_id AS i, CAST(floor(value / 50) AS DOUBLE) AS m, CAST(greatest(10 - floor(value / 50), 0) AS DOUBLE) AS u FROM events))"""


def _log_sum(terms: list[str]) -> str:
    top = f"greatest({', '.join(terms)})"
    return f"({top} + ln({' + '.join(f'exp({t} - {top})' for t in terms)}))"


def forward_sql(model: hmm.Model, observed: str | None = None) -> str:
    """fb: the observations with forward (f0, ...) and backward (b0, ...) values and the total of each segment."""
    n, t = range(len(model.names)), model.transitions
    stop = model.end or (1.0,) * len(model.names)
    start = ", ".join(f"ln({model.start[j]!r}) + e{j} AS f{j}" for j in n)
    step = ", ".join(f"{_log_sum([f'f{i} + ln({t[i][j]!r})' for i in n])} + ob.e{j}" for j in n)
    back = ", ".join(_log_sum([f"ln({t[i][j]!r}) + b.b{j} + b.e{j}" for j in n]) for i in n)
    ends = ", ".join(f"ln({stop[j]!r}) AS b{j}" for j in n)
    own = ", ".join(f"ob.e{j}" for j in n)
    return f"""{observed or emissions_sql(model)},
f AS (SELECT segment, r, {start} FROM ob WHERE r = 1 UNION ALL SELECT ob.segment, ob.r, {step} FROM f JOIN ob ON ob.segment = f.segment AND ob.r = f.r + 1),
b AS (SELECT segment, r, {', '.join(f'e{j}' for j in n)}, {ends} FROM ob WHERE r = last UNION ALL SELECT ob.segment, ob.r, {own}, {back} FROM b JOIN ob ON ob.segment = b.segment AND ob.r = b.r - 1),
tot AS (SELECT segment, {_log_sum([f'f{j} + b{j}' for j in n])} AS total FROM f JOIN b USING (segment, r) WHERE r = 1),
fb AS MATERIALIZED (SELECT ob.*, {', '.join(f'f{j}' for j in n)}, {', '.join(f'b{j}' for j in n)}, total FROM ob JOIN f USING (segment, r) JOIN b USING (segment, r) JOIN tot USING (segment))"""


@query(f"WITH RECURSIVE {forward_sql(TWO)} SELECT segment, i, CASE WHEN f0 + b0 > f1 + b1 THEN 'foreground' ELSE 'background' END AS state, round(exp(f0 + b0 - total) / (exp(f0 + b0 - total) + exp(f1 + b1 - total)), 6) AS p FROM fb")
def hmm_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.decode(observations(spark, sf_dir), TWO).select("segment", "i", "state", F.round(F.get("p", F.lit(0)), 6).alias("p"))


@query(f"WITH RECURSIVE {forward_sql(TWO)} SELECT segment, round(total, 5) AS log_likelihood FROM tot")
def hmm_segment_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.log_likelihood(observations(spark, sf_dir), TWO).select("segment", F.round("log_likelihood", 5).alias("log_likelihood"))


@query(f"WITH RECURSIVE {forward_sql(TWO)} SELECT y.segment AS segment, y.i AS i, round(CASE WHEN x.r IS NULL THEN 0 ELSE exp(x.f0 + ln({TWO.transitions[0][1]!r}) + y.e1 + y.b1 - y.total) END, 6) AS p FROM fb y LEFT JOIN fb x ON x.segment = y.segment AND x.r = y.r - 1")
def hmm_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.transition_posteriors(observations(spark, sf_dir), TWO, "foreground", "background").select("segment", "i", F.round("p", 6).alias("p"))


@query(f"WITH {emissions_sql(TWO)} SELECT segment, i, round(sum(e0) OVER (PARTITION BY segment ORDER BY r), 5) AS foreground, round(sum(e1) OVER (PARTITION BY segment ORDER BY r), 5) AS background FROM ob")
def hmm_prefix_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.prefix_likelihood(observations(spark, sf_dir), TWO).select("segment", "i", F.round("foreground", 5).alias("foreground"), F.round("background", 5).alias("background"))


def viterbi_sql(model: hmm.Model) -> str:
    """path: the likeliest state of each observation; of equal ones the later state."""
    n, t = range(len(model.names)), model.transitions
    best = lambda j: f"greatest({', '.join(f'v{i} + ln({t[i][j]!r})' for i in n)})"
    pick = lambda terms, top: "CASE " + " ".join(f"WHEN {x} = {top} THEN {k}" for k, x in reversed(list(enumerate(terms)))) + " END"
    start = ", ".join(f"ln({model.start[j]!r}) + e{j} AS v{j}" for j in n)
    scores = ", ".join(f"{best(j)} + ob.e{j}" for j in n)
    froms = ", ".join(pick([f"v{i} + ln({t[i][j]!r})" for i in n], best(j)) for j in n)
    ends = pick([f"v{j}" for j in n], f"greatest({', '.join(f'v{j}' for j in n)})")
    return f"""{emissions_sql(model)},
v AS (SELECT segment, r, {start}, {', '.join(f'-1 AS w{j}' for j in n)} FROM ob WHERE r = 1 UNION ALL SELECT ob.segment, ob.r, {scores}, {froms} FROM v JOIN ob ON ob.segment = v.segment AND ob.r = v.r + 1),
path AS (SELECT v.segment, v.r, {ends} AS k FROM v JOIN ob USING (segment, r) WHERE r = last
UNION ALL SELECT x.segment, x.r - 1, CASE k {' '.join(f'WHEN {j} THEN w{j}' for j in n)} END FROM path x JOIN v ON v.segment = x.segment AND v.r = x.r WHERE x.r > 1)"""


@query(f"WITH RECURSIVE {viterbi_sql(THREE)} SELECT segment, i, CASE k WHEN 0 THEN 'hypo' WHEN 1 THEN 'HYPER' ELSE 'HYPO' END AS state FROM path JOIN ob USING (segment, r)")
def hmm_viterbi_three_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.decode(observations(spark, sf_dir), THREE, "viterbi").select("segment", "i", "state")


@query(f"WITH RECURSIVE {viterbi_sql(TWO)} SELECT segment, i, CASE k WHEN 0 THEN 'foreground' ELSE 'background' END AS state FROM path JOIN ob USING (segment, r)")
def hmm_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.decode(observations(spark, sf_dir), TWO, "viterbi").select("segment", "i", "state")


#: A replicate of counts, one of shares and another of counts, each with shapes of its own.
REPLICATES = replace(TWO, replicates=(("betabin", ((0.8, 2.0), (2.0, 0.8))), ("beta", ((1.2, 3.0), (2.5, 1.1))), ("betabin", ((0.5, 4.0), (3.0, 0.7)))))


def replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and an hour of the day as replicates of a place, of which any may be missing or come again."""
    m = F.floor(F.col("value") / 50) % 10
    share = F.col("replicate") == 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("segment"), F.hour("ts").cast("bigint").alias("i"), (F.col("event_id") % 3).alias("replicate"), m.cast("double").alias("m"))
    return rows.select("segment", "i", "replicate", F.when(share, F.col("m") + 0.5).otherwise(F.col("m")).alias("m"), F.when(share, 10.0).otherwise(10 - F.col("m")).alias("u"))


def replicates_sql(model: hmm.Model) -> str:
    """ob as of emissions_sql(), from the events of replicated()."""
    each = []
    for k in range(len(model.names)):
        terms = []
        for r, (family, shapes) in enumerate(model.replicates):
            a, b = shapes[k]
            norm = f"(lgamma({a!r}) + lgamma({b!r}) - lgamma({a + b!r}))"
            counts = f"lgamma(11) - lgamma(m + 1) - lgamma(11 - m) + lgamma({a!r} + m) + lgamma({b!r} + 10 - m) - lgamma({a + b!r} + 10) - {norm}"
            shares = f"({a!r} - 1) * ln((m + 0.5) / 10) + ({b!r} - 1) * ln(1 - (m + 0.5) / 10) - {norm}"
            terms.append(f"WHEN {r} THEN {shares if family == 'beta' else counts}")
        each.append(f"sum(CASE replicate {' '.join(terms)} END) AS e{k}")
    return f"""ob AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY i) AS r, count(*) OVER (PARTITION BY segment) AS last
FROM (SELECT segment, i, {', '.join(each)} FROM (SELECT user_id AS segment, hour(ts) AS i, event_id % 3 AS replicate, CAST(floor(value / 50) % 10 AS DOUBLE) AS m FROM events) GROUP BY segment, i))"""


@query(f"WITH RECURSIVE {forward_sql(TWO, replicates_sql(REPLICATES))} SELECT segment, i, CASE WHEN f0 + b0 > f1 + b1 THEN 'foreground' ELSE 'background' END AS state, round(exp(f0 + b0 - total) / (exp(f0 + b0 - total) + exp(f1 + b1 - total)), 6) AS p FROM fb")
def hmm_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates with families and shapes of their own, any of them missing at a place."""
    return hmm.decode(replicated(spark, sf_dir), REPLICATES).select("segment", "i", "state", F.round(F.get("p", F.lit(0)), 6).alias("p"))


@query()
def hmm_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, history = hmm.train(observations(spark, sf_dir), TWO)
    rows = [(n, *map(float, s), float(history[-1])) for n, s in zip(model.names, model.shapes, strict=True)]
    return spark.createDataFrame(rows, "state string, alpha double, beta double, log_likelihood double")


@query(
    """WITH s AS (SELECT DISTINCT CAST(l_suppkey % 10 AS VARCHAR) AS chrom, l_partkey AS pos FROM lineitem), f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) < 3 THEN NULL ELSE pos END AS b FROM s)
SELECT chrom, pos, chrom || ':' || last_value(b IGNORE NULLS) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS segment FROM f"""
)
def site_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("string").alias("chrom"), F.col("l_partkey").alias("pos")).distinct()
    return hmm.with_segments(rows, 3, 256)
