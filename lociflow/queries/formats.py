"""Round trips of file formats, functions of text, bases, qualities and alignments, region relations and distributions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna, quality, sam, sql, text
from ..operators import cpgs, distributions, intervals, levels
from ..checkpoints import shared_folder
from ..sources import bam, fasta, indexed_fasta, regions
from .base import L_SQL, Q_SQL, line_regions, query, sequences, table

LETTERS_SQL = "t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS s FROM documents)"


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and s, the ASCII letters of each text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("s"))


@query(f"WITH {LETTERS_SQL} SELECT CAST(doc_id AS VARCHAR) AS name, s AS seq, upper(s) AS qual FROM t")
def fastq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(F.concat(F.lit("@"), F.col("doc_id").cast("string")), F.col("s"), F.lit("+"), F.upper("s"))
    rows = letters(spark, sf_dir).select("doc_id", F.posexplode(lines).alias("i", "line"))
    return fasta.parse_fastq(rows.select((F.col("doc_id") * 4 + F.col("i")).alias("line_no"), "line"))


@query(
    r"""SELECT doc_id, regexp_full_match(t, '[!-\]]*') AS phred, regexp_full_match(t, '[;-h]*') AS solexa FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^!-~]', '', 'g') AS t FROM documents)"""
)
def quality_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[^!-~]", "")
    return table(spark, sf_dir, "documents").select("doc_id", quality.valid_quality(t).alias("phred"), quality.valid_quality(t, "solexa").alias("solexa"))


ERRORS_SQL = "e AS (SELECT DISTINCT l_quantity / 60 AS e FROM lineitem)"


@query(
    f"""WITH {ERRORS_SQL}, s AS (SELECT e, -10 * log10(e) AS p, -10 * log10(e / (1 - e)) AS x FROM e),
c AS (SELECT e, chr(CAST(least(60, round(p)) AS INTEGER) + 33) AS c, chr(CAST(least(40, round(x)) AS INTEGER) + 64) AS d FROM s)
SELECT round(e, 6) AS error, c AS phred, d AS solexa, round(pow(10, -(ascii(c) - 33) / 10.0), 6) AS phred_error, round(1 - pow(10, -(ascii(c) - 33) / 10.0), 6) AS phred_right,
round(pow(10, -(ascii(d) - 64) / 10.0) / (1 + pow(10, -(ascii(d) - 64) / 10.0)), 6) AS solexa_error,
round(-10 * log10(pow(10, -(ascii(d) - 64) / 10.0) / (1 + pow(10, -(ascii(d) - 64) / 10.0))), 6) AS as_phred FROM c"""
)
def quality_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 60).alias("e")).distinct()
    rows = rows.select("e", quality.error_to_char(e).alias("c"), quality.probability_to_char(1 - e).alias("c2"), quality.error_to_char(e, "solexa").alias("d"))
    return rows.select(
        F.round(e, 6).alias("error"), F.when(F.col("c") == F.col("c2"), F.col("c")).alias("phred"), F.col("d").alias("solexa"), F.round(quality.char_to_error(F.col("c")), 6).alias("phred_error"),
        F.round(quality.char_to_probability(F.col("c")), 6).alias("phred_right"), F.round(quality.char_to_error(F.col("d"), "solexa"), 6).alias("solexa_error"),
        F.round(quality.solexa_to_phred(quality.char_to_score(F.col("d"), "solexa").cast("double")), 6).alias("as_phred"),
    )


ALIGNED_SQL = """a AS (SELECT 'r' || l_orderkey || '.' || l_linenumber AS qname, CAST(l_suppkey % 4096 AS INTEGER) AS flags, 'chr' || l_suppkey AS rname, l_partkey + 1 AS pos, CAST(l_quantity AS INTEGER) AS mapq,
CAST(l_quantity AS INTEGER) || 'M' AS cigar, '=' AS rnext, l_partkey + 300 AS pnext, 300 AS tlen, repeat('ACGT', CAST(l_linenumber AS INTEGER)) AS seq, repeat('I!+5', CAST(l_linenumber AS INTEGER)) AS qual, 'NM:i:' || l_linenumber AS tag FROM lineitem)"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    long, n = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("r"), s("l_orderkey"), F.lit("."), s("l_linenumber")).alias("qname"), (F.col("l_suppkey") % 4096).cast("int").alias("flags"), F.concat(F.lit("chr"), s("l_suppkey")).alias("rname"),
        (F.col("l_partkey") + 1).alias("pos"), long.alias("mapq"), F.concat(long.cast("string"), F.lit("M")).alias("cigar"), F.lit("=").alias("rnext"), (F.col("l_partkey") + 300).alias("pnext"), F.lit(300).alias("tlen"),
        F.repeat(F.lit("ACGT"), n).alias("seq"), F.repeat(F.lit("I!+5"), n).alias("qual"), F.array(F.concat(F.lit("NM:i:"), s("l_linenumber")), F.lit("XX:Z:a b")).alias("tags"),
    )


@query(f"WITH {ALIGNED_SQL} SELECT qname, flags, rname, pos, CAST(mapq AS SMALLINT) AS mapq, cigar, rnext, pnext, tlen, seq, qual, tag || ',XX:Z:a b' AS tags FROM a")
def sam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = alignments(spark, sf_dir).select(regions.sam_line().alias("value"))
    return regions.parse_sam(lines.unionByName(spark.range(1).select(F.lit("@HD\tVN:1.0").alias("value")))).withColumn("tags", F.array_join("tags", ","))


@query(
    f"""WITH {Q_SQL}, p AS (SELECT name, seq, unnest(generate_series(1, length(seq) - 1)) AS i FROM q WHERE length(seq) > 1)
SELECT name AS chrom, row_number() OVER (PARTITION BY name ORDER BY i) - 1 AS ordinal, i - 1 AS position, name || ':' || (i - 1) || '-' || (i + 1) AS place FROM p WHERE substr(seq, i, 2) = 'CG'"""
)
def cpgs_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function of CpG sites, and a function, in SQL text."""
    sql.register(spark)
    return spark.sql("SELECT name AS chrom, ordinal, position, region_text(name, position, position + 2) AS place FROM {q} AS q, LATERAL cpgs(q.seq)", q=sequences(spark, sf_dir))


@query(
    f"""WITH {ALIGNED_SQL} SELECT qname, (flags & 16) <> 0 AS reverse, flags | 1024 AS marked, flags & ~4 AS mapped, mapq AS bases, '7S' || cigar AS "reversed", repeat('M', mapq) || 'SSSSSSS' AS letters, mapq + 7 AS query, round(ln(0.2) + tlen * ln(0.8), 6) AS geometric,
round(lgamma(pos), 4) AS log_gamma FROM a"""
)
def alignments_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of flags, CIGARs and distributions in SQL text."""
    sql.register(spark)
    text = """SELECT qname, has_flag(flags, 'reverse') AS reverse, set_flag(flags, 'duplicate') AS marked, unset_flag(flags, 'unmapped') AS mapped, cigar_reference_length(c) AS bases, cigar_reverse(c) AS reversed,
    cigar_letters(c) AS letters, cigar_query_length(c) AS query, round(geometric_log_likelihood(tlen, 0.2), 6) AS geometric, round(lgamma(CAST(pos AS DOUBLE)), 4) AS log_gamma FROM (SELECT *, concat(cigar, '7S') AS c FROM {a})"""
    return spark.sql(text, a=alignments(spark, sf_dir))


@query(f"WITH {ALIGNED_SQL} SELECT qname, flags, rname, pos, CAST(mapq AS SMALLINT) AS mapq, cigar, rnext, pnext, tlen, seq, qual, tag || ',XX:Z:a b' AS tags FROM a")
def bam_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written as BAM files below the checkpoint folder and read again in many splits."""
    rows = alignments(spark, sf_dir)
    names = rows.select("rname").distinct().orderBy("rname").collect()  # the references, as in any header
    folder = f"{shared_folder(spark)}/bam-{uuid.uuid4().hex}"
    bam.write_bam(rows.withColumn("mapq", F.col("mapq").cast("smallint")), folder, "@HD\tVN:1.6\n" + "\n".join(f"@SQ\tSN:{r.rname}\tLN:{1 << 29}" for r in names))
    return bam.read_bam(spark, folder, 1 << 20).withColumn("tags", F.array_join("tags", ","))


@query("SELECT unnest(['@HD' || chr(9) || 'VN:1.0', '@PG' || chr(9) || 'ID:scan' || chr(9) || 'CL:scan -w 10']) AS value UNION ALL SELECT '@SQ' || chr(9) || 'SN:' || n_name || chr(9) || 'LN:' || n_nationkey FROM nation")
def sam_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.sam_header(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("n")), "scan", "scan -w 10")


SITES_SQL = """i AS (SELECT 'chr' || l_suppkey AS chrom, l_partkey AS pos, CASE l_linenumber % 2 WHEN 0 THEN '+' ELSE '-' END AS strand, CASE l_linenumber % 3 WHEN 0 THEN 'CpG' WHEN 1 THEN 'CHHx' ELSE 'CpGx' END AS context,
round(l_discount * 10, 4) AS meth, CAST(l_quantity AS BIGINT) AS n_reads FROM lineitem)"""


def called_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.when(F.col("l_linenumber") % 3 == 0, "CpG").when(F.col("l_linenumber") % 3 == 1, "CHHx").otherwise("CpGx")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")).alias("chrom"), F.col("l_partkey").alias("pos"), F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"), context.alias("context"),
        F.round(F.col("l_discount") * 10, 4).alias("meth"), F.col("l_quantity").cast("bigint").alias("n_reads"),
    )


@query(f"WITH {SITES_SQL} SELECT * FROM i")
def site_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.parse_sites(called_sites(spark, sf_dir).select(regions.site_line().alias("value")))


@query(f"WITH {SITES_SQL} SELECT chrom, pos AS start, pos + 1 AS \"end\", CAST(round(meth * n_reads) AS BIGINT) AS m, n_reads - CAST(round(meth * n_reads) AS BIGINT) AS u, n_reads FROM i WHERE context = 'CpG' AND chrom = 'chr7' AND pos >= 10 AND pos < 900")
def cpg_site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.site_counts(regions.sites_between(regions.cpg_sites_of(called_sites(spark, sf_dir)), "chr7", 10, 900))


@query(f"WITH {SITES_SQL} SELECT chrom, pos, context LIKE '%x' AS mutated, rtrim(context, 'x') || 'x' AS marked, rtrim(context, 'x') AS plain, context LIKE 'CpG%' AS cpg, context LIKE 'CHH%' AS chh FROM i")
def site_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("context")
    return called_sites(spark, sf_dir).select("chrom", "pos", levels.is_mutated(c).alias("mutated"), levels.set_mutated(c).alias("marked"), levels.set_mutated(c, False).alias("plain"), levels.is_context(c, "CpG").alias("cpg"), levels.is_context(c, "CHH").alias("chh"))


@query(f"WITH {SITES_SQL} SELECT chrom, pos, strand, context, meth AS diffscore, n_reads AS meth_a, pos % 7 AS unmeth_a, pos % 5 AS meth_b, n_reads + 1 AS unmeth_b FROM i")
def methdiff_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = called_sites(spark, sf_dir).select("chrom", "pos", "strand", "context", F.col("meth").alias("diffscore"), F.col("n_reads").alias("meth_a"), (F.col("pos") % 7).alias("unmeth_a"), (F.col("pos") % 5).alias("meth_b"), (F.col("n_reads") + 1).alias("unmeth_b"))
    return regions.parse_methdiff(rows.select(regions.methdiff_line().alias("value")))


@query(f"WITH {ALIGNED_SQL} SELECT rname AS chrom, pos AS start, pos + length(seq) AS \"end\", qname AS name, CAST(mapq AS FLOAT) AS score, '+' AS strand, seq, qual AS scr FROM a")
def mapped_reads_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the lines without their end column, which the sequence's length makes up for."""
    rows = alignments(spark, sf_dir).select(F.col("rname").alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + F.length("seq")).alias("end"), F.col("qname").alias("name"), F.col("mapq").cast("float").alias("score"), F.lit("+").alias("strand"), "seq", F.col("qual").alias("scr"))
    short = F.concat_ws("\t", "chrom", "start", "name", "score", "strand", "seq", "scr")
    return regions.parse_mapped_reads(rows.select(F.when(F.col("start") % 2 == 0, regions.mapped_read_line()).otherwise(short).alias("value")))


@query(
    f"""WITH {SITES_SQL}, k AS (SELECT context, n_reads > 0 AND context NOT LIKE '%x' AS ok, n_reads, CAST(round(meth * n_reads) AS BIGINT) AS m FROM i)
SELECT context, count(*) AS total_sites, count(*) FILTER (WHERE ok) AS sites_covered, CAST(coalesce(sum(m) FILTER (WHERE ok), 0) AS BIGINT) AS total_c, CAST(coalesce(sum(n_reads - m) FILTER (WHERE ok), 0) AS BIGINT) AS total_t,
coalesce(max(n_reads) FILTER (WHERE ok), 0) AS max_depth, count(*) FILTER (WHERE context LIKE '%x') AS mutations FROM k GROUP BY context"""
)
def level_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = levels.levels(called_sites(spark, sf_dir)).select("context", regions.parse_levels(regions.level_lines()).alias("m"))
    return found.select("context", *[F.col("m")[n].cast("bigint").alias(n) for n in ("total_sites", "sites_covered", "total_c", "total_t", "max_depth", "mutations")])


CIGAR_SQL = "c AS (SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS a, CAST(l_quantity AS INTEGER) AS b FROM lineitem)"


@query(
    f"""WITH {CIGAR_SQL} SELECT a || 'S' || b || 'M' || a || 'I' || b || 'D' || b || 'M' || a || 'S' AS cigar, a || 'M' || b || 'M' || a || 'I' || b || 'D' || b || 'M' || a || 'M' AS as_match,
a || 'M' || b || 'M' || a || 'I' || b || 'D' || b || 'M' || a || 'S' AS initial, a || 'S' || b || 'M' || a || 'I' || b || 'D' || b || 'M' || a || 'S' AS internal, (a + b) || 'M' || a || 'I' || b || 'D' || (a + b) || 'M' AS merged,
a || 'S' || b || 'M' || a || 'I' || b || 'D' || b || 'M' || a || 'S' AS packed, repeat('C', b) || repeat('N', b) || repeat('T', b) AS placed, 2 * a AS clipped FROM c"""
)
def cigar_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = lambda c: F.col(c).cast("string"), lambda base, c: F.repeat(F.lit(base), F.col(c))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("a"), F.col("l_quantity").cast("int").alias("b")).distinct()
    c = F.col("cigar")
    rows = rows.select(
        F.concat(s("a"), F.lit("S"), s("b"), F.lit("M"), s("a"), F.lit("I"), s("b"), F.lit("D"), s("b"), F.lit("M"), s("a"), F.lit("S")).alias("cigar"), F.concat(n("A", "a"), n("C", "b"), n("G", "a"), n("T", "b"), n("A", "a")).alias("seq")
    )
    whole = sam.soft_to_match(c)
    return rows.select("cigar", whole.alias("as_match"), sam.soft_to_match(c, "initial").alias("initial"), sam.soft_to_match(c, "internal").alias("internal"), sam.merge_equal(whole).alias("merged"), sam.compress(sam.expand(c)).alias("packed"), sam.on_reference(c, F.col("seq")).alias("placed"), sam.soft_clip(c).alias("clipped"))


@query("SELECT f AS flags, (f & 4096) <> 0 AS a_rich, CAST(f | 4096 AS INTEGER) AS marked FROM (SELECT DISTINCT CAST(l_partkey * 7 % 8192 AS INTEGER) AS f FROM lineitem)")
def a_rich_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("flags")
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 7 % 8192).cast("int").alias("flags")).distinct().select(f, sam.has_flag(f, "a_rich").alias("a_rich"), sam.set_flag(f, "a_rich").alias("marked"))


C_SQL = "c AS (SELECT DISTINCT CAST(32 + l_partkey % 95 AS INTEGER) AS n, chr(CAST(32 + l_partkey % 95 AS INTEGER)) AS c FROM lineitem)"


@query(
    f"""WITH {C_SQL}, u AS (SELECT n, c, upper(c) AS u FROM c), b AS (SELECT n, c, CASE u WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS b FROM u)
SELECT n, b AS base, CASE b WHEN 1 THEN 3 ELSE b END AS bisulfite, CASE b WHEN 2 THEN 0 ELSE b END AS a_rich, CASE WHEN b < 4 THEN 3 - b ELSE 4 END AS reverse, CASE b WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' WHEN 3 THEN 'T' ELSE 'N' END AS letter,
CASE b WHEN 0 THEN 'T' WHEN 1 THEN 'G' WHEN 2 THEN 'C' WHEN 3 THEN 'A' ELSE 'N' END AS paired, b < 4 AS valid, b = 2 AS guanine, c <> '>' AS sequence,
CASE WHEN b < 4 THEN CASE WHEN c = upper(c) THEN substr('TGCA', b + 1, 1) ELSE substr('tgca', b + 1, 1) END WHEN n BETWEEN 97 AND 116 THEN 'n' ELSE 'N' END AS complement FROM b"""
)
def base_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((32 + F.col("l_partkey") % 95).cast("int").alias("n")).distinct().select("n", F.char("n").alias("c"))
    c = F.col("c")
    number = lambda **how: dna.base_number(c, **how)
    return rows.select(
        "n", number().alias("base"), number(bisulfite=True).alias("bisulfite"), number(a_rich=True).alias("a_rich"), number(reverse=True).alias("reverse"), dna.number_base(number()).alias("letter"),
        dna.number_base(number(), reverse=True).alias("paired"), dna.valid_base(c).alias("valid"), dna.is_base(c, "G").alias("guanine"), dna.is_sequence_line(c).alias("sequence"), dna.complement(c).alias("complement"),
    )


@query(f"WITH {Q_SQL} SELECT name, length(seq) AS n, (length(seq) - length(replace(seq, 'CG', ''))) // 2 AS cpgs, reverse(translate(seq, 'ACGT', 'TGCA')) AS back FROM q")
def sequence_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CpG sites by the place predicate, and the sequence by way of its matrix of weights, from complements."""
    bases = F.col("bases")
    rows = sequences(spark, sf_dir).select("name", F.explode_outer(F.array("seq")).alias("bases"))  # so that the bases are worked out once
    return rows.select("name", F.length(bases).cast("bigint").alias("n"), dna.cpg_count(bases).alias("cpgs"), dna.reverse_by_weights(bases).alias("back"))


WEIGHTS_SQL = "w AS (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS a, CAST(l_linenumber AS INTEGER) AS b FROM lineitem)"


@query(
    f"""WITH {WEIGHTS_SQL}, s AS (SELECT a, b, a / 60.0 AS x, b / 80.0 AS y, 1 - a / 60.0 - b / 80.0 AS z FROM w)
SELECT a, b, CASE WHEN x > 0.5 THEN 'A' WHEN z > 0.5 THEN 'T' ELSE 'N' END AS called, CASE WHEN x >= greatest(y, z) THEN 'A' WHEN y >= z THEN 'C' ELSE 'T' END AS best,
round(10 * (ln((x + 0.001) / 1.004) - ln(1 - (x + 0.001) / 1.004)) / ln(10), 5) AS score FROM s"""
)
def base_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("a"), F.col("l_linenumber").cast("int").alias("b")).distinct()
    x, y = F.col("a") / 60.0, F.col("b") / 80.0
    m = F.array(F.array(x, y, F.lit(0.0), 1 - x - y))
    return rows.select("a", "b", dna.call_bases(m).alias("called"), dna.best_bases(m).alias("best"), F.round(dna.solexa_scores(m)[0][0], 5).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, right(lpad(bin(l_partkey & 204), 64, '0'), 8) AS bits, CAST(floor(100 * l_linenumber / l_quantity) AS BIGINT) AS share FROM lineitem")
def bits_and_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", dna.bits_text(F.col("l_partkey"), 204, 8).alias("bits"), dna.percent(F.col("l_linenumber"), F.col("l_quantity")).alias("share"))


T_SQL = "t AS (SELECT p_partkey, '  ' || p_name || ' ;' || p_type || ',,' || p_brand || ' ' AS s FROM part)"


@query(
    rf"""WITH {T_SQL} SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(s, '[,;]'), lambda x: x <> ''), '|') AS parts, array_to_string(regexp_split_to_array(s, '[,;]'), '|') AS every, trim(s) AS stripped,
array_to_string(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> ''), '|') AS words, array_to_string(list_filter(regexp_split_to_array(s, ','), lambda x: x <> ''), '|') AS squashed FROM t"""
)
def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ;"), "p_type", F.lit(",,"), "p_brand", F.lit(" ")).alias("s"))
    join = lambda a: F.array_join(a, "|")
    return rows.select("p_partkey", join(text.split_any(s, ",;")).alias("parts"), join(text.split_any(s, ",;", True)).alias("every"), text.strip(s).alias("stripped"), join(text.split_white(s)).alias("words"), join(text.squash(F.split(s, ","))).alias("squashed"))


@query("SELECT p_partkey, p_name || '|' || p_brand || 'x y' || '|' || p_type AS parts FROM (SELECT p_partkey, replace(p_name, ' ', '') AS p_name, replace(p_brand, ' ', '') AS p_brand, p_type FROM part)")
def quoted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = lambda c: F.regexp_replace(c, " ", "")
    s = F.concat(F.lit(" "), bare("p_name"), F.lit("  "), bare("p_brand"), F.lit("x\\ y '"), F.col("p_type"), F.lit("'"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_quoted(s), "|").alias("parts"))


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) || '.fa.gz' AS file, '/data/' || p_brand AS folder, 'gz' AS suffix, CAST(p_partkey AS VARCHAR) || '.fa' AS stem, '/out/' || p_brand || '/x' AS joined FROM part")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat(F.lit("/data/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".fa.gz"))
    return table(spark, sf_dir, "part").select("p_partkey", text.file_name(p).alias("file"), text.folder(p).alias("folder"), text.suffix(p).alias("suffix"), text.stem(p).alias("stem"), text.join_path(F.concat(F.lit("/out/"), "p_brand", F.lit("/")), F.lit("x")).alias("joined"))


PAIRS_SQL = """p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 3 AS c1, l_partkey AS s1, l_partkey + CAST(l_quantity AS BIGINT) AS e1, o_custkey % 3 AS c2, l_partkey - 20 + o_custkey % 60 AS s2, l_partkey - 20 + o_custkey % 60 + CAST(l_linenumber AS BIGINT) * 4 AS e2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, c1 = c2 AND ((s1 < e2 AND e2 <= e1) OR (s1 <= s2 AND s2 < e1) OR (s2 <= s1 AND e1 <= e2)) AS o FROM p)"""


@query(
    f"""WITH {PAIRS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, c1 = c2 AND s1 <= s2 AND e2 <= e1 AS contained, o AS overlapping, CASE WHEN c1 = c2 THEN CASE WHEN o THEN 0 ELSE greatest(s2 - e1, s1 - e2) + 1 END END AS far,
CASE WHEN o THEN greatest(s1, s2) ELSE 0 END AS shared_start, CASE WHEN o THEN least(e1, e2) ELSE 0 END AS shared_end, CASE WHEN c1 = c2 THEN abs(s1 - s2) END AS sites, e1 - s1 AS wide,
(c1, s1, e1) < (c2, s2, e2) AS before, (c1, e1, s1) < (c2, e2, s2) AS ends_before FROM r"""
)
def region_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    at, plus = F.col("l_partkey") - 20 + F.col("o_custkey") % 60, F.lit("+").alias("strand")
    a = F.struct((F.col("l_suppkey") % 3).alias("chrom"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("end"), plus, F.col("l_partkey").alias("pos"))
    b = F.struct((F.col("o_custkey") % 3).alias("chrom"), at.alias("start"), (at + F.col("l_linenumber").cast("bigint") * 4).alias("end"), plus, at.alias("pos"))
    rows, a, b = rows.select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), b.alias("b")), F.col("a"), F.col("b")
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", intervals.contains(a, b).alias("contained"), intervals.overlaps(a, b).alias("overlapping"), intervals.distance(a, b).alias("far"), intervals.intersection(a, b)["start"].alias("shared_start"),
        intervals.intersection(a, b)["end"].alias("shared_end"), intervals.site_distance(a, b).alias("sites"), intervals.width(a).alias("wide"), (intervals.start_order(a) < intervals.start_order(b)).alias("before"), (intervals.end_order(a) < intervals.end_order(b)).alias("ends_before"),
    )


@query("SELECT o_orderkey, CAST(n_nationkey AS BIGINT) AS lookup FROM orders JOIN nation ON n_nationkey = o_custkey % 25")
def relative_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("index"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("n"), (F.col("o_custkey") % 25).cast("string")).alias("name"))
    return intervals.relative_order(rows, names).select("o_orderkey", "lookup")


@query(f"WITH {L_SQL}, k AS (SELECT chrom AS name, 'c' AS chrom, min(s) AS s, min(s) + 5 AS e FROM l GROUP BY chrom) SELECT name, 'c' AS chrom, min(s) AS \"start\", max(e) AS \"end\" FROM (SELECT name, s, e FROM k UNION ALL SELECT chrom, s, e FROM l) GROUP BY name")
def clusters_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = line_regions(spark, sf_dir).select(F.col("chrom").alias("name"), F.lit("c").alias("chrom"), "start", "end")
    clusters = members.groupBy("name", "chrom").agg(F.min("start").alias("start")).withColumn("end", F.col("start") + 5)
    return intervals.extend_to_clusters(clusters, members)


@query(f"WITH {L_SQL}, w AS (SELECT DISTINCT CAST(n_nationkey * 6 AS VARCHAR) AS chrom FROM nation) SELECT w.chrom AS chrom, s AS \"start\", name FROM w LEFT JOIN l ON l.chrom = w.chrom")
def chromosomes_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 6).cast("string").alias("chrom"))
    return intervals.align_chroms(wanted, line_regions(spark, sf_dir)).select("chrom", "start", "name")


@query(f"WITH {L_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY chrom, s, e) AS i FROM l) SELECT bool_and(p IS NULL OR p <= k) AS sorted, (SELECT bool_and(p IS NULL OR p <= k) FROM (SELECT s AS k, lag(s) OVER (ORDER BY i) AS p FROM o)) AS by_start FROM (SELECT (chrom, s, e) AS k, lag((chrom, s, e)) OVER (ORDER BY i) AS p FROM o)")
def order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ordered import numbered

    rows = numbered(line_regions(spark, sf_dir).withColumn("strand", F.lit("+")), ["chrom", "start", "end"], "line_no")
    whole = intervals.check_sorted(rows)
    by_start = intervals.check_sorted(rows.withColumn("chrom", F.lit("c")).withColumn("end", F.lit(0).cast("bigint")))
    return whole.join(by_start.withColumnRenamed("sorted", "by_start"))  # a row each


@query(
    f"""WITH {Q_SQL}, p AS (SELECT name, seq, unnest(generate_series(1, length(seq) - 1)) AS i FROM q WHERE length(seq) > 1),
s AS (SELECT name AS chrom, row_number() OVER (PARTITION BY name ORDER BY i) - 1 AS n, i - 1 AS at FROM p WHERE substr(seq, i, 2) = 'CG'), k AS (SELECT chrom, max(n) AS top FROM s GROUP BY chrom)
SELECT chrom, a.at AS "start", b.at AS "end", 'h' || a.n AS name FROM s a JOIN k USING (chrom) JOIN s b USING (chrom) WHERE a.n % 7 = 0 AND b.n = least(a.n + 3, top)"""
)
def hits_in_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh CpG site up to the third after it, from CpG numbers to bases."""
    sites = cpgs.cpg_sites(sequences(spark, sf_dir), 4096)
    top = sites.groupBy("chrom").agg(F.max("ordinal").alias("top"))
    hits = sites.where(F.col("ordinal") % 7 == 0).join(top, "chrom")
    hits = hits.select("chrom", F.col("ordinal").alias("start"), F.least(F.col("ordinal") + 3, "top").alias("end"), F.concat(F.lit("h"), F.col("ordinal").cast("string")).alias("name"))
    return cpgs.to_bases(hits, sites)


@query(
    f"""WITH {Q_SQL}, t AS (SELECT name, seq, unnest(generate_series(0, length(seq) // 900)) AS k FROM q)
SELECT name AS chrom, 900 * k AS "start", substr(seq, 900 * k + 1, 333) AS seq FROM t"""
)
def fasta_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of each sequence, read from FASTA files below the checkpoint folder by an index of their offsets."""
    found = sequences(spark, sf_dir)
    folder = f"{shared_folder(spark)}/fasta-{uuid.uuid4().hex}"
    fasta.write_fasta(found, folder)
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.length("seq") / 900)))
    rows = found.select(F.col("name").alias("chrom"), starts.alias("k")).select("chrom", (F.col("k") * 900).alias("start"), (F.col("k") * 900 + 333).alias("end"))
    return indexed_fasta.regions_of_index(rows, indexed_fasta.fasta_index(spark, folder)).select("chrom", "start", "seq")


@query(
    f"""WITH {Q_SQL}, t AS (SELECT name, seq, CAST(name AS BIGINT) AS id, unnest(generate_series(0, length(seq) // 700)) AS k FROM q),
r AS (SELECT name AS chrom, 700 * k + id % 50 AS "start", id % 2 = 0 AS plus, substr(seq, 700 * k + id % 50 + 1, 640 + id % 9) AS seq FROM t)
SELECT chrom, "start", CASE WHEN plus THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END AS seq FROM r WHERE seq <> ''"""
)
def region_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions all along each sequence, of either strand; the last one of a sequence may begin or end beyond it."""
    found, own = sequences(spark, sf_dir), F.col("name").cast("bigint")
    tiles = found.select("name", own.alias("id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.length("seq") / 700))).alias("k"))
    start = F.col("k") * 700 + F.col("id") % 50
    rows = tiles.select(F.col("name").alias("chrom"), start.alias("start"), (start + 640 + F.col("id") % 9).alias("end"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("strand"))
    return regions.region_sequences(rows, found, 256).where(F.col("seq") != "").select("chrom", "start", "seq")


@query(f"WITH {Q_SQL}, k AS (SELECT substr(seq, i, 4) AS kmer FROM (SELECT seq, unnest(generate_series(1, length(seq) - 3)) AS i FROM q WHERE length(seq) > 3)), b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS x) SELECT a.x || b.x || c.x || d.x AS kmer, (SELECT count(*) FROM k WHERE k.kmer = a.x || b.x || c.x || d.x) AS n FROM b a, b, b c, b d")
def kmer_counts_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.kmer_counts(sequences(spark, sf_dir), 4, dense=True)


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_quantity + 2 * l_linenumber + 1 + l_partkey), 6) AS total FROM lineitem")
def log_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    ln = lambda c: F.ln(c.cast("double"))
    total = text.log_sum(ln(F.col("l_quantity") + F.col("l_linenumber")), ln(F.col("l_linenumber") + 1), F.when(F.col("l_partkey") > 0, ln(F.col("l_partkey"))).otherwise(0.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.when(F.col("l_partkey") == 1, ln(F.col("l_quantity") + 2 * F.col("l_linenumber") + 2)).otherwise(total), 6).alias("total"))


#: Parameters of the families in the queries of likelihoods; the value is l_quantity, or its share of 60.
FITS = {"gamma": [3.0, 8.0], "pois": [20.0], "nbd": [25.0, 0.4], "geo": [0.04], "beta": [1.5, 2.0], "binom": [60.0, 0.4], "exp": [25.0]}
LL_SQL = {
    "gamma": "2.0 * ln(x) - x / 8 - 3 * ln(8) - lgamma(3)",
    "pois": "x * ln(20) - 20 - lgamma(x + 1)",
    "nbd": "lgamma(x + 2.5) - lgamma(x + 1) - lgamma(2.5) + 2.5 * ln(2.5 / 27.5) + x * ln(25 / 27.5)",
    "geo": "ln(0.04) + x * ln(0.96)",
    "beta": "0.5 * ln(x / 60) + ln(1 - x / 60) + lgamma(3.5) - lgamma(1.5) - lgamma(2)",
    "binom": "lgamma(61) - lgamma(x + 1) - lgamma(61 - x) + x * ln(0.4) + (60 - x) * ln(0.6)",
    "exp": "-ln(25) - x / 25",
}
SCALED_SQL = {
    "exp": "-ln(25 * s) - x / 25 / s",
    "gamma": "2.0 * ln(x / s) - x / s / 8 - 3 * ln(8) - lgamma(3) - ln(s)",
    "pois": "x * ln(20 * s) - 20 * s - lgamma(x + 1)",
    "nbd": "lgamma(x + 2.5) - lgamma(x + 1) - lgamma(2.5) + 2.5 * ln(2.5 / (2.5 + 25 * s)) + x * ln(25 * s / (2.5 + 25 * s))",
}


@query("SELECT l_quantity AS x, " + ", ".join(f"round({e}, 6) AS {f}" for f, e in LL_SQL.items()) + ", " + ", ".join(f"round(exp({LL_SQL[f]}), 8) AS {f}_density" for f in ("gamma", "pois")) + " FROM (SELECT DISTINCT l_quantity, l_quantity AS x FROM lineitem)")
def likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x")).distinct()
    own = lambda f: x / 60 if f == "beta" else x
    dense = [F.round(distributions.density(f, x, FITS[f]), 8).alias(f"{f}_density") for f in ("gamma", "pois")]
    return rows.select("x", *[F.round(distributions.log_likelihood(f, own(f), FITS[f]), 6).alias(f) for f in LL_SQL], *dense)


@query("SELECT x, s, " + ", ".join(f"round({e}, 6) AS {f}" for f, e in SCALED_SQL.items()) + " FROM (SELECT DISTINCT l_quantity AS x, l_linenumber AS s FROM lineitem)")
def scaled_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_linenumber").alias("s")).distinct()
    return rows.select("x", "s", *[F.round(distributions.scaled_log_likelihood(f, F.col("x"), F.col("s").cast("double"), FITS[f]), 6).alias(f) for f in SCALED_SQL])


@query("SELECT round(sum(x * ln(20) - 20 - lgamma(x + 1)), 3) AS log_likelihood FROM (SELECT l_quantity AS x FROM lineitem)")
def total_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distributions.total_log_likelihood(table(spark, sf_dir, "lineitem"), "pois", "l_quantity", [20.0]).select(F.round("log_likelihood", 3).alias("log_likelihood"))


@query("SELECT n, k, round(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(k + 0.7) + lgamma(n - k + 1.9) - lgamma(n + 2.6) - (lgamma(0.7) + lgamma(1.9) - lgamma(2.6)), 6) AS ll FROM (SELECT DISTINCT CAST(l_quantity AS INTEGER) AS n, CAST(least(l_linenumber, l_quantity) AS INTEGER) AS k FROM lineitem)")
def beta_binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("n"), F.least("l_linenumber", "l_quantity").cast("int").alias("k")).distinct()
    return rows.select("n", "k", F.round(distributions.beta_binomial_log_pmf(F.col("k"), F.col("n"), 0.7, 1.9), 6).alias("ll"))


@query("SELECT round(sqrt(sum(w * x * x) / count(*) - pow(sum(w * x) / count(*), 2)), 6) AS sd, CAST(least(floor(sqrt(count(*))), floor(max(x)) + 1) AS BIGINT) AS classes FROM (SELECT l_quantity AS x, l_discount * 10 AS w FROM lineitem)")
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_discount") * 10).alias("w"))
    return distributions.weighted_sd(rows, "x", "w").select(F.round("sd", 6).alias("sd")).join(distributions.class_count(rows, "x"))  # a row each


@query("SELECT CAST(floor(x / 7) AS INTEGER) AS bin, round(sum(w), 6) AS n, CAST(floor(x / 7) * 7 AS DOUBLE) AS low FROM (SELECT l_quantity AS x, l_discount AS w FROM lineitem) GROUP BY ALL")
def weighted_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distributions.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", [7.0 * i for i in range(9)], "l_discount")
    return found.select("bin", F.round("n", 6).alias("n"), "low")


def _smooth_sql(source: str, half: str, size: str) -> str:
    """shares: the bins' shares by local lines over half around each bin's middle."""
    return f"""near AS (SELECT a.bin AS bin, b.m - a.m AS d, 0.75 * (1 - pow((b.m - a.m) / {half}, 2)) AS w, b.n AS y FROM {source} a JOIN {source} b ON b.m - a.m >= -{half} AND b.m - a.m < {half}),
sums AS (SELECT bin, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * y) AS t0, sum(w * d * y) AS t1 FROM near GROUP BY bin),
lines AS (SELECT bin, CASE WHEN abs(s0 * s2 - s1 * s1) > 1e-12 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS y FROM sums),
shares AS (SELECT bin, greatest(ln(greatest(1e-10, y / (SELECT sum(y) FROM lines))) - ln({size}), ln(1e-10)) AS v FROM lines)"""


@query(
    f"""WITH x AS (SELECT CAST(l_quantity AS INTEGER) AS x FROM lineitem), bins AS (SELECT bin, CAST(bin AS DOUBLE) AS m, (SELECT count(*) FROM x WHERE x = bin) AS n FROM (SELECT unnest(generate_series(0, (SELECT max(x) FROM x))) AS bin)),
{_smooth_sql('bins', '3.0', '1')} SELECT DISTINCT CAST(x AS DOUBLE) AS x, round(v, 6) AS ll FROM x JOIN shares ON bin = x"""
)
def empirical_discrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    model = distributions.fit(lines, "discemp", "l_quantity")
    return lines.select(F.col("l_quantity").alias("x")).distinct().select("x", F.round(distributions.log_likelihood("discemp", F.col("x"), model), 6).alias("ll"))


def _emp_sql(weight: str, half: str) -> str:
    return f"""WITH x AS (SELECT event_id, value AS x, {weight} AS w FROM events), k AS (SELECT CAST(greatest(1, floor(least(sqrt(count(*)), max(x) + 1))) AS INTEGER) AS k, max(x) AS top, {half} AS half FROM x),
placed AS (SELECT event_id, x, w, CAST(least(floor(x / (top / k)), k - 1) AS INTEGER) AS bin FROM x, k), bins AS (SELECT j AS bin, (j + 0.5) * top / k AS m, coalesce((SELECT sum(w) FROM placed WHERE bin = j), 0) AS n, half FROM (SELECT unnest(generate_series(0, (SELECT k FROM k) - 1)) AS j), k),
{_smooth_sql('bins', 'a.half', '(SELECT top / k FROM k)')} SELECT event_id, round(v, 5) AS ll FROM placed JOIN shares USING (bin)"""


@query(_emp_sql("1.0", "stddev_samp(x)"))
def empirical_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    model = distributions.fit(events, "emp", "value")
    return events.select("event_id", F.round(distributions.log_likelihood("emp", F.col("value"), model), 5).alias("ll"))


@query(_emp_sql("(user_id % 4 + 1) / 4.0", "sqrt(sum(w * x * x) / count(*) - pow(sum(w * x) / count(*), 2))"))
def empirical_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("w", (F.col("user_id") % 4 + 1) / 4.0)
    model = distributions.fit(events, "emp", "value", "w")
    return events.select("event_id", F.round(distributions.log_likelihood("emp", F.col("value"), model), 5).alias("ll"))
