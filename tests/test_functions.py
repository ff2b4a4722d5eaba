"""Functions, files, joins and models on small cases with known results."""

import itertools
import math
import random
from dataclasses import replace

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lociflow.functions import dna, quality, sam, text
from lociflow.operators import cpgs, distributions, hmm, intervals, levels, smoothing
from lociflow.sources import epireads, fasta, indexed_fasta, regions


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_dna(spark):
    r = one(spark, rc=dna.reverse_complement(F.lit("ACGTNacgtuxzbt-")), five=dna.five_letters(F.lit("acgtRx")), n=dna.kmer_number(F.lit("TGCA")), k=dna.number_kmer(F.lit(228), 4), b=dna.base_number(F.lit("C"), bisulfite=True))
    assert r.rc == "NanNNNacgtNACGT" and r.five == "ACGTNN" and r.n == 228 and r.k == "TGCA" and r.b == 3


def test_sam_and_cigar(spark):
    c = F.lit("2S3M1I2D4M1S")
    r = one(spark, q=sam.length(c, "query"), ref=sam.length(c, "reference"), cut=sam.truncate(c, F.lit(4), "query"), m=sam.merge_equal(F.lit("2M3M1I")), s=sam.soft_to_match(c, "terminal"), clip=sam.soft_clip(c), out=sam.on_reference(c, F.lit("AACCCGTTTTA")), back=sam.compress(sam.expand(c)))
    assert (r.q, r.ref, r.cut, r.m, r.s, r.clip, r.out, r.back) == (11, 9, "2S2M", "5M1I", "2M3M1I2D4M1M", 3, "CCCNNTTTT", "2S3M1I2D4M1S")


def test_quality_and_text(spark):
    r = one(spark, e=quality.char_to_error(F.lit("+")), c=quality.error_to_char(F.lit(0.001)), s=quality.score_to_error(F.lit(0.0), "solexa"), p=text.split_any(F.lit("a,,b;c"), ",;"), st=text.strip(F.lit(" x y \n")), q=text.split_quoted(F.lit("a 'b c' d\\ e \"\"")), l=text.log_sum(F.lit(0.0), F.lit(-1.0)))
    assert r.e == pytest.approx(0.1) and r.c == "?" and r.s == 0.5 and r.p == ["a", "b", "c"] and r.st == "x y" and r.q == ["a", "b c", "d e", ""] and r.l == -1.0


def test_nearest(spark):
    a = spark.createDataFrame([("c", 10, 12), ("c", 100, 101), ("d", 1, 2)], "chrom string, start bigint, end bigint")
    b = spark.createDataFrame([("c", 1, 5), ("c", 14, 20), ("c", 90, 95)], "chrom string, start bigint, end bigint")
    got = {(r.chrom, r.start): r.near_start for r in intervals.nearest(a, b, block=16).collect()}
    assert got == {("c", 10): 14, ("c", 100): 90, ("d", 1): None}


def test_files(spark, tmp_path):
    (tmp_path / "r.epiread").write_text("c\t0\tCCT\nc 2 TTN\nd\t1\tC\n")
    rows = epireads.read_epireads(spark, str(tmp_path / "r.epiread")).orderBy("line_no").collect()
    assert [(r.chr, r.pos, r.seq) for r in rows] == [("c", 0, "CCT"), ("c", 2, "TTN"), ("d", 1, "C")]
    (tmp_path / "bad.epiread").write_text("c\tx\tCCT\n")
    with pytest.raises(Exception, match="not a read"):
        epireads.read_epireads(spark, str(tmp_path / "bad.epiread")).collect()
    (tmp_path / "g.fa").write_text(">c one\nACG\nTAC\n>d\nGG\n")
    assert {r.name: r.seq for r in fasta.read_fasta(spark, str(tmp_path / "g.fa")).collect()} == {"c": "ACGTAC", "d": "GG"}
    (tmp_path / "x.sam").write_text("@HD\tVN:1.0\nq\t16\tc\t5\t60\t3M\t*\t0\t0\tACG\tIII\tNM:i:0\n")
    r = regions.read_sam(spark, str(tmp_path / "x.sam")).first()
    assert (r.qname, r.flags, r.pos, r.tags) == ("q", 16, 5, ["NM:i:0"])
    (tmp_path / "x.bed").write_text("track name=x\nc\t1\t5\nc 7 9 n 0.5 -\n")
    assert [(r.start, r.end, r.name, r.strand) for r in regions.read_regions(spark, str(tmp_path / "x.bed")).orderBy("start").collect()] == [(1, 5, "", "+"), (7, 9, "n", "-")]


def test_fits(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(r.gamma(3, 2, 3000), r.beta(2, 5, 3000), r.negative_binomial(4, 4 / 14, 3000))], "g double, b double, n bigint")
    assert distributions.fit(df, "gamma", "g") == pytest.approx([3, 2], rel=0.12)
    assert distributions.fit(df, "beta", "b") == pytest.approx([2, 5], rel=0.12)
    assert distributions.fit(df, "nbd", "n") == pytest.approx([10, 0.25], rel=0.12)


def all_paths(m, u, model):
    """The weight of every path of states, by brute force."""
    emit, n = hmm.emissions(m, u, model.shapes), len(model.names)
    end = model.end or (1.0,) * n
    return emit, {p: math.log(model.start[p[0]]) + sum(math.log(model.transitions[a][b]) for a, b in zip(p, p[1:])) + math.log(end[p[-1]]) + sum(emit[i, s] for i, s in enumerate(p)) for p in itertools.product(range(n), repeat=len(m))}


@pytest.mark.parametrize("gone", [0, 1, 2])
def test_a_missing_replicate_is_not_another(spark, gone):
    """Each replicate keeps its family and shapes, whichever of them has no row at a place."""
    shapes = (((0.8, 2.0), (2.0, 0.8)), ((1.2, 3.0), (2.5, 1.1)), ((0.5, 4.0), (3.0, 0.7)))
    families = ("betabin", "beta", "betabin")
    model = replace(hmm.two_states(0.1, 0.2, *shapes[0]), replicates=tuple(zip(families, shapes)))
    counts = {0: (3.0, 4.0), 1: (2.0, 9.0), 2: (6.0, 1.0)}
    rows = [("s", 0, r, *counts[r]) for r in counts if r != gone] + [("s", 1, 1, *counts[1]), ("s", 1, 1, 5.0, 9.0), (None, 0, gone, *counts[gone])]
    df = spark.createDataFrame(rows, "segment string, i bigint, replicate bigint, m double, u double")
    got = {(r.segment, r.i): (r.foreground, r.background) for r in hmm.prefix_likelihood(df, model).collect()}
    one = lambda r, m, u: hmm.emissions(np.array([m]), np.array([u]), shapes[r], families[r])[0]
    first = sum(one(r, *counts[r]) for r in counts if r != gone)
    assert got["s", 0] == pytest.approx(tuple(first)) and got[None, 0] == pytest.approx(tuple(one(gone, *counts[gone])))
    assert got["s", 1] == pytest.approx(tuple(first + one(1, *counts[1]) + one(1, 5.0, 9.0)))
    with pytest.raises(PythonException, match="replicates 0 to 2"):
        hmm.prefix_likelihood(df.withColumn("replicate", F.col("replicate") + 3), model).collect()


@pytest.mark.parametrize("bits", [1, 12])
def test_viterbi_keeps_null_segments_and_repeated_places(spark, monkeypatch, bits):
    monkeypatch.setattr(hmm, "BLOCK_BITS", bits)
    model = hmm.two_states(0.2, 0.3, (0.8, 2.0), (2.0, 0.8))
    rows = [(s, i, float(m), float(10 - m)) for s in (None, "a") for i, m in ((0, 9), (1, 8), (1, 8), (2, 0), (3, 1), (3, 1), (4, 9))]
    df = spark.createDataFrame(rows, "segment string, i bigint, m double, u double")
    got = hmm.decode(df, model, "viterbi").collect()
    whole = all_paths(np.array([r[2] for r in rows[:7]]), np.array([r[3] for r in rows[:7]]), model)[1]
    best = sorted(zip([r[1] for r in rows[:7]], [model.names[k] for k in max(whole, key=whole.get)]))
    for s in (None, "a"):
        assert sorted((r.i, r.state) for r in got if r.segment == s) == best
        assert hmm.decode(df, model).where(F.col("segment").eqNullSafe(F.lit(s))).count() == 7


@pytest.mark.parametrize("end", [None, 0.05])
@pytest.mark.parametrize("bits", [1, 2, 12])
def test_hmm_against_all_paths(spark, monkeypatch, bits, end):
    """Segments within one block and over several, in pieces of two rows."""
    monkeypatch.setattr(hmm, "BLOCK_BITS", bits)
    monkeypatch.setattr(hmm, "PIECE", 2)
    r = np.random.default_rng(5)
    model = hmm.two_states(0.2, 0.3, (0.8, 2.0), (2.0, 0.8), end)
    data = {name: (r.integers(0, 10, n).astype(float), r.integers(0, 10, n).astype(float)) for name, n in (("a", 1), ("b", 9), ("c", 2), ("d", 7))}
    data["b"][0][3] = data["b"][1][3] = 0
    rows = spark.createDataFrame([(s, i, float(a), float(b)) for s, (m, u) in data.items() for i, (a, b) in enumerate(zip(m, u))], "segment string, i bigint, m double, u double").repartition(5)
    found = {(x.segment, x.i): x for x in hmm.decode(rows, model).collect()}
    best = {(x.segment, x.i): x.state for x in hmm.decode(rows, model, "viterbi").collect()}
    moves = {(x.segment, x.i): x.p for x in hmm.transition_posteriors(rows, model, "background", "foreground").collect()}
    odds = {(x.segment, x.i): x for x in hmm.log_odds(rows, model).collect()}
    totals = {x.segment: x.log_likelihood for x in hmm.log_likelihood(rows, model).collect()}
    sums = {(x.segment, x.i): (x.foreground, x.background) for x in hmm.prefix_likelihood(rows, model).collect()}
    for s, (m, u) in data.items():
        emit, weight = all_paths(m, u, model)
        total = math.log(sum(map(math.exp, weight.values())))
        assert totals[s] == pytest.approx(total)
        top = max(weight, key=weight.get)
        for i in range(len(m)):
            p = sum(math.exp(w - total) for x, w in weight.items() if x[i] == 0)
            assert found[s, i].p[0] == pytest.approx(p) and best[s, i] == model.names[top[i]]
            assert odds[s, i].score == pytest.approx(abs(math.log(p / (1 - p)))) and odds[s, i].state == found[s, i].state
            assert moves[s, i] == pytest.approx(sum(math.exp(w - total) for x, w in weight.items() if i and x[i - 1 : i + 1] == (1, 0)))
            assert sums[s, i] == pytest.approx(tuple(emit[: i + 1].sum(axis=0)))
    _, history = hmm.train(rows, model, 2)
    assert history[0] == pytest.approx(sum(totals.values())) and len(history) == 2


def test_hmm_replicates(spark):
    """Two replicates, one of beta shares: the sum of their emissions, and shapes of their own after training."""
    r = np.random.default_rng(2)
    m, n = r.integers(0, 9, 30).astype(float), np.full(30, 9.0)
    share = np.clip(r.random(30), 0.02, 0.98)
    rows = [("s", i, 0, float(a), float(b - a)) for i, (a, b) in enumerate(zip(m, n))] + [("s", i, 1, float(x), 1.0) for i, x in enumerate(share) if i != 4]
    df = spark.createDataFrame(rows, "segment string, i bigint, replicate int, m double, u double")
    plain = hmm.two_states(0.2, 0.3, (0.8, 2.0), (2.0, 0.8))
    model = hmm.replace(plain, replicates=(("betabin", plain.shapes), ("beta", ((1.0, 3.0), (3.0, 1.0)))))
    seen = np.arange(30) != 4
    emit = hmm.emissions(m, n - m, plain.shapes)
    emit[seen] += hmm.emissions(share[seen], np.ones(29), ((1.0, 3.0), (3.0, 1.0)), "beta")
    last = {x.i: (x.foreground, x.background) for x in hmm.prefix_likelihood(df, model).collect()}[29]
    assert last == pytest.approx(tuple(emit.sum(axis=0)))
    density = lambda x, a, b: (a - 1) * math.log(x) + (b - 1) * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    assert hmm.emissions(np.array([0.3]), np.array([1.0]), ((1.5, 3.0),), "beta")[0, 0] == pytest.approx(density(0.3, 1.5, 3.0))
    trained, history = hmm.train(df, model, 3)
    assert len(history) == 3 and trained.replicates[0][1] != trained.replicates[1][1]


def test_fastq_over_many_splits(spark, tmp_path):
    """Records whose lines lie in different splits, in two files, keep together; broken files fail."""
    rows = [(f"r{i}", "ACGT" * (1 + i % 5), "I!+5" * (1 + i % 5)) for i in range(3000)]
    for k in range(2):
        (tmp_path / f"{k}.fq").write_text("".join(f"@{n}\n{s}\n+{n}\n{q}\n" for n, s, q in rows[k::2]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        paths = [str(tmp_path / f"{k}.fq") for k in range(2)]
        assert epireads.read_lines(spark, paths).rdd.getNumPartitions() > 5
        found = fasta.read_fastq(spark, paths, scored=True)
        got = found.collect()
        assert sorted((r.name, r.seq, r.qual) for r in got) == sorted(rows)
        assert {r.coding for r in got} == {"phred"} and got[0].scores[:4] == [40.0, 0.0, 10.0, 20.0]
        lines = epireads.read_lines(spark, str(tmp_path / "0.fq"))
        assert sorted(r.line_no for r in lines.collect()) == list(range(6000)) and fasta.is_fastq(lines)
        assert [r.line for r in lines.orderBy("line_no").limit(5).collect()] == ["@r0", "ACGT", "+r0", "I!+5", "@r2"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "bad.fq").write_text("@a\nACG\n+\nII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        fasta.read_fastq(spark, str(tmp_path / "bad.fq")).collect()


def test_quality_coding(spark):
    records = lambda *q: spark.createDataFrame([("n", "A" * len(x), x) for x in q], "name string, seq string, qual string")
    assert fasta.sniff_coding(records("II", "!!")) == "phred" and fasta.sniff_coding(records("hh", "II")) == "solexa"
    assert regions.mapped_reads_coding(spark.createDataFrame([("hhh",)], "scr string")) == "solexa"


def test_equal_regions_are_assigned_each(spark):
    small = spark.createDataFrame([("c", 5, 6, "x")] * 3 + [("c", 50, 60, "y")], "chrom string, start bigint, end bigint, name string")
    big = spark.createDataFrame([("c", 0, 10, "p"), ("c", 2, 9, "q"), ("c", 58, 70, "r")], "chrom string, start bigint, end bigint, name string")
    assert [r.big_name for r in intervals.assign_by_start(small, big, 16).collect()] == ["p"] * 3
    assert sorted(r.big_name for r in intervals.assign_by_start(small, big, 16, how="overlap").collect()) == ["p"] * 3 + ["r"]


def test_region_columns(spark):
    r = one(spark, a=F.expr("struct('c' as chrom, 5L as start, 9L as end, '+' as strand, 5L as pos)"), b=F.expr("struct('c' as chrom, 9L as start, 12L as end, '-' as strand, 9L as pos)"))
    df = spark.createDataFrame([r])
    a, b = F.col("a"), F.col("b")
    got = df.select(intervals.distance(a, b).alias("d"), intervals.intersection(a, b).alias("i"), intervals.site_distance(a, b).alias("s"), intervals.width(b).alias("w"), (intervals.end_order(a) < intervals.end_order(b)).alias("o")).first()
    assert (got.d, tuple(got.i), got.s, got.w, got.o) == (1, ("c", 0, 0), 4, 3, True)
    with pytest.raises(Exception, match="not found"):
        intervals.relative_order(spark.createDataFrame([("z",)], "name string"), spark.createDataFrame([(0, "a")], "index bigint, name string")).collect()


def test_cigar_mismatch_fails(spark):
    with pytest.raises(Exception, match="differ in length"):
        one(spark, x=sam.on_reference(F.lit("3M"), F.lit("AC")))


def test_files_of_chromosomes(spark, tmp_path):
    for name, text in (("a", ">a x\nACG\n"), ("b", ">b\nGG\n>c\nTT\n")):
        (tmp_path / f"{name}.fa").write_text(text)
    found = fasta.chromosomes(spark, str(tmp_path))
    assert {r.name: r.path.rsplit("/", 1)[1] for r in found.collect()} == {"a": "a.fa", "b": "b.fa", "c": "b.fa"}
    assert sorted(r.name for r in fasta.chromosomes(spark, str(tmp_path), by_content=False).collect()) == ["a", "b"]
    read = fasta.read_chromosomes(spark, found, ["c"])
    assert [(r.name, r.seq) for r in read.collect()] == [("c", "TT")] and indexed_fasta.read_fasta_target(spark, str(tmp_path), "a").first().seq == "ACG"
    with pytest.raises(ValueError, match="no file of z"):
        fasta.read_chromosomes(spark, found, ["z"])
    (tmp_path / "list").write_text(f"{tmp_path}/a.fa\n{tmp_path}/b.fa\n")
    assert fasta.read_fasta(spark, fasta.file_names(spark, str(tmp_path / "list"))).count() == 3


def test_written_files_read_back(spark, tmp_path):
    reads = spark.createDataFrame([("c", 3, "CTN"), ("d", 0, "T")], "chr string, pos bigint, seq string")
    epireads.write_epireads(reads, str(tmp_path / "reads"))
    assert sorted((r.chr, r.pos, r.seq) for r in epireads.read_epireads(spark, str(tmp_path / "reads")).collect()) == [("c", 3, "CTN"), ("d", 0, "T")]
    places = spark.createDataFrame([("c", 9, 12, "n", 0.5, "-"), ("c", 1, 5, "", 0.0, "+")], "chrom string, start bigint, end bigint, name string, score float, strand string")
    regions.write_regions(places, str(tmp_path / "bed"), track="x")
    lines = [line for f in sorted((tmp_path / "bed").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["track name=x", "c\t1\t5", "c\t9\t12\tn\t0.5\t-"]
    assert [tuple(r) for r in regions.read_regions(spark, str(tmp_path / "bed")).orderBy("start").collect()] == [("c", 1, 5, "", 0.0, "+"), ("c", 9, 12, "n", 0.5, "-")]
    sites = spark.createDataFrame([("c", 4, "+", "CpG", 0.25, 8)], regions.SITE_SCHEMA)
    regions.write_sites(sites, str(tmp_path / "sites"))
    assert [tuple(r) for r in regions.read_sites(spark, str(tmp_path / "sites")).collect()] == [("c", 4, "+", "CpG", 0.25, 8)]
    with pytest.raises(Exception, match="not a site"):
        regions.parse_sites(spark.createDataFrame([("c\t1\t?\tCpG\t0\t1",)], "value string")).collect()
    regions.write_lines(spark.createDataFrame([("a",), ("b",)], "value string").coalesce(1), str(tmp_path / "gz"), gzip=True)
    assert sorted(r.line for r in epireads.read_lines(spark, str(tmp_path / "gz")).collect()) == ["a", "b"] and list((tmp_path / "gz").glob("*.gz"))
    fasta.write_fasta(spark.createDataFrame([("s", "ACGTA" * 30)], "name string, seq string"), str(tmp_path / "fa"))
    assert fasta.read_fasta(spark, str(tmp_path / "fa")).first().seq == "ACGTA" * 30


def test_empirical_families(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(20, 3, 3000), r.normal(45, 2, 1000)])
    df = spark.createDataFrame([(float(v), int(v) % 9, 2.0) for v in x], "v double, k int, s double")
    model = distributions.fit(df, "emp", "v")
    width = model.breaks[1] - model.breaks[0]
    assert sum(math.exp(v) * width for v in model.log_density) == pytest.approx(1, abs=1e-2)
    ll = {round(t): one(spark, x=distributions.log_likelihood("emp", F.lit(t), model)).x for t in (20.0, 45.0, 3.0)}
    assert ll[20] > ll[45] > ll[3] and one(spark, x=distributions.log_likelihood("emp", F.lit(-1.0), model)).x is None
    counts = distributions.fit(df, "discemp", "k")
    assert len(counts.log_density) == 9
    half = distributions.fit_scaled(df, "exp", "v", "s")
    assert half == pytest.approx([float(np.mean(x)) / 2])
    with pytest.raises(ValueError):
        distributions.log_likelihood("emp", F.lit(1.0), [])
    with pytest.raises(ValueError):
        distributions.scaled_log_likelihood("beta", F.lit(1.0), F.lit(1.0), [1.0, 1.0])
    assert distributions.equal_span_breaks(df, "k", 4) == [0, 2, 4, 6, 8]
    assert distributions.equal_count_breaks(df, "v", 4) == [sorted(x)[i * 3999 // 4] for i in range(5)]


def test_kmers_and_pieces(spark):
    seq = "ACGTNACGGT" * 7 + "acg"
    df = spark.createDataFrame([("s", seq), ("t", "AC"), ("u", "")], "name string, seq string")
    want = {}
    for i in range(len(seq) - 2):
        if "N" not in (k := seq[i : i + 3].upper()):
            want[k] = want.get(k, 0) + 1
    for piece in (4, 7, 1 << 14):
        assert {r.kmer: r.n for r in levels.kmer_counts(df, 3, piece=piece).collect()} == want
        at = {(r.chrom, r.ordinal): r.position for r in cpgs.cpg_sites(df, piece).collect()}
        assert at == {("s", n): i for n, i in enumerate(i for i in range(len(seq)) if seq[i : i + 2].upper() == "CG")}
    assert one(spark, k=dna.kmers(F.lit("ACGT"), 3)).k == ["ACG", "CGT"] and one(spark, k=dna.kmers(F.lit("AC"), 3)).k == []
    with pytest.raises(Exception, match="no such CpG"):
        cpgs.to_bases(spark.createDataFrame([("s", 0, 99)], "chrom string, start bigint, end bigint"), cpgs.cpg_sites(df)).collect()
    own = spark.createDataFrame([("s", 2, 30, "-"), ("s", 2, 30, "-"), ("s", 65, 99, "+")], "chrom string, start bigint, end bigint, strand string")
    bases = [r.seq for r in regions.region_sequences(own, df, 8).collect()]
    assert sorted(bases) == sorted([seq[2:30][::-1].translate(str.maketrans("ACGT", "TGCA"))] * 2 + [seq[65:99].upper()])


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_indexed_fasta(spark, tmp_path, newline):
    """The index over several splits and files, and reads of no more bytes than are asked for."""
    r = random.Random(3)
    seqs = {f"s{i}": "".join(r.choice("ACGTacgtN") for _ in range(n)) for i, n in enumerate((0, 1, 49, 50, 51, 5000, 120_000))}
    for file, names in (("a.fa", list(seqs)[:4]), ("b.fa", list(seqs)[4:])):
        (tmp_path / file).write_bytes("".join(f">{n} more words{newline}" + "".join(seqs[n][i : i + 50] + newline for i in range(0, len(seqs[n]), 50)) for n in names).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        index = indexed_fasta.fasta_index(spark, str(tmp_path)).cache()
        assert {x.name: x.length for x in index.collect()} == {n: len(s) for n, s in seqs.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    wanted = [(n, a, b, "x") for n in seqs for a, b in ((0, 10), (40, 60), (49, 50), (50, 51), (4990, 5010), (100, 119_000), (-5, 3), (10**6, 10**6 + 5))]
    df = spark.createDataFrame([*wanted, ("none", 0, 5, "x")], "chrom string, start bigint, end bigint, seq_name string")
    got = indexed_fasta.regions_of_index(df, index).collect()
    assert sorted((x.chrom, x.start, x.end, x.seq) for x in got) == sorted((n, a, b, seqs[n][max(a, 0) : max(b, 0)]) for n, a, b, _ in wanted)
    assert all(x.bytes_read <= len(x.seq) + 2 * (len(x.seq) // 50 + 1) for x in got)
    assert {x.name: x.seq for x in indexed_fasta.sequences_of_index(index, ["s6", "s2", "s0"], 999).collect()} == {n: seqs[n] for n in ("s6", "s2", "s0")}
    (tmp_path / "odd.fa").write_text(">x\nACGT\nAC\nACGT\n")
    with pytest.raises(Exception, match="different lengths"):
        indexed_fasta.fasta_index(spark, str(tmp_path / "odd.fa")).collect()


def test_sites_that_are_sought(spark, tmp_path):
    """Only the row groups that a stretch meets are read."""
    rows = spark.range(20_000).select(F.concat(F.lit("chr"), F.col("id") % 4).alias("chrom"), F.col("id").alias("pos"), F.lit("+").alias("strand"), F.lit("CpG").alias("context"), F.lit(0.5).alias("meth"), F.lit(3).cast("bigint").alias("n_reads"))
    regions.write_site_table(rows.repartition(7), str(tmp_path / "t"), 500)
    found = regions.sites_between(spark.read.parquet(str(tmp_path / "t")), "chr2", 8000, 8200)
    assert sorted(r.pos for r in found.collect()) == list(range(8002, 8200, 4))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "t").glob("*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert len(groups) >= 40
    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.queryExecution().toRdd().count()
    scans = [plan]
    while scans and not scans[0].nodeName().startswith("Scan"):
        node = scans.pop(0)
        scans += [node.children().apply(i) for i in range(node.children().size())]
    assert scans[0].metrics().apply("numOutputRows").value() <= 1000


@pytest.mark.parametrize("rows", [5, 50_000])
def test_smoothing_against_plain_sums(spark, monkeypatch, rows):
    """Stretches in blocks of a few points or whole, null values, null keys and targets of their own."""
    monkeypatch.setattr(smoothing, "BLOCK_ROWS", rows)
    r = random.Random(6)
    points = [(k, r.choice([r.uniform(-30, 30), float(r.randrange(-20, 20))]), r.choice([None, *[r.gauss(0, 3) for _ in range(9)]])) for k in ("a", None) for _ in range(150)]
    df = spark.createDataFrame([*points, ("a", None, 1.0)], "key string, x double, y double")
    asked = spark.createDataFrame([(k, x) for k in ("a", None, "b") for x in (-31.0, 0.0, 0.5, 100.0, None)], "key string, x double")
    for targets, wanted in ((None, {(k, x) for k, x, _ in points}), (asked, {(k, x) for k in ("a", None) for x in (-31.0, 0.0, 0.5)})):
        mean, line = {}, {}
        for k, x in wanted:
            near = [(b - x, y) for q, b, y in points if q == k and -4 <= b - x < 4]
            w = [(0.75 * (1 - (d / 4) ** 2), d, y) for d, y in near]
            s = [sum(a * d**j for a, d, _ in w) for j in range(3)]
            t = [sum(a * d**j * y for a, d, y in w if y is not None) for j in range(2)]
            if s[0] > 1e-9 and any(y is not None for _, _, y in w):
                mean[k, x] = t[0] / s[0]
                det = s[0] * s[2] - s[1] ** 2
                line[k, x] = (s[2] * t[0] - s[1] * t[1]) / det if det > 1e-9 else t[0] / s[0]
        got = {(g.key, g.x): g.y for g in smoothing.kernel_smooth(df, 4.0, targets=targets).collect()}
        assert {k: got[k] for k in mean} == pytest.approx(mean, abs=1e-9)
        got = {(g.key, g.x): g.y for g in smoothing.local_linear(df, 4.0, targets=targets).collect()}
        assert {k: got[k] for k in line} == pytest.approx(line, abs=1e-6)
