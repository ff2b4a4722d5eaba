"""Work and memory that follow the input, and what a larger input would bring out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow import checkpoints, queries
from lociflow.functions import dna
from lociflow.operators import epialleles, hmm, intervals, windows
from lociflow.queries import base, models
from lociflow.sources import bam, indexed_fasta

SF = "/root/testdata/sf0.001"


def shuffled_rows(spark, monkeypatch, module):
    """Rows of each table that module hands to with_before(), which are the rows that it shuffles."""
    seen, plain = [], module.with_before
    monkeypatch.setattr(module, "with_before", lambda df, *rest, **values: seen.append(df.count()) or plain(df, *rest, **values))
    return seen


@pytest.mark.parametrize("by", ["start", "end"])
def test_sweeps_leave_out_chroms_of_one_list(spark, monkeypatch, by):
    a = spark.createDataFrame([(c, i, i + 3) for c in ("x", "only a", None) for i in range(0, 40, 4)], "chrom string, start bigint, end bigint")
    b = spark.createDataFrame([(c, i, i + 2) for c in ("x", "only b", None) for i in range(1, 41, 5)], "chrom string, start bigint, end bigint")
    seen = shuffled_rows(spark, monkeypatch, intervals)
    got = intervals.sweep(a, b, by).collect()
    assert {r.a.chrom for r in got} == {"x"} and len(got) > 5
    assert max(seen) == 2 * (10 + 8)


def test_nearest_leaves_out_chroms_of_b_alone(spark, monkeypatch):
    a = spark.createDataFrame([("x", 5, 7, 1), ("only a", 5, 7, 2), (None, 5, 7, 3)], "chrom string, start bigint, end bigint, id bigint")
    b = spark.createDataFrame([("x", 9, 10), (None, 1, 2), *[("only b", i, i + 1) for i in range(50)]], "chrom string, start bigint, end bigint")
    seen = shuffled_rows(spark, monkeypatch, intervals)
    got = {r.id: (r.near_start, r.near_end) for r in intervals.nearest(a, b).collect()}
    assert got == {1: (9, 10), 2: (None, None), 3: (1, 2)}
    assert max(seen) == 5


def test_ranges_of_reads_follow_their_rows(spark, monkeypatch):
    monkeypatch.setattr(base, "RANGE_ROWS", 400, raising=False)
    rows = base.reads(spark, SF)
    sizes = [r["count"] for r in rows.groupBy(F.shiftright("line_no", 33)).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 1200
    got = [(r.chr, r.pos, r.seq) for r in rows.orderBy("line_no").collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("size", ["64MB", "1g", "16777216", "4m"])
def test_tasks_get_few_bytes_of_a_shuffle(spark, size):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(name, size)
    checkpoints.cut(spark.range(3))
    assert spark.conf.get(name) == (size if size == "4m" else str(8 << 20))
    spark.conf.unset(name)


def test_reads_of_batches_are_read_once_where_none_is_deep(spark, capsys):
    """Batches that are taken apart have a branch of their own, which isn't planned where there are none."""
    rows = spark.createDataFrame([(i, "c", i // 4, "CTCCTTCTC") for i in range(400)], "line_no bigint, chr string, pos bigint, seq string")
    fits = epialleles.window_fits(windows.with_runs(rows))
    capsys.readouterr()
    fits.explain()
    assert capsys.readouterr().out.count("Scan ExistingRDD") == 1
    assert fits.count() > 50


def test_a_header_of_many_references_is_read_once_for_all_splits(spark, tmp_path, monkeypatch):
    header = "@HD\tVN:1.6\n" + "\n".join(f"@SQ\tSN:chr{i}\tLN:1000" for i in range(20_000))
    rows = spark.range(4000, numPartitions=1).select(
        F.concat(F.lit("r"), "id").alias("qname"), F.lit(0).alias("flags"), F.concat(F.lit("chr"), F.col("id") * 5).alias("rname"), (F.col("id") + 1).alias("pos"), F.lit(9).cast("smallint").alias("mapq"), F.lit("4M").alias("cigar"),
        F.lit("=").alias("rnext"), F.lit(7).cast("bigint").alias("pnext"), F.lit(0).alias("tlen"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"), F.array(F.concat(F.lit("XX:Z:"), F.sha2(F.col("id").cast("string"), 512))).alias("tags"),
    )
    bam.write_bam(rows, str(tmp_path / "x"), header)
    reader, calls, plain = bam.BamReader(str(tmp_path / "x"), 1 << 15), [], bam.read_header
    monkeypatch.setattr(bam, "read_header", lambda stream: calls.append(1) or plain(stream))
    parts = reader.partitions()
    found = [row for part in parts for row in reader.read(part)]
    assert len(parts) > 8 and len(calls) == 1
    assert [(r[0], r[2], r[3]) for r in found] == [(f"r{i}", f"chr{i * 5}", i + 1) for i in range(4000)]


def test_the_index_of_fasta_files_sorts_no_text(spark, tmp_path, monkeypatch):
    (tmp_path / "x.fa").write_text(">a b\nACGT\nAC\n>c\nGG\n")
    seen = []
    monkeypatch.setattr(indexed_fasta, "_measured", lambda lines, own=indexed_fasta._measured: seen.append(own(lines)) or seen[-1])
    got = {r.name: (r.length, r.offset) for r in indexed_fasta.fasta_index(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {"a": (6, 5), "c": (2, 16)}
    assert len(seen) == 1 and set(seen[0].columns) == {"path", "_split", "_id", "width", "head", "bases", "name"}


def test_places_of_sequences_take_no_expression_for_each_base(spark, capsys):
    """A lambda for each base, and a boxed array of weights, took 2 s a million bases."""
    queries.QUERIES["sequence_places"](spark, SF).explain()
    assert "lambda" not in capsys.readouterr().out


@pytest.mark.parametrize("chunk", [3, 1 << 16])
def test_steps_over_batches_of_sequences(spark, chunk):
    """Against the expressions for one base: sites at the edges of chunks and rows, rows without bases, nulls, any case."""
    seqs = ["", None, "C", "G", "CG", "cGCgN", "", "TTC", "GAC", "GCG", "CGCGCGCG", "xcg-ACGTacgtnN", None, "A"]
    plain = dna.call_bases(dna.complement_matrix(dna.consensus_matrix(F.col("s"))))
    sites = F.size(F.filter(F.sequence(F.lit(0), F.length("s")), lambda i: dna.is_cpg(F.col("s"), i)))
    rows = spark.createDataFrame(list(enumerate(seqs)), "id int, s string").coalesce(1)
    for r in rows.select("s", sites.alias("sites"), dna.cpg_count(F.col("s"), chunk).alias("n"), dna.reverse_by_weights(F.col("s"), chunk=chunk).alias("back"), plain.alias("plain")).collect():
        assert (r.n, r.back) == (None if r.s is None else r.sites, r.plain), r.s
    high = [r[0] for r in rows.select(dna.reverse_by_weights(F.col("s"), 0.2, chunk)).collect()]
    assert high[5] == "ACGCG"  # of equal weights the first


def test_training_reads_a_row_for_each_block_with_each_kind_once(spark):
    """Rows of observations, read twice in each round and taken apart one by one, took 50 us each."""
    observed = spark.createDataFrame([(None if i < 5 else i // 3000, i, float(i % 4), float(i % 2)) for i in range(20_000)], "segment bigint, i bigint, m double, u double")
    rows, blocks = hmm.packed(observed)
    found = rows.collect()
    assert len(found) == blocks < 20 and sum(r.n for r in found) == 20_000 == sum(len(r.code) for r in found)
    assert max(len(r.m) for r in found) == 4 and all(len(r.ends) == min(2, len(r.first)) for r in found)


@pytest.mark.parametrize("replicates", [False, True])
def test_blocks_take_steps_together(monkeypatch, replicates):
    monkeypatch.setattr(hmm, "PIECE", 3)
    model, rng, alone = models.REPLICATES if replicates else models.TWO, np.random.default_rng(5), []
    for first, n in (([0], 1), ([0], 20), ([0, 2], 9), ([0, 1, 9, 10], 30)):
        sizes = rng.integers(1, 3, n)
        k, m, u = rng.integers(0, 3, sizes.sum()).astype(float), rng.integers(0, 3, sizes.sum()).astype(float), np.full(sizes.sum(), 4.0)
        alone.append(hmm.Rows(n, np.array(first), sizes, np.arange(len(m)), k, m, u))
    kinds = [x.by_kind() for x in alone]
    together = hmm.Block(hmm.Rows.joined(kinds), model)
    each = [hmm.Block(x, model, whole=True) for x in alone]
    pre, post = np.tile(together.start, (len(together.first), 1)), np.tile(together.end, (len(together.first), 1))
    apart = [(b.forward(pre[: len(b.first)]), b.backward(post[: len(b.first)])) for b in each]
    np.testing.assert_allclose(together.forward(pre), np.concatenate([f for f, _ in apart]), rtol=1e-12)
    np.testing.assert_allclose(together.backward(post), np.concatenate([b for _, b in apart]), rtol=1e-12)
    edges = hmm.Block(hmm.Rows.joined([x.edges() for x in kinds]), model, whole=True).whole()
    np.testing.assert_allclose(edges, np.concatenate([b.whole()[[0] if len(b.first) == 1 else [0, -1]] for b in each]), rtol=1e-12)


def test_training_on_replicates_by_small_blocks(spark, monkeypatch):
    rows = models.replicated(spark, SF)
    whole, history = hmm.train(rows, models.REPLICATES, 2)
    monkeypatch.setattr(hmm, "BLOCK_BITS", 3)
    parts, again = hmm.train(rows, models.REPLICATES, 2)
    assert again == pytest.approx(history, rel=1e-9)
    flat = lambda model: [x for _, shapes in model.replicates for s in shapes for x in s] + [x for t in model.transitions for x in t]
    assert flat(parts) == pytest.approx(flat(whole), rel=1e-7)
