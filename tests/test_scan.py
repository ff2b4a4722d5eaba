"""Windows, models and tests against plain versions of them."""

import itertools
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lociflow.functions.special import chi2_upper, digamma, inverse_digamma, trigamma
from lociflow.operators import cpgs, epialleles, significance, windows
from lociflow.operators.ordered import numbered
from lociflow.plans import scan
from lociflow.sources import fasta
from lociflow.streaming import runs as streams


def made_reads(seed=1, n=60, chroms=("a", "b", "a")):
    r, rows = random.Random(seed), []
    for c in chroms:
        at = 0
        for _ in range(n):
            at = max(0, at + r.choice([0, 0, 1, 1, 2, -3]))
            state = r.choice(["C", "T"])
            rows.append((len(rows), c, at, "".join(state if r.random() < 0.9 else r.choice("CTN") for _ in range(r.randint(1, 14)))))
    return rows


def plain_runs(rows):
    runs = []
    for row in rows:
        if not runs or runs[-1][-1][1] != row[1]:
            runs.append([])
        runs[-1].append(row)
    return runs


def plain_windows(run, width):
    last = max(p + len(s) for _, _, p, s in run)
    for w in range(1 if last < width else last - width + 1):
        inside = []
        for _, _, p, s in run:
            if p >= w + width:
                break
            if p + len(s) > w:
                a, b = max(p, w), min(p + len(s), w + width)
                inside.append((a, s[a - p : b - p]))
        if inside:
            yield w, inside


def plain_models(inside, rounds):
    least = min(p for p, _ in inside)
    reads = [(p - least, s) for p, s in inside]
    n = max(p + len(s) for p, s in reads)

    def fit(weights, pseudo):
        m, t = [0.0] * n, [0.0] * n
        for (p, s), w in zip(reads, weights):
            for j, c in enumerate(s):
                if c in "CT":
                    m[p + j] += w * (c == "C")
                    t[p + j] += w
        return [(a + pseudo) / (b + 2 * pseudo) for a, b in zip(m, t)]

    def ll(read, a):
        p, s = read
        return sum(math.log(a[p + j] if c == "C" else 1 - a[p + j]) for j, c in enumerate(s) if c in "CT")

    one = fit([1.0] * len(reads), 1e-10)
    single = sum(ll(r, one) for r in reads)
    a1, a2, before = [0.25] * n, [0.75] * n, -1.7e308
    for _ in range(rounds):
        score, share = 0.0, []
        for r in reads:
            x, y = math.log(0.5) + ll(r, a1), math.log(0.5) + ll(r, a2)
            total = math.log(math.exp(x) + math.exp(y))
            score += total
            share.append(math.exp(x - total))
        mean = sum(share) / len(share)
        share = [v * 0.5 / mean for v in share] if mean > 0.5 else [1 - (1 - v) * 0.5 / (1 - mean) for v in share]
        a1, a2 = fit(share, 0.5e-10), fit([1 - v for v in share], 0.5e-10)
        if (before - score) / before < 1e-20:
            break
        before = score
    return n, single, sum(math.log(0.5 * math.exp(ll(r, a1)) + 0.5 * math.exp(ll(r, a2))) for r in reads)


@pytest.fixture(scope="module")
def runs(spark):
    return windows.with_runs(spark.createDataFrame(made_reads(), "line_no bigint, chr string, pos bigint, seq string"), block_bits=4)


def test_window_reads(runs):
    got = {}
    for r in windows.window_reads(runs, 10).collect():
        got.setdefault((r.run_id, r.w), []).append((r.line_no, r.pos, r.seq))
    want = {}
    for run in plain_runs(made_reads()):
        for w, inside in plain_windows(run, 10):
            want[run[0][0], w] = inside
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == want


def test_models(runs):
    got = {(r.run_id, r.w): r for r in epialleles.window_fits(runs, 10, 2, 10).collect()}
    want = {}
    for run in plain_runs(made_reads()):
        for w, inside in plain_windows(run, 10):
            if sum(len(s) for _, s in inside) >= 20:
                want[run[0][0], w] = (len(inside), *plain_models(inside, 10))
    assert got.keys() == want.keys() and got
    for k, (reads, n, single, pair) in want.items():
        assert (got[k].n_reads, got[k].n_cpgs) == (reads, n)
        assert got[k].single_ll == pytest.approx(single, abs=1e-6) and got[k].pair_ll == pytest.approx(pair, abs=1e-5)


def test_fdr_and_adjusted(spark):
    r = random.Random(2)
    p = [round(r.random() ** 4, 3) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    ordered, i = sorted(p), 0
    while i + 1 < len(ordered) and ordered[i + 1] < 0.2 * (i + 1) / 400:
        i += 1
    assert significance.fdr_cutoff(df, "p", 400, 0.2, blocks=7) == ordered[i]
    assert significance.fdr_cutoff(df, "p", 400, 0) > 1e300
    want, top = {}, 0.0
    for x in sorted(set(p)):
        top = max(top, x * 400 / sum(y <= x for y in p))
        want[x] = top
    got = {r.p: r.adjusted for r in significance.adjusted(df, "p", 400, blocks=7).collect()}
    assert got == pytest.approx(want)


def test_regions(spark):
    rows = [(i, "c", i % 3, ("C" if i % 2 else "T") * 12) for i in range(40)]
    rows = [(i, *row[1:]) for i, row in enumerate(sorted(rows, key=lambda x: x[2]))]
    df = spark.createDataFrame(rows, "line_no bigint, chr string, pos bigint, seq string")
    found = scan.regions(spark, df, scan.Options(gap=4, no_fdr=True)).collect()
    assert [(r.chrom, r.start, r.end, r.name) for r in found] == [("c", 0, 13, "AMR0:40")] and found[0].score < 1e-6


def test_special_functions():
    assert float(digamma(1.0)) == pytest.approx(-0.5772156649015329) and float(trigamma(1.0)) == pytest.approx(math.pi**2 / 6)
    x = np.array([0.01, 0.5, 3.0, 100.0])
    assert inverse_digamma(digamma(x)) == pytest.approx(x)
    assert chi2_upper([3.841458820694124, 5.991464547107979, 7.814727903251179, 23.209], [1, 2, 3, 10]) == pytest.approx([0.05, 0.05, 0.05, 0.01], abs=1e-5)


def test_a_window_of_very_many_equal_reads():
    """Alleles that round to 1 give no nan: the log-likelihood of ten million equal reads is about 0 in both models."""
    meth, unmeth = np.array([[1.0, 1.0]]), np.array([[0.0, 0.0]])
    single, pair, *_ = epialleles.fit_models(meth, unmeth, np.array([1e7]), np.array([0]))
    assert single[0] == pytest.approx(0, abs=1e-2) and np.isfinite(pair[0])
    two = epialleles.fit_models(np.array([[1.0, 0], [0, 0]]), np.array([[0, 0], [0, 1.0]]), np.array([1e7, 5e6]), np.array([0]))
    assert all(np.isfinite(x).all() for x in two)


def test_single_allele_of_equal_reads(spark):
    df = spark.createDataFrame([(1, "c", 0, 0, 2, "CC")], "run_id bigint, chr string, pos bigint, furthest bigint, n_cpgs bigint, seq string").select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("line_no"))
    counts = windows.site_counts(df)
    assert sorted(tuple(r) for r in counts.collect()) == [(1, "c", 0, 0, 5, 5), (1, "c", 0, 1, 5, 5)]
    many = counts.withColumn("meth", F.lit(10_000_000)).withColumn("total", F.lit(10_000_000))
    assert windows.single_allele_likelihood(many).first().log_likelihood == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_coverage_and_site_counts(spark, runs, bits):
    """By events over blocks of a few starts as by the reads of each window; late reads are left out of some."""
    cover, counts = {}, {}
    for run in plain_runs(made_reads()):
        for w, inside in plain_windows(run, 10):
            cover[run[0][0], w] = (len(inside), sum(len(s) for _, s in inside))
            for p, s in inside:
                for j, c in enumerate(s):
                    if c in "CT":
                        m, t = counts.get((run[0][0], w, p + j), (0, 0))
                        counts[run[0][0], w, p + j] = (m + (c == "C"), t + 1)
    assert {(r.run_id, r.w): (r.n_reads, r.coverage) for r in windows.window_coverage(runs, 10, bits).collect()} == cover
    assert {(r.run_id, r.w, r.site): (r.meth, r.total) for r in windows.site_counts(runs, 10).collect()} == counts


def test_reads_without_place_or_states_go(spark):
    rows = [(0, "a", None, "CC"), (1, "a", 3, None), (2, "a", 0, "CTCT"), (3, None, 5, "CC"), (4, None, 6, "T"), (5, "a", 1, "")]
    df = windows.with_runs(spark.createDataFrame(rows, "line_no bigint, chr string, pos bigint, seq string"))
    assert sorted((r.line_no, r.run_id, r.furthest, r.n_cpgs) for r in df.collect()) == [(2, 2, 0, 4), (3, 3, 5, 7), (4, 3, 6, 7), (5, 5, 1, 1)]
    assert [(r.chr, r.w, r.n_reads, r.coverage) for r in windows.window_coverage(df).where("run_id = 2").collect()] == [("a", 0, 1, 4)]


def test_no_task_gets_a_whole_run(spark):
    """No exchange of reads, events or windows is by run_id alone; the one of window_coverage() has a row for each block of starts."""
    found = windows.with_runs(spark.createDataFrame(made_reads(), "line_no bigint, chr string, pos bigint, seq string"))
    plans = [(windows.window_coverage(found), 1), (windows.single_allele_likelihood(windows.site_counts(found)), 0), (epialleles.window_fits(found), 0), (windows.window_reads(found), 0)]
    for plan, allowed in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert len(set(re.findall(r"hashpartitioning\(run_id#\d+L?, \d+\), [^\n]*", text))) <= allowed, text


def test_deep_windows_are_taken_apart(spark, runs, monkeypatch):
    plain = {(r.run_id, r.w): r for r in epialleles.window_fits(runs, 10, 2, 10, alleles=True).collect()}
    monkeypatch.setattr(epialleles, "DEEP", 5)
    deep = {(r.run_id, r.w): r for r in epialleles.window_fits(runs, 10, 2, 10, alleles=True).collect()}
    assert deep.keys() == plain.keys() and plain
    for k, r in plain.items():
        assert (deep[k].n_reads, deep[k].n_cpgs, deep[k].site) == (r.n_reads, r.n_cpgs, r.site)
        assert (deep[k].single_ll, deep[k].pair_ll) == pytest.approx((r.single_ll, r.pair_ll)) and deep[k].first == pytest.approx(r.first, abs=1e-6)
        assert sum(x.copies for x in r.reads) == r.n_reads == sum(x.copies for x in deep[k].reads) and len(r.first) == r.n_cpgs


def test_runs_over_blocks(spark):
    """The runs of reads and how far they have come, whatever the blocks."""
    rows = made_reads(seed=4, n=40, chroms=("a", "b", "b", "a", "c"))
    rows = [*rows, *[(len(rows) + i, c, i % 3, "C") for i, c in enumerate("ababccc")]]
    df = spark.createDataFrame(rows, "line_no bigint, chr string, pos bigint, seq string")
    want, far = {}, None
    for i, (n, c, p, _) in enumerate(rows):
        new = i == 0 or rows[i - 1][1] != c
        run, far = (n, p) if new else (run, max(far, p))  # noqa: F821
        want[n] = (run, far)
    for bits in (0, 1, 3, 20):
        assert {r.line_no: (r.run_id, r.furthest) for r in windows.with_runs(df, bits).collect()} == want
        ends = {run[0][0]: max(p + len(x) for _, _, p, x in run) for run in plain_runs(rows)}
        assert {r.run_id: r.n_cpgs for r in windows.with_runs(df, bits).collect()} == ends


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 101).alias("a"), (F.col("id") % 7).alias("b")).repartition(6)
    got = [(r.n, r.a, r.b) for r in numbered(df, ["a", "b"], "n").collect()]
    assert sorted(x[0] for x in got) == list(range(1000)) and [x[1:] for x in sorted(got)] == sorted((r.a, r.b) for r in df.collect())


def scan_reads():
    """Two chromosomes with allele-specific stretches, one twice, and one shorter than a window."""
    r, rows = random.Random(8), []
    for chrom, n in (("a", 70), ("b", 40), ("a", 25)):
        for at in range(n):
            for _ in range(r.randrange(2, 7)):
                odd = 12 <= at < 30 or 50 <= at < 56
                state = r.choice("CT") if odd else "C" if r.random() < 0.8 else "T"
                rows.append((len(rows), chrom, at, "".join(state if r.random() < 0.93 else r.choice("CTN") for _ in range(r.randrange(3, 13)))))
    rows += [(len(rows) + i, "tiny", i % 3, ("C" if i % 2 else "T") * 5) for i in range(30)]
    return rows


def genome():
    """A CpG each 2 to 24 bases on each chromosome."""
    r = random.Random(9)
    return {c: "".join("A" * r.randrange(0, 22) + r.choice(["CG", "cg", "Cg"]) for _ in range(100)) + "T" for c in ("a", "b", "tiny")}


def plain_scan(rows, options, sequences=None):
    """Regions as a plain loop over windows, hits and neighbours finds them."""
    import numpy as np

    tests, found = 0, []
    for run in plain_runs(rows):
        size = max(p + len(s) for _, _, p, s in run)
        for w, inside in plain_windows(run, options.width):
            if sum(len(s) for _, s in inside) < options.width * options.min_coverage:
                continue
            tests += 1
            n, single, pair = plain_models(inside, options.max_rounds)
            cost = n * math.log(len(inside))
            score = (2 * cost - 2 * pair) - (cost - 2 * single) if options.bic else float(chi2_upper([-2 * (single - pair)], [n])[0])
            if score < options.critical or options.bic and score < 0:
                found.append([run[0][0], run[0][1], w, size - 1 if size < options.width else w + options.width - 1, f"AMR{len(found)}:{len(inside)}", float(np.float32(score))])
    cutoff, scores = options.critical, sorted(h[5] for h in found)
    if not options.bic and not options.no_fdr and not options.adjust and scores:
        i = 0
        while i + 1 < len(scores) and scores[i + 1] < options.critical * (i + 1) / tests:
            i += 1
        cutoff = scores[i]
    if options.adjust and not options.bic:
        top, by = 0.0, {}
        for x in sorted(set(scores)):
            top = max(top, x * tests / sum(y <= x for y in scores))
            by[x] = float(np.float32(top))
        for h in found:
            h[5] = by[h[5]]
    joined = []
    for h in found:
        if joined and joined[-1][0] == h[0] and joined[-1][3] + 1 >= h[2]:
            joined[-1][3], joined[-1][5] = max(joined[-1][3], h[3]), min(joined[-1][5], h[5])
        else:
            joined.append(list(h))
    if sequences:
        at = {c: [i for i in range(len(s) - 1) if s[i : i + 2].upper() == "CG"] for c, s in sequences.items()}
        joined = [[r, c, at[c][s], at[c][e], n, x] for r, c, s, e, n, x in joined]
    merged = []
    for h in sorted(joined, key=lambda h: (h[1], h[2], h[3], h[4])):
        if merged and merged[-1][1] == h[1] and merged[-1][3] + options.gap >= h[2]:
            merged[-1][3], merged[-1][5] = max(merged[-1][3], h[3]), min(merged[-1][5], h[5])
        else:
            merged.append(list(h))
    return tests, [(c, s, e, n, x) for _, c, s, e, n, x in merged if (options.bic or x < cutoff) and max(e - s, 0) >= options.gap // 2]


OPTIONS = [{}, {"bic": True}, {"max_rounds": 100}, {"width": 6}, {"no_fdr": True}, {"adjust": True}, {"min_coverage": 5}, {"critical": 0.2, "gap": 6}, {"critical": 0.5, "adjust": True}]


@pytest.mark.parametrize(("options", "bases"), [*[(x, False) for x in OPTIONS], ({}, True), ({"bic": True}, True)])
def test_regions_of_every_option(spark, options, bases):
    """Names, places, scores and counters of the whole scan against the plain one, in CpG numbers and in bases."""
    own = scan.Options(**{"gap": 60 if bases else 4} | options)
    df = spark.createDataFrame(scan_reads(), "line_no bigint, chr string, pos bigint, seq string").repartition(5)
    known = spark.createDataFrame(list(genome().items()), "name string, seq string")
    found, counters = scan.scanned(df, own, (lambda hit: cpgs.to_bases(hit, cpgs.cpg_sites(known, 64))) if bases else None)
    tests, want = plain_scan(scan_reads(), own, genome() if bases else None)
    got = sorted(tuple(r) for r in found.drop("strand").collect())
    assert [r[:4] for r in got] == sorted(r[:4] for r in want) and len(want) >= 1
    assert [r[4] for r in got] == pytest.approx([r[4] for r in sorted(want)], rel=2e-3, abs=1e-6)
    assert counters["windows_tested"] == tests and counters["reads"] == len(scan_reads()) and counters["runs"] == 4


def test_counters_come_from_the_scan_itself(spark):
    df = spark.createDataFrame(scan_reads(), "line_no bigint, chr string, pos bigint, seq string")
    assert scan.stats(df).first().asDict() == scan.scanned(df)[1]


def test_chromosome_files_by_name(spark, tmp_path):
    """-a: only the files of chromosomes with hits are opened, whatever else is there; a missing one fails."""
    for name, seq in genome().items():
        (tmp_path / f"{name}.fa").write_text(f">{name} more\n{seq}\n")
    (tmp_path / "zz.fa").mkdir()
    (tmp_path / "r.epiread").write_text("".join(f"{c}\t{p}\t{s}\n" for _, c, p, s in scan_reads()))
    scan.main([str(tmp_path / "r.epiread"), "-o", str(tmp_path / "out"), "-c", str(tmp_path), "-a", "-g", "60"])
    lines = sorted(line.split("\t")[:4] for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines())
    assert lines == sorted([c, str(s), str(e), n] for c, s, e, n, _ in plain_scan(scan_reads(), scan.Options(gap=60), genome())[1])
    hit = spark.createDataFrame([("nowhere", 0, 1)], "chrom string, start bigint, end bigint")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        fasta.bases_of_files(hit, str(tmp_path)).collect()


def put(rows, folder, sizes):
    """Rows as Parquet files of these sizes, one after another in time."""
    folder.mkdir(exist_ok=True)
    n, at = len(list(folder.iterdir())), 0
    for i, size in enumerate(sizes):
        part = rows[at : at + size]
        at += size
        name = folder / f"{n + i:04d}.parquet"
        kind = pa.schema([("line_no", pa.int64()), ("chr", pa.string()), ("pos", pa.int64()), ("seq", pa.string()), ("sample", pa.string())])
        pq.write_table(pa.Table.from_pylist([dict(zip(kind.names, r)) for r in part], schema=kind), name)
        os.utime(name, (1_700_000_000 + n + i,) * 2)


@pytest.mark.parametrize("sizes", [[10_000], [7, 1, 50, 300, 10_000], [200] * 5])
def test_streams_give_the_same_regions_however_reads_are_cut(spark, tmp_path, sizes):
    """Two samples in turns, runs over files, and a query that is started again in the middle."""
    rows = [(*r, "s") for r in scan_reads()] + [(10**6, None, None, None, "s")]
    other = [(*r, "t") for r in made_reads()] + [(10**6, None, None, None, "t")]
    rows = [x for pair in itertools.zip_longest(rows, other) for x in pair if x]
    options = scan.Options(gap=4)
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    done = 0
    for part in (sizes[: len(sizes) // 2], sizes[len(sizes) // 2 :]):
        if not part:
            continue
        put(rows[done:], folder, part)
        done += sum(part)
        streams.scan_stream(streams.read_stream(spark, str(folder), 2), out, check, options).awaitTermination(240)
    for name, own in (("s", scan_reads()), ("t", made_reads())):
        df = spark.createDataFrame(own, "line_no bigint, chr string, pos bigint, seq string")
        want = sorted(tuple(r) for r in scan.regions(spark, df, options).collect())
        assert sorted(tuple(r) for r in streams.regions_so_far(spark, out, name, options).collect()) == want
        assert want or name == "t"


def test_the_state_of_a_stream_is_bounded():
    """A run of any length holds the reads of a window's width alone."""
    run, most, told, options = streams.Run(0, "c"), 0, 0, scan.Options()
    for i in range(20_000):
        run.add(i, i // 10, "CT" * 6, options.width)
        told += sum(len(x) for x in run.closed(options, False)) if i % 100 == 0 else 0
        most = max(most, len(run.reads))
    assert most <= (12 + options.width + 10) * 10 and told > 1900


def test_coverage_by_time(spark, tmp_path):
    rows = [(i, "c", i // 3, ("C" if i % 2 else "T") * 12) for i in range(40)]
    timed = spark.createDataFrame(rows, "line_no bigint, chr string, pos bigint, seq string").withColumn("ts", F.timestamp_seconds(F.col("line_no") * 60))
    timed.write.parquet(str(tmp_path / "timed"))
    told = streams.coverage_stream(streams.timed_stream(spark, str(tmp_path / "timed"))).writeStream.format("memory").queryName("told").outputMode("complete").trigger(availableNow=True).start()
    told.awaitTermination(120)
    counts = spark.sql("select window.start as s, n_reads, sites from told order by s").collect()
    assert [(r.n_reads, r.sites) for r in counts] == [(5, 60)] * 8


def test_command_line(spark, tmp_path):
    (tmp_path / "r.epiread").write_text("".join(f"c\t{i // 3}\t{('C' if i % 2 else 'T') * 12}\n" for i in range(60)))
    (tmp_path / "c.fa").write_text(">c\n" + "ACGT" * 40 + "\n")
    scan.main([str(tmp_path / "r.epiread"), "-o", str(tmp_path / "out"), "-c", str(tmp_path / "c.fa"), "-g", "10", "-f"])
    lines = [line.split("\t") for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines()]
    assert lines and all(x[0] == "c" and int(x[1]) % 4 == 1 and int(x[2]) % 4 == 1 and x[5] == "+" for x in lines)
