"""One- and two-allele models of the reads of each window, and tests between them.

The reads of a run go to batches of BATCH window starts each, once for each batch that they touch; equal reads are
counted before the shuffle. A batch's windows are then fitted together in numpy: rows are (window, read) pairs, and sums
over a window's rows are made by reduceat. No Python call is made for a single window. Batches of more than DEEP
different reads are taken apart before: their reads are clipped to each window and equal patterns counted, and a window
is a group of its own, whose rows are bounded by the patterns that a window can have, not by its depth.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.special import chi2_upper
from .windows import _spans, clip, clip_start

PSEUDO = 1e-10
LOW, HIGH = 0.25, 0.75
TOLERANCE = 1e-20
BATCH, DEEP = 512, 50_000
#: So many sites of a window are looked up together.
GROUP = 3
#: The table of deep batches is broadcast up to so many rows.
BROADCAST_BATCHES = 500_000

FIT_SCHEMA = "run_id bigint, chr string, run_cpgs bigint, w bigint, n_reads bigint, n_cpgs int, single_ll double, pair_ll double"


def _sum(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def _codes(states: np.ndarray) -> np.ndarray:
    """Rows of states (sites last; 0 for none, 1 for C, 2 for T) as a number for each GROUP of sites, groups first."""
    groups = -(-states.shape[1] // GROUP)
    whole = np.zeros((len(states), groups * GROUP), np.int64)
    whole[:, : states.shape[1]] = states
    return np.ascontiguousarray((whole.reshape(len(states), groups, GROUP) * 3 ** np.arange(GROUP)).sum(axis=2).T)


#: Of each number of a group, which of its sites have a C, and then which a T.
SEEN = np.array([[float(code // 3**site % 3 == state) for state in (1, 2) for site in range(GROUP)] for code in range(3**GROUP)])


def _tables(width: int, *alleles: np.ndarray) -> np.ndarray:
    """Chances of each number of each group of sites of each window, under an allele, or under two as one complex number.

    An allele may round to 0 or 1: only chances of states that a number has are multiplied.
    """
    n, groups = len(alleles[0]), -(-width // GROUP)
    chances = np.ones((len(alleles), groups * GROUP, 3, n))
    for part, a in zip(chances, alleles, strict=True):
        part[:width, 1], part[:width, 2] = a.T, 1 - a.T
    chances = chances.reshape(len(alleles), groups, GROUP, 3, n)
    table = chances[:, :, 0]
    for site in range(1, GROUP):
        table = (chances[:, :, site, :, None] * table[:, :, None]).reshape(len(alleles), groups, -1, n)
    table = np.ascontiguousarray(table.transpose(1, 3, 2, 0)).reshape(groups, -1)
    return table.view(complex) if len(alleles) > 1 else table


def _rows_chance(tables: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Products of what a row's numbers have in the tables; under two alleles, a pair for each row."""
    pairs = tables.dtype == complex
    out = tables[0].take(keys[0]).view(float)
    for table, key in zip(tables[1:], keys[1:], strict=True):
        out *= table.take(key).view(float)
    return out.reshape(-1, 2) if pairs else out


def _places(keys: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each group of sites its rows in the order of their keys, where each key begins, and those keys."""
    found = []
    for key in keys:
        small = key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key  # sorted by digits
        order = np.argsort(small, kind="stable")
        ordered = key[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        found.append((order, starts, ordered[starts]))
    return found


def _fit(places: list[tuple[np.ndarray, ...]], weight: np.ndarray, n: int, width: int, pseudo: float) -> list[np.ndarray]:
    """The allele of each window from its rows' weights; of complex weights, one of each part."""
    sums = np.zeros((len(places), n * 3**GROUP), weight.dtype)
    for row, (order, starts, keys) in zip(sums, places, strict=True):
        row[keys] = _sum(weight.take(order), starts)
    found = []
    for part in (sums.real, sums.imag) if np.iscomplexobj(sums) else (sums,):
        seen = (part.reshape(-1, 3**GROUP) @ SEEN).reshape(len(places), n, 2, GROUP)
        m, u = seen.transpose(2, 1, 0, 3).reshape(2, n, -1)[:, :, :width]
        found.append((m + pseudo) / (m + u + 2 * pseudo))
    return found


def fit_models(meth: np.ndarray, unmeth: np.ndarray, copies: np.ndarray, starts: np.ndarray, max_rounds: int = 10, low: float = LOW, high: float = HIGH) -> tuple[np.ndarray, ...]:
    """fit_codes() of 0/1 rows of sites."""
    return fit_codes(_codes(np.where(meth > 0, 1, np.where(unmeth > 0, 2, 0))), meth.shape[1], copies, starts, max_rounds, low, high)


def fit_codes(codes: np.ndarray, width: int, copies: np.ndarray, starts: np.ndarray, max_rounds: int = 10, low: float = LOW, high: float = HIGH) -> tuple[np.ndarray, ...]:
    """Log-likelihoods of the one- and the two-allele model of each window, both alleles, and each row's share of the first.

    codes are those of _codes(), copies how many reads a row stands for, starts the first row of each window. Alleles
    begin at low and high everywhere with equal shares. A round makes posteriors, rescales them to a mean of one half and
    refits both alleles; a window stops after the first round whose score is no better, and its rows are left out once
    half of the windows have stopped.
    """
    n = np.diff(np.append(starts, codes.shape[1]))
    keyed = lambda codes, n: codes + np.repeat(np.arange(len(n)) * 3**GROUP, n)
    keys, copies = keyed(codes, n), copies.astype(float)
    reads, half = _sum(copies, starts), np.log(0.5)
    places = _places(keys)
    (one,) = _fit(places, copies, len(n), width, PSEUDO)
    # an allele may round to 0 or 1, and very many sites may leave no chance that a double can hold
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        single = _sum(copies * np.log(_rows_chance(_tables(width, one), keys)), starts)
        first, second = np.full(one.shape, low), np.full(one.shape, high)
        at, size, begin, k, weight = np.arange(len(n)), n, starts, keys, copies  # the windows that go on, and their rows
        score, active = np.full(len(n), -np.finfo(float).max), np.ones(len(n), bool)
        for _ in range(max_rounds):
            both = _rows_chance(_tables(width, first[at], second[at]), k)
            total = both[:, 0] + both[:, 1]
            share = both[:, 0] / total
            now = _sum(weight * np.log(total), begin) + half * reads[at]
            mean = _sum(weight * share, begin) / reads[at]
            much = mean > 0.5
            scale = 0.5 / np.where(much, mean, 1 - mean)  # of the share, or of the rest
            share = share * np.repeat(scale, size) + np.repeat(np.where(much, 0.0, 1 - scale), size)
            both[:, 0], both[:, 1] = weight * share, weight * (1 - share)
            new1, new2 = _fit(places, both.reshape(-1).view(complex), len(at), width, PSEUDO / 2)
            going = active[at]
            first[at[going]], second[at[going]] = new1[going], new2[going]
            stop = (score[at] - now) / score[at] < TOLERANCE
            score[at] = np.where(going & ~stop, now, score[at])
            active[at] = going & ~stop
            if not active.any():
                break
            if 2 * active.sum() <= len(at):
                at = np.flatnonzero(active)
                size, weight = n[at], copies[np.repeat(active, n)]
                begin, k = np.cumsum(size) - size, keyed(codes[:, np.repeat(active, n)], size)
                places = _places(k)
        both = _rows_chance(_tables(width, first, second), keys)
        total = both.sum(axis=1)
        return single, _sum(copies * np.log(0.5 * total), starts), first, second, both[:, 0] / total


def _batch_windows(table: pa.Table, width: int, min_coverage: int, max_rounds: int, alleles: bool = False) -> dict[str, object]:
    """Fits of the tested windows of one batch; rows of a window that have the same states are one."""
    pos, copies, low, high = (table[c].to_numpy().astype(np.int64) for c in ("pos", "copies", "_from", "_to"))
    side = width + GROUP  # each read's text stands between so many blanks that a window's sites beyond it are blanks
    blanks = pa.scalar(" " * side)
    length = pc.binary_length(table["seq"]).to_numpy().astype(np.int64)
    text = np.frombuffer(pc.binary_join_element_wise(blanks, table["seq"], blanks, "").combine_chunks().buffers()[2], np.uint8)
    base = int(table["batch"][0].as_py()) * BATCH
    low, high = np.maximum(low, base), np.minimum(high, base + BATCH - 1)
    read = np.repeat(np.arange(len(pos)), high - low + 1)
    w = np.arange(len(read)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[read]
    order = np.argsort((w - base).astype(np.int16), kind="stable")
    read, w = read[order], w[order]
    begin, end = np.maximum(pos[read], w), np.minimum((pos + length)[read], w + width)
    starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    tested = _sum((end - begin) * copies[read], starts) >= width * min_coverage
    keep = np.repeat(tested, np.diff(np.append(starts, len(w))))
    if not keep.any():
        return {}
    read, w, begin, end = read[keep], w[keep], begin[keep], end[keep]
    starts = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    states = (text == ord("C")) + 2 * (text == ord("T")).astype(np.int64)
    at = (np.cumsum(length + 2 * side) - length - side - pos)[read] + w
    several = lambda n: sum(np.roll(states, -i) * 3**i for i in range(n))
    whole, rest = several(GROUP), several(width % GROUP)
    codes = np.stack([(whole if site + GROUP <= width else rest)[at + site] for site in range(0, width, GROUP)])
    weight, numbers = copies[read].astype(float), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(w))))
    rows, firsts, share_of = weight, starts, slice(None)
    if len(starts) * 3**width < 1 << 62:
        pattern = numbers * 3**width
        for site, code in zip(range(0, width, GROUP), codes, strict=True):
            pattern += code * 3**site
        found, which, share_of = np.unique(pattern, return_index=True, return_inverse=True)
        codes, rows = codes[:, which], np.bincount(share_of, weight)
        firsts = np.searchsorted(found, np.arange(len(starts)) * 3**width)
    single, pair, first, second, share = fit_codes(codes, width, rows, firsts, max_rounds)
    least, most = np.minimum.reduceat(begin, starts), np.maximum.reduceat(end, starts)
    found = {"w": w[starts], "n_reads": _sum(weight, starts).astype(np.int64), "n_cpgs": most - least, "single_ll": single, "pair_ll": pair}
    if alleles:
        cells = [slice(a, b) for a, b in zip((least - w[starts]).tolist(), (most - w[starts]).tolist(), strict=True)]
        found |= {"site": least, "first": [x[c].tolist() for x, c in zip(first, cells, strict=True)], "second": [x[c].tolist() for x, c in zip(second, cells, strict=True)]}
        seqs = table["seq"].to_pylist()
        rows = [{"pos": int(b), "seq": seqs[r][int(b - pos[r]) : int(e - pos[r])], "copies": int(copies[r]), "share": float(s)} for r, b, e, s in zip(read, begin, end, share[share_of], strict=True)]
        found["reads"] = [rows[a:b] for a, b in zip(starts, [*starts[1:], len(rows)], strict=True)]
    return found


READ_KIND = pa.list_(pa.struct([("pos", pa.int64()), ("seq", pa.string()), ("copies", pa.int64()), ("share", pa.float64())]))
KINDS = {"w": pa.int64(), "n_reads": pa.int64(), "n_cpgs": pa.int32(), "single_ll": pa.float64(), "pair_ll": pa.float64()}
ALLELE_KINDS = {"site": pa.int64(), "first": pa.list_(pa.float64()), "second": pa.list_(pa.float64()), "reads": READ_KIND}
ALLELE_SCHEMA = "site bigint, first array<double>, second array<double>, reads array<struct<pos:bigint,seq:string,copies:bigint,share:double>>"


def window_fits(reads: DataFrame, width: int = 10, min_coverage: int = 4, max_rounds: int = 10, alleles: bool = False) -> DataFrame:
    """Log-likelihoods of both models in each tested window; reads come from with_runs(). run_cpgs is the run's n_cpgs.

    With alleles, also the resolved alleles: site (the first one), first and second (chances of methylation by site) and
    reads, the clipped reads with how often they come and their share of the first allele.
    """
    if min_coverage < 1:
        raise ValueError("min_coverage must be 1 or more")
    spans = _spans(reads, width).groupBy("run_id", "chr", F.col("n_cpgs").alias("run_cpgs"), "pos", "seq", "_from", "_to").agg(F.count(F.lit(1)).alias("copies"))
    batches = cut(spans.withColumn("batch", F.explode_outer(F.sequence(F.floor(F.col("_from") / BATCH), F.floor(F.col("_to") / BATCH)))))
    deep = batches.groupBy("run_id", "batch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > DEEP).select("run_id", "batch", F.lit(True).alias("_deep"))
    deep = cut(deep)
    columns = ["run_id", "chr", "run_cpgs", "batch", "pos", "seq", "_from", "_to", "copies"]
    n_deep = deep.count()
    if not n_deep:
        return _fitted(batches.select(*columns, F.lit(-1).cast("bigint").alias("alone")), width, min_coverage, max_rounds, alleles)
    marked = batches.join(F.broadcast(deep) if n_deep <= BROADCAST_BATCHES else deep, ["run_id", "batch"], "left")
    plain = marked.where(F.col("_deep").isNull()).select(*columns, F.lit(-1).cast("bigint").alias("alone"))
    w = F.col("w")
    each = marked.where("_deep").withColumn("w", F.explode(F.sequence(F.greatest("_from", F.col("batch") * BATCH), F.least("_to", F.col("batch") * BATCH + BATCH - 1))))
    clipped = each.select("run_id", "chr", "run_cpgs", "batch", clip_start(w).alias("pos"), clip(w, width).alias("seq"), "w", "copies")
    counted = clipped.groupBy("run_id", "chr", "run_cpgs", "batch", "pos", "seq", "w").agg(F.sum("copies").alias("copies"))
    apart = counted.select("run_id", "chr", "run_cpgs", "batch", "pos", "seq", w.alias("_from"), w.alias("_to"), "copies", w.alias("alone"))
    return _fitted(plain.unionByName(apart), width, min_coverage, max_rounds, alleles)


def _fitted(dealt: DataFrame, width: int, min_coverage: int, max_rounds: int, alleles: bool) -> DataFrame:
    """window_fits() of reads that are dealt to batches, or to windows alone."""
    kinds = KINDS | (ALLELE_KINDS if alleles else {})

    def fit(table: pa.Table) -> pa.Table:
        found = _batch_windows(table, width, min_coverage, max_rounds, alleles)
        n = len(found.get("w", ()))
        columns = [pa.array([table["run_id"][0].as_py()] * n, pa.int64()), pa.array([table["chr"][0].as_py()] * n, pa.string()), pa.array([table["run_cpgs"][0].as_py()] * n, pa.int64())]
        columns += [pa.array(found[k] if n else [], kind) for k, kind in kinds.items()]
        return pa.Table.from_arrays(columns, names=["run_id", "chr", "run_cpgs", *kinds])

    return dealt.groupBy("run_id", "batch", "alone").applyInArrow(fit, FIT_SCHEMA + (f", {ALLELE_SCHEMA}" if alleles else ""))


def with_scores(fits: DataFrame, bic: bool = False) -> DataFrame:
    """Adds score: the BIC difference, or the p-value of the likelihood ratio test (with n_cpgs degrees of freedom)."""
    if bic:
        cost = F.col("n_cpgs") * F.ln(F.col("n_reads").cast("double"))
        return fits.withColumn("score", (2 * cost - 2 * F.col("pair_ll")) - (cost - 2 * F.col("single_ll")))

    @F.pandas_udf("double")
    def p_value(single, pair, df):
        import pandas as pd

        return pd.Series(1.0 - (1.0 - chi2_upper(-2 * (single.to_numpy() - pair.to_numpy()), df.to_numpy())))

    return fits.withColumn("score", p_value("single_ll", "pair_ll", "n_cpgs"))
