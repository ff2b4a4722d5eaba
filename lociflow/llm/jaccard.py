r"""Exact Jaccard join of documents by word shingles, by partition of the universe.

Two sets of a and b elements that reach the similarity differ in at most D elements, D a function of a + b. Sizes fall
into bands. A band cuts the universe of hashed shingles into m segments; in q of them a pair may differ by one element
and still be found, as each set also gives the keys of its segment with one element taken out. With m + q > D, some
segment must agree (the pigeonhole principle). m, q and the spare c of m + q = D + 1 + c follow from the band's sizes
by cost: the keys that a set gives, and the expected weight of empty segments. Empty segments say nothing, so a set that
can spare them (up to c) gives no key for them; a set with more of them keeps them all, so that a pair is missed only
if neither set could spare its empty segments, and those two meet in the keys they kept.

Keys are dealt and sorted by Spark and read as a stream: a row that repeats the key before it is linked to the first
document of its key. These star links are pruned by exact bounds (sizes, and the parities of 256 hash slots, which bound
the difference from below) and verified on whole sets. Documents of a key that the verified links leave in different
components are then compared with each other, and verified as well: no pair that shares a key is left undecided as to its
component. Equal sets are one representative throughout. Nothing is capped.

Every link lies within a component, so the links of a set are counted there: the sets of a component are dealt to blocks,
each pair of blocks meets in one group, and all its pairs of sets are compared on whole sets. Pairs don't become rows.

A shingle is a 64-bit hash of its words; two shingles of different words are taken for the same one with a chance of
2**-64 for each pair compared.

Defined cases: texts without words have an empty set and are linked with nothing; a null doc_id is never linked and has
a null component; a text of any length is read whole, in pieces; rows of one doc_id are one document that has the links of each of its texts; an empty table gives an
empty result; only doc_id (a bigint) and text are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import code_points as cp
from .common import bounded_batches, cut, documents, if_small
from .components import connected_components

WORDS, PERCENT = 4, 85
RATIO = 1.4
EMPTY_COST, SPARE_TAIL = 40.0, 1e-3
ROWS_OF_A_LEADER = 128
LEADER_ORDERS = 8
FIRST_KEYS = 32
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 64, 500_000, 4096
CROSS_ROWS, PAIRS_AT_ONCE = 512, 1 << 18
_SHINGLE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)]


def difference(total: int, percent: int = PERCENT) -> int:
    """The most elements in which two sets of total elements together differ if they reach the similarity."""
    return total - 2 * -(-percent * total // (100 + percent))


class Band:
    """Sizes from low to high (exclusive) and how their sets are cut."""

    def __init__(self, number: int, low: int, high: int, percent: int) -> None:
        self.number, self.low, self.high = number, low, high
        most = high - 1 + (high - 1) * 100 // percent
        self.difference = max(difference(t, percent) for t in range(max(2, most - 400), most + 1)) if most > 400 else max(difference(t, percent) for t in range(2, most + 1))
        middle = math.sqrt(low * (high - 1))
        self.segments, self.loose, self.spare = min((self._plan(middle, q) for q in range(min(self.difference + 1, 65))), key=lambda p: self._cost(middle, *p))

    def _plan(self, size: float, q: int) -> tuple[int, int, int]:
        spare = 0
        while True:
            m = max(1, q, self.difference + 1 + spare - q)
            rate = m * math.exp(-size / m)
            tail, term, k = 1.0, math.exp(-rate), 0
            while tail - term > SPARE_TAIL:
                tail -= term
                k += 1
                term *= rate / k
            if k <= spare or spare > self.difference:
                return m, q, spare
            spare = k

    @staticmethod
    def _cost(size: float, m: int, q: int, spare: int) -> float:
        return m + q * size / m + EMPTY_COST * m * math.exp(-size / m)


@lru_cache(maxsize=None)
def _band(number: int, low: int, percent: int) -> Band:
    return Band(number, low, max(low + 1, int(low * RATIO)), percent)


@lru_cache(maxsize=None)
def bands_of(size: int, percent: int = PERCENT) -> list[Band]:
    """The band of a size, and the lower ones whose sets could reach the similarity with it."""
    found, low, number = [], 1, 0
    while low <= size:
        high = max(low + 1, int(low * RATIO))
        if high - 1 >= -(-percent * size // 100):
            found.append(_band(number, low, percent))
        low, number = high, number + 1
    return found


def shingle_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """Of each text, the ascending hashes of its distinct shingles."""
    if len(texts) == 1 and len(texts[0]) > cp.LONG:
        h = cp.word_hashes(texts[0])
        at = np.array([0, len(h)])
    else:
        c, bounds = cp.points(texts)
        h, starts = cp.words(cp.lower(c))
        at = np.searchsorted(starts, bounds)
    sums = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        sums += h[i : i + len(sums)] * _SHINGLE[i % len(_SHINGLE)]
    sums = cp.mix(sums)
    found = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            own = np.sort(sums[a : b - n + 1])
            found.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = (h[a:b] * np.array([_SHINGLE[(i + 3) % len(_SHINGLE)] for i in range(b - a)])).sum(keepdims=True, dtype=np.uint64)
            found.append(cp.mix(short + np.uint64(b - a)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def keys_of(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The segment keys that a set gives, for its own band and those below that it can reach."""
    found = []
    spread = cp.mix(s ^ np.uint64(0x5851F42D4C957F2D))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
    for band in bands_of(len(s), percent):
        m, q = band.segments, band.loose
        segment = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ascending, as s is
        ends = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
        sizes = np.diff(ends)
        part = sums[ends[1:]] - sums[ends[:-1]]
        name = (np.uint64(band.number) << np.uint64(40)) + np.arange(m, dtype=np.uint64)
        name = cp.mix(name + np.uint64(0x9E3779B97F4A7C15))
        given_up = int((sizes[q:] == 0).sum()) + 2 * int((sizes[:q] <= 1).sum())
        full = sizes > 0 if given_up <= band.spare else np.ones(m, bool)
        found.append(cp.mix(part[full] + name[full]))
        if q:
            low = segment[: ends[q]].astype(np.int64)
            left = part[low] - spread[: ends[q]] + name[low]
            if given_up <= band.spare:
                left = left[sizes[low] > 1]
            found.append(cp.mix(left))
    return np.concatenate(found)


def _each(batch: pa.RecordBatch, column: int, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sets of a batch's texts in chunks, each with the row where it begins."""
    at = 0
    for part in cp.chunks(x.as_py() for x in batch.column(column)):
        yield at, shingle_sets(part, words)
        at += len(part)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def parities(s: np.ndarray) -> list[int]:
    """Whether each slot has an odd number of elements, 64 slots to a number; a power of two of slots, 256 or more."""
    slots = max(256, 1 << (len(s) - 1).bit_length()) if len(s) else 256
    odd = np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd).view(np.int64).tolist()


def set_digests(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (size of the set), s1 and s2 (128 bits that stand for it), p (its parities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _each(batch, 1, words):
                sums = np.array([[cp.mix(s ^ np.uint64(1)).sum(dtype=np.uint64), cp.mix(s ^ np.uint64(1 << 60)).sum(dtype=np.uint64)] for s in sets], np.uint64)
                columns = [batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64())]
                columns += [_longs(np.ascontiguousarray(sums[:, i])) for i in range(2)] + [pa.array([parities(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "s1", "s2", "p"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, p array<bigint>")


def segment_keys(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, v (doc_id); of equal sets that a task meets, only the first one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()  # 16 bytes for each distinct set of the task's own rows
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, sets in _each(batch, 1, words):
                keys, owners = [], []
                for i, s in enumerate(sets):
                    if len(s):
                        mark = np.array([len(s), cp.mix(s ^ np.uint64(1)).sum(dtype=np.uint64)], np.uint64).tobytes()
                        if mark not in met:
                            met.add(mark)
                            keys.append(keys_of(s, percent))
                            owners.append(np.full(len(keys[-1]), ids[at + i], np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([_longs(np.concatenate(keys)), pa.array(np.concatenate(owners), pa.int64())], names=["key", "v"])

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, "key bigint, v bigint")


def star_links(keys: DataFrame) -> DataFrame:
    """key, leader, v: of the documents of a key, each but the first one, with the first one.

    The order of documents is by hash, one of LEADER_ORDERS by key, so that the documents of a large group have several
    leaders and hang together by verified links even where one leader is too far from many of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = leader = last = None
        for batch in batches:
            k, v = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(k):
                continue
            new = np.concatenate([[k[0] != key], k[1:] != k[:-1]])
            again = np.concatenate([[not new[0] and v[0] == last], ~new[1:] & (v[1:] == v[:-1])])
            first = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            lead = np.where(first >= 0, v[first], leader if leader is not None else 0)
            key, leader, last = k[-1], lead[-1], v[-1]
            row = ~new & ~again
            if row.any():
                yield pa.RecordBatch.from_arrays([pa.array(k[row]), pa.array(lead[row]), pa.array(v[row])], names=["key", "leader", "v"])

    dealt = keys.repartition("key").sortWithinPartitions("key", F.xxhash64(F.pmod("key", F.lit(LEADER_ORDERS)), "v"), "v")
    return dealt.mapInArrow(run, "key bigint, leader bigint, v bigint")


def _folded(p: Column, to: Column) -> Column:
    """Parities of half as many slots, where there are more than in the other set's."""
    half = (F.size(p) / 2).cast("int")
    halves = F.zip_with(F.slice(p, F.lit(1), half), F.slice(p, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(p) > F.size(to), halves).otherwise(p)


def _possible(percent: int) -> Column:
    """Whether sizes n, _n and parities p, _p allow the similarity; sizes that do have at most twice the slots."""
    total = F.col("n") + F.col("_n")
    most = total - 2 * F.ceil(percent * total / (100 + percent))
    p, other = F.col("p"), F.col("_p")
    differ = F.aggregate(F.zip_with(_folded(p, other), _folded(other, p), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return F.when(100 * F.least("n", "_n") >= percent * F.greatest("n", "_n"), differ <= most).otherwise(F.lit(False))


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets reach the similarity. Documents of many pairs as a are split over several tasks."""
    pairs = cut(pairs.select("a", "b"))
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / ROWS_OF_A_LEADER).alias("parts")).where(F.col("parts") > 1)
    salted = if_small(pairs, parts, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)).cast("int").alias("part"))
    members = salted.unionByName(salted.select("a", F.col("a").alias("b"), "part").distinct()).withColumnRenamed("b", "doc_id")
    texts = if_small(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), members, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, found in _each(batch, 3, words):
                own = [batch.column(i).slice(at, len(found)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([s.tobytes() for s in found], pa.binary())], names=["a", "part", "b", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, part, b, s in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3), strict=True):
                own = np.frombuffer(s.as_buffer(), np.uint64)
                if (a, part) != group:
                    group, leaders = (a, part), []
                if a == b:
                    leaders.append(own.copy())
                elif any(_similar(x, own, percent) for x in leaders):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    shingles = texts.select("a", "part", F.col("doc_id").alias("b"), "text").mapInArrow(sets, "a bigint, part int, b bigint, s binary")
    ordered = shingles.repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"), "b")
    return ordered.mapInArrow(compare, "a bigint, b bigint").distinct()


def crossing_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of sets of one key (b) that lie in different components (own) and that the bounds allow.

    Of each key, the sets apart from its leader's component are compared with all of its sets, in groups of at most
    CROSS_ROWS of either, in numpy. A pair of many common keys is told at one of them: the least that is among the first
    keys of both, if there is one.
    """
    firsts = rest.groupBy("b").agg(F.slice(F.array_sort(F.collect_set("key")), 1, FIRST_KEYS).alias("firsts"))
    rest = rest.join(firsts, "b")
    size = rest.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.count_if("apart").alias("n_apart")).where(F.col("m") > CROSS_ROWS)
    parts = size.select("key", *[F.ceil(F.col(c) / CROSS_ROWS).cast("int").alias(to) for c, to in (("n_apart", "lefts"), ("m", "rights"))])
    sized = if_small(rest, parts, "key", "left")
    at = lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    place = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), F.lit(role).alias("role"))
    each = lambda n, to: F.transform(F.sequence(F.lit(0), F.col(n) - 1), to)
    left = F.when(F.col("apart"), each("rights", lambda j: place(at("lefts"), j, 1))).otherwise(F.array().cast("array<struct<i:int,j:int,role:int>>"))
    places = F.when(F.col("rights").isNull(), F.array(place(F.lit(0), F.lit(0), 3))).otherwise(F.concat(left, each("lefts", lambda i: place(i, at("rights"), 2))))
    rows = sized.select("key", "b", "own", "apart", "n", "p", "firsts", F.explode_outer(places).alias("at")).select("key", "at.i", "at.j", "at.role", "b", "own", "apart", "n", "p", "firsts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            names = [table[c].to_numpy() for c in ("key", "i", "j")]
            new = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in names], axis=0)])) if len(table) else np.zeros(1, int)
            held = table.slice(new[-1])
            yield from _crossing(table.slice(0, new[-1]), new, percent)
        if held is not None and len(held):
            yield from _crossing(held, np.array([0, len(held)]), percent)

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    lists = column.combine_chunks()
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(), offsets


def _crossing(table: pa.Table, starts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs of whole groups; starts has where each begins, and the end."""
    if not len(table):
        return
    key, role, b, own, n = (table[c].to_numpy() for c in ("key", "role", "b", "own", "n"))
    apart = table["apart"].to_numpy(zero_copy_only=False)
    (p, p_at), (firsts, f_at) = _ragged(table["p"]), _ragged(table["firsts"])
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    lefts = np.flatnonzero((role != 2) & apart)
    ends = np.cumsum(np.diff(starts)[group[lefts]])
    low = 0
    while low < len(lefts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS_AT_ONCE)))
        some, low = lefts[low:high], high
        sizes = np.diff(starts)[group[some]]
        x = np.repeat(some, sizes)
        y = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[group[x]]
        good = (role[y] != 1) & (own[x] != own[y]) & (~apart[y] | (b[x] < b[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[good], y[good]
        near = _near(p, p_at, x, y, n, percent)
        x, y = x[near], y[near]
        told = [(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True) if _told(key[i], firsts[f_at[i] : f_at[i + 1]], firsts[f_at[j] : f_at[j + 1]])]
        if told:
            i, j = np.array(told).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(b[i], b[j])), pa.array(np.maximum(b[i], b[j]))], names=["a", "b"])


def _told(key: int, left: np.ndarray, right: np.ndarray) -> bool:
    common = np.intersect1d(left, right)
    return not len(common) or key == common[0]


def _near(p: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether the parities of each pair differ in no more slots than the similarity allows."""
    total = n[x] + n[y]
    most = total - 2 * -(-percent * total // (100 + percent))
    wide = np.diff(at)
    keep = np.zeros(len(x), bool)
    small, large = np.where(wide[x] <= wide[y], x, y), np.where(wide[x] <= wide[y], y, x)
    for w in np.unique(wide[small]):
        for twice in (False, True):
            some = np.flatnonzero((wide[small] == w) & (wide[large] == (2 * w if twice else w)))
            for low in range(0, len(some), max(1, (1 << 19) // int(w))):
                own = some[low : low + max(1, (1 << 19) // int(w))]
                slots = np.arange(w)
                other = p[at[large[own]][:, None] + slots]
                if twice:
                    other = other ^ p[at[large[own]][:, None] + w + slots]
                differ = np.bitwise_count(p[at[small[own]][:, None] + slots] ^ other).sum(axis=1, dtype=np.int64)
                keep[own] = differ <= most[own]
    return keep


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    least = -(-percent * (len(x) + len(y)) // (100 + percent))
    if min(len(x), len(y)) < least:
        return False
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= least


def common_elements(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many elements each set of left has in common with each of right, or with each of left."""
    sets = [*left, *(right or [])]
    at = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(at) > 1  # only these can be common
    used = often[at]
    owner, at = owner[used], (np.cumsum(often) - 1)[at[used]]
    order = np.argsort(at, kind="stable")
    owner, at, end = owner[order], at[order], int(often.sum())
    found = np.zeros((len(left), len(left if right is None else right)), np.int64)
    for low in range(0, end, COLUMNS):
        high = min(low + COLUMNS, end)
        a, b = np.searchsorted(at, [low, high])
        has = np.zeros((len(sets), high - low), np.float32)
        has[owner[a:b], at[a:b] - low] = 1
        found += (has[: len(left)] @ (has if right is None else has[len(left) :]).T).astype(np.int64)
    np.fill_diagonal(found, [len(s) for s in left]) if right is None else None
    return found


def link_counts(placed: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """s1, s2, n, links of the sets that have links: the number of other sets of the same component that reach the similarity.

    placed has rep, s1, s2, n, component of every set. A component's sets go to blocks by hash, whose number grows with the
    root of the sets and with their elements, and a group is a pair of blocks.
    """
    size = placed.groupBy("component").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("w")).where(F.col("g") > 1)
    blocks = F.greatest(F.when(F.col("g") <= BLOCK_SETS, 1).otherwise(F.ceil(F.sqrt("g") / 2)), F.ceil(F.col("w") / BLOCK_SHINGLES))
    members = cut(if_small(placed, size.select("component", blocks.cast("int").alias("blocks")), "component"))
    texts = if_small(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in _each(batch, 0, words):
                sums = [_longs(np.array([cp.mix(s ^ np.uint64(x)).sum(dtype=np.uint64) for s in found], np.uint64)) for x in (1, 1 << 60)]
                yield pa.RecordBatch.from_arrays([*sums, pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["s1", "s2", "n", "s"])

    def compare(group: tuple, held: list[tuple]) -> Iterator[tuple]:
        left = [x for x in held if x[0] == group[1]]
        right = [x for x in held if x[0] == group[2]] if group[1] != group[2] else None
        if left and (right is None or right):
            a, b = np.array([x[3] for x in left]), np.array([x[3] for x in (left if right is None else right)])
            common = common_elements([x[4] for x in left], None if right is None else [x[4] for x in right])
            links = common >= -(-percent * (a[:, None] + b[None, :]) // (100 + percent))
            np.fill_diagonal(links, False) if right is None else None
            for own, counts in [(left, links.sum(1))] + ([] if right is None else [(right, links.sum(0))]):
                yield from ((*x[1:4], int(c)) for x, c in zip(own, counts, strict=True) if c)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["s1", "s2", "n", "links"])

        for batch in batches:
            out: list[tuple] = []
            for component, i, j, block, s1, s2, n, s in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (component, i, j) != group:
                    out += compare(group, held) if held else []
                    group, held = (component, i, j), []
                held.append((block, s1, s2, n, np.frombuffer(s, np.uint64)))
            if out:
                yield told(out)
        if held and (out := list(compare(group, held))):
            yield told(out)

    whole = texts.select("text").mapInArrow(sets, "s1 bigint, s2 bigint, n bigint, s binary").groupBy("s1", "s2", "n").agg(F.min("s").alias("s"))
    own = members.select("component", "blocks", F.pmod(F.xxhash64("s1", "s2"), "blocks").cast("int").alias("block"), "s1", "s2", "n").join(whole, ["s1", "s2", "n"])
    other = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = other.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "s1", "s2", "n", "s")
    dealt = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return dealt.mapInArrow(count, "s1 bigint, s2 bigint, n bigint, links bigint").groupBy("s1", "s2", "n").agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and, if asked for, links of every row of docs.

    links is the number of other sets that its set reaches the similarity with; those of equal sets count once.
    """
    bounded_batches(docs.sparkSession)
    digests = cut(set_digests(docs, words))
    known = digests.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    equal = known.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.first("p").alias("p"))
    sets = cut(equal.select("rep", "s1", "s2", "n", "p"))
    of = cut(known.select("doc_id", "s1", "s2", "n").join(sets.select("rep", "s1", "s2", "n"), ["s1", "s2", "n"]).select("doc_id", "rep").distinct())
    stars = cut(star_links(segment_keys(docs, words, percent)))
    sizes = sets.select("rep", "n", "p")
    others = sizes.select(*[F.col(c).alias(f"_{c}") for c in sizes.columns])

    def possible(pairs: DataFrame) -> DataFrame:
        """Distinct pairs of representatives that the bounds allow, from pairs of documents a, b."""
        named = pairs.join(sizes, F.col("a") == F.col("rep")).join(others, F.col("b") == F.col("_rep"))
        return named.where(_possible(percent)).select("a", "b").distinct()

    reps = of.select(F.col("doc_id").alias("v"), "rep")
    leads = of.select(F.col("doc_id").alias("leader"), F.col("rep").alias("lead_rep"))
    starred = cut(stars.join(reps, "v").join(leads, "leader").select("key", F.col("lead_rep").alias("a"), F.col("rep").alias("b")).where(F.col("a") != F.col("b")).distinct())
    star_pairs = starred.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    first = cut(verified(possible(star_pairs), docs, words, percent))
    same_id = of.groupBy("doc_id").agg(F.collect_set("rep").alias("r")).where(F.size("r") > 1).select("doc_id", F.explode("r").alias("b")).select(F.col("doc_id").alias("a"), "b")
    first_components = cut(connected_components(first.unionByName(same_id)))

    def component(rows: DataFrame, column: str, name: str) -> DataFrame:
        table = first_components.select(F.col("id").alias(column), F.col("component").alias("_c"))
        return rows.join(table, column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")

    members = component(component(starred, "a", "lead"), "b", "own")
    apart = members.where(F.col("lead") != F.col("own"))
    open_keys = apart.select("key").distinct()
    rest = members.join(open_keys, "key").join(sizes, F.col("b") == F.col("rep")).drop("rep")
    rest = cut(rest.select("key", "b", "own", (F.col("own") != F.col("lead")).alias("apart"), "n", "p"))
    second = cut(verified(crossing_pairs(rest, percent).distinct(), docs, words, percent))
    components = connected_components(first.unionByName(second).unionByName(same_id))
    placed = sets.select("rep", "s1", "s2", "n").join(components.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    if links:
        placed = cut(placed)
        placed = placed.join(link_counts(placed, docs, words, percent), ["s1", "s2", "n"], "left")
    own = digests.select("doc_id", "n", "s1", "s2")
    rows = own.where(F.col("n") > 0).join(placed.drop("rep", "n"), ["s1", "s2"], "left")
    rows = rows.unionByName(own.where(F.col("n") == 0), allowMissingColumns=True)  # empty sets have one digest and no links
    columns = [
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    ]
    return rows.select(*columns, *([F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).alias("links")] if links else []))


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by 4-word shingles at a similarity of 0.85, and the number of links of each document's set."""
    return jaccard_components(documents(spark, sf_dir))
