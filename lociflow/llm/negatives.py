r"""Hard negatives by k-means inverted lists.

Vectors are whole numbers (floor of 256 x), scores their exact inner products. Centroids are learned from a bounded
sample (SAMPLE rows, CENTROIDS at most), but every row goes to the list of its nearest centroid and of the rest of its
label by LABELS, cut into blocks of BLOCK rows at most, so that one list of a third of all rows is many blocks. Each list has its centroid and the
radius that holds all its rows. By Cauchy and Schwarz a row's score lies within |anchor| * radius of the centroid's.

A search has for each anchor windows of scores, each with how many rows it wants and the least score that still counts
(the kth one so far). Lists of labels that don't count are left out; of the others an anchor takes the lists whose bounds
meet a window, those of the greatest upper bound first, for a number of rows that quadruples from round to round, and
stops when the bound of the next list falls strictly below the kth score of all its windows. Anchors travel in packs to
the blocks; each task keeps the best of what it meets before it hands on. Nothing is left out: the result is exact.

Defined cases: rows with a null label, null vector or any null or non-finite component take no part, nor do rows of a null
vec_id; a shorter vector counts as if filled up by zeros; repeated rows (of equal vec_id, label and vector) are one row;
different rows of one vec_id are rows each, but none is another row to an anchor of its own vec_id; ties go by vec_id; an
empty table gives an empty result; other columns are not looked at, whatever their names. Products beyond 64 bits fail.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, cut

#: Rows that centroids are learned from, how many centroids there are at most, and rests of labels that lists are told apart by.
SAMPLE, CENTROIDS, ROUNDS, LABELS = 20_000, 256, 8, 16
#: Rows of a block of a list, anchors that travel together, and rows that an anchor takes in its first round.
BLOCK, PACK, FIRST = 1024, 256, 4096
#: Best rows that a task holds before it hands them on.
HELD = 200_000
#: Added to each bound, relative to the sizes that enter it, so that rounding leaves no row out.
SLACK = 1e-9
#: Squares of lengths below it have exact products in double precision.
EXACT = 2.0**52
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = -(2**63), 2**63 - 1


def prepared(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label (the next one where vec_id is divisible by 7), q (whole numbers) of the rows that take part."""
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("bigint")

    def whole(x):
        y = x.cast("double") * scale
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return embeddings.where(sound).where(~odd).select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), F.transform("embedding", whole).alias("q")).distinct()


@dataclass(frozen=True)
class Index:
    """blocks: list, block and own (vec_id, label and q of up to BLOCK rows). Of each list the least and greatest label, the
    centroid, the radius, how many rows and how many blocks it has; width of the vectors, and their greatest square."""

    blocks: DataFrame
    labels: np.ndarray
    centroid: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    parts: np.ndarray
    width: int
    largest: float


def centroids(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """k-means of a sample's different rows, from random ones of them; an empty cluster keeps its centre."""
    rows = np.unique(sample, axis=0)
    centre = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].astype(float)
    for _ in range(rounds):
        near = nearest(rows, centre)
        sums, n = np.zeros_like(centre), np.bincount(near, minlength=len(centre))
        np.add.at(sums, near, rows)
        centre = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centre)
    return centre


def nearest(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centre."""
    return np.argmin((centre**2).sum(axis=1)[None, :] - 2 * rows @ centre.T, axis=1)


def vectors(cells: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), width)


def as_bytes(rows: DataFrame, width: int) -> DataFrame:
    """The rows with q as the bytes of width doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.array(x + [0.0] * (width - len(x)), np.float64).tobytes() for x in batch.column("q").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(cells, pa.binary())], names=["vec_id", "label", "q"])

    return rows.select("vec_id", "label", "q").mapInArrow(run, "vec_id bigint, label bigint, q binary")


def build(rows: DataFrame, width: int, largest: float, sample: int = SAMPLE, most: int = CENTROIDS) -> Index:
    """The lists of rows of (vec_id, label, q as bytes); what comes to the driver is the sample and a row for each list."""
    n, hashed = rows.count(), F.xxhash64("vec_id", "label", "q")
    bits = 1 << 20
    drawn = rows.where(F.pmod(hashed, F.lit(bits)) <= int(min(1.0, 1.2 * sample / max(n, 1)) * bits)).orderBy(hashed).limit(sample).select("q").collect()
    found = vectors([bytes(r.q) for r in drawn], width)
    centre = centroids(found, max(1, min(most, int(np.sqrt(len(found)))))) if len(found) else np.zeros((1, width))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = vectors(batch.column("q").to_pylist(), width)
            near = nearest(q, centre)
            away = np.sqrt(((q - centre[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64()), pa.array(away)], names=["vec_id", "label", "q", "cluster", "away"])

    placed = cut(rows.mapInArrow(assign, "vec_id bigint, label bigint, q binary, cluster bigint, away double")).withColumn("list", F.col("cluster") * LABELS + F.pmod("label", F.lit(LABELS)))
    lists = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.min("label").alias("low"), F.max("label").alias("high")).collect()  # CENTROIDS * LABELS rows at most
    at = np.array([r["list"] for r in lists], np.int64)
    size = np.zeros(len(centre) * LABELS, np.int64)
    size[at] = [r.n for r in lists]
    parts = -(-size // (BLOCK // 2))  # rows are dealt by hash to parts of half a block on average, and a part that is larger is cut on
    deal = F.array(*[F.lit(int(x)) for x in parts])
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("vec_id", "label", "q"), F.get(deal, F.col("list").cast("int"))))
    within = F.row_number().over(W.partitionBy("list", "part").orderBy("vec_id")) - 1
    packed = dealt.withColumn("block", F.col("part") + F.get(deal, F.col("list").cast("int")) * F.floor(within / BLOCK)).groupBy("list", "block")
    blocks = cut(packed.agg(F.array_sort(F.collect_list(F.struct("vec_id", "label", "q"))).alias("own")))
    tops = blocks.groupBy("list").agg(F.max("block").alias("top")).collect()
    n_blocks, radius, labels = np.zeros_like(size), np.zeros(len(size)), np.zeros((len(size), 2), np.int64)
    n_blocks[[r["list"] for r in tops]] = [r.top + 1 for r in tops]
    radius[at], labels[at] = [r.radius for r in lists], np.array([(r.low, r.high) for r in lists], np.int64).reshape(-1, 2)
    return Index(blocks, labels, np.repeat(centre, LABELS, axis=0), radius, size, n_blocks, width, largest)


#: A query: the anchor's number, vec_id, label, q, how many lists of its order it has passed, and low, high and least of each window.
QUERY = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("label", pa.int64()), ("q", pa.binary()), ("passed", pa.int64()), ("windows", pa.list_(pa.int64()))])
ASK = pa.schema([("list", pa.int64()), ("block", pa.int64()), ("anchors", pa.binary()), ("qs", pa.binary()), ("windows", pa.binary()), ("anchor", pa.int64()), ("passed", pa.int64())])
ASK_SQL = "list bigint, block bigint, anchors binary, qs binary, windows binary, anchor bigint, passed bigint"
HIT = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])
HIT_SQL = "anchor bigint, window bigint, score bigint, vec_id bigint"


def asks(queries: DataFrame, index: Index, same: bool, n_windows: int, budget: int) -> DataFrame:
    """For each block of the lists that anchors take next, packs of them; and for each anchor that has more to take a row
    of its number and how many lists it has passed."""
    labels, centroid, radius, rows, parts, width = index.labels, index.centroid, index.radius, index.rows, index.parts, index.width
    size = np.sqrt((centroid**2).sum(axis=1))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        anchor, anchor_id, label, passed = (np.asarray(batch.column(c), np.int64) for c in ("anchor", "anchor_id", "label", "passed"))
        q = vectors(batch.column("q").to_pylist(), width)
        windows = np.array(batch.column("windows").to_pylist(), np.int64).reshape(len(batch), n_windows, 3)
        norm = np.sqrt((q**2).sum(axis=1))[:, None]
        middle, reach = q @ centroid.T, norm * radius + SLACK * (norm * (size + radius) + 1)
        upper, lower = middle + reach, middle - reach
        own = label[:, None]
        fits = (labels[:, 0] <= own) & (own <= labels[:, 1]) if same else (labels[:, 0] != own) | (labels[:, 1] != own)
        meets = np.zeros_like(fits)
        for j in range(n_windows):
            low, high, least = windows[:, j].T[:, :, None]
            meets |= (upper >= np.maximum(low, least)) & (lower <= high) & (low <= high)
        fits &= meets & (rows > 0)
        order = np.argsort(-upper, axis=1, kind="stable")
        taken, left = [], []
        for i in range(len(batch)):
            places = passed[i] + np.flatnonzero(fits[i, order[i, passed[i] :]])
            lists = order[i, places]
            n = max(1, int(np.searchsorted(np.cumsum(rows[lists]), budget, "right")))
            taken.append(lists[:n])
            if n < len(lists):
                left.append((i, places[n]))
        flat = np.concatenate(taken)
        who = np.repeat(np.arange(len(batch)), [len(x) for x in taken])
        by_list = np.argsort(flat, kind="stable")
        flat, who = flat[by_list], who[by_list]
        starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else []
        for a, b in zip(starts, [*starts[1:], len(flat)], strict=True):
            i, c, n = who[a:b], int(flat[a]), int(parts[flat[a]])
            pack = [np.stack([anchor[i], anchor_id[i], label[i]], axis=1).tobytes(), q[i].tobytes(), windows[i].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int64()), pa.array(range(n), pa.int64()), *[pa.array([x] * n, pa.binary()) for x in pack], pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=ASK)
        if left:
            who = [i for i, _ in left]
            n = len(left)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(n, f.type) for f in list(ASK)[:5]], pa.array(anchor[who]), pa.array([int(p) for _, p in left], pa.int64())], schema=ASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), PACK):
                yield from one(batch.slice(start, PACK))

    return queries.select(*QUERY.names).mapInArrow(run, ASK_SQL)


def products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products; whole numbers of any size where doubles can't hold the sums."""
    if largest < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in b.tolist()]
    found = [[sum(int(x) * y for x, y in zip(row, other, strict=True)) for other in whole] for row in a.tolist()]
    return np.array(found, object).astype(np.int64)  # fails beyond 64 bits


def best_of(hits: np.ndarray, want: int) -> np.ndarray:
    """The first rows of each anchor and window, by score and then vec_id; hits has a column for each field of HIT."""
    hits = hits[:, np.lexsort((hits[3], -hits[2], hits[1], hits[0]))]
    new = np.concatenate([[True], (hits[0, 1:] != hits[0, :-1]) | (hits[1, 1:] != hits[1, :-1])]) if hits.shape[1] else np.zeros(0, bool)
    at = np.arange(hits.shape[1])
    return hits[:, at - np.maximum.accumulate(np.where(new, at, 0)) < want]


def scored(pairs: DataFrame, index: Index, same: bool, n_windows: int, want: int) -> DataFrame:
    """The rows of HIT of packs of anchors with blocks: the first want of each anchor and window, of all that a task meets."""
    width, largest = index.width, index.largest

    def one(pack: dict) -> np.ndarray:
        who = np.frombuffer(pack["anchors"], np.int64).reshape(-1, 3)
        q = np.frombuffer(pack["qs"], np.float64).reshape(len(who), width)
        windows = np.frombuffer(pack["windows"], np.int64).reshape(len(who), n_windows, 3)
        own = pack["own"]
        ids, labels = (np.array([r[c] for r in own], np.int64) for c in ("vec_id", "label"))
        s = products(q, vectors([r["q"] for r in own], width), largest)
        other = (labels[None, :] == who[:, 2:]) == same
        other &= ids[None, :] != who[:, 1:2]
        out = []
        for j in range(n_windows):
            low, high, least = windows[:, j].T[:, :, None]
            a, b = np.nonzero(other & (s >= np.maximum(low, least)) & (s <= high))
            out.append(best_of(np.stack([who[a, 0], np.full(len(a), j), s[a, b], ids[b]]), want))
        return np.concatenate(out, axis=1)

    def told(hits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in hits], schema=HIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for pack in batch.to_pylist():
                held.append(one(pack))
                n += held[-1].shape[1]
                if n > HELD:
                    held = [best_of(np.concatenate(held, axis=1), want)]
                    n = held[0].shape[1]
                if n > HELD // 2 and len(held) == 1:
                    yield told(held[0])
                    held, n = [], 0
        if held:
            yield told(best_of(np.concatenate(held, axis=1), want))

    return pairs.select("anchors", "qs", "windows", "own").mapInArrow(run, HIT_SQL)


def search(queries: DataFrame, index: Index, same: bool, n_windows: int, want: int, first: int = FIRST) -> DataFrame:
    """The first want rows of each window of each query, of its label (same) or of the others: anchor, window, rank (from 1),
    score and vec_id. Rounds go on until no anchor has a list left whose bounds meet a window."""
    ranked = W.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "vec_id")
    best, going, budget = None, queries, first
    while True:
        asked = cut(asks(going, index, same, n_windows, budget))
        hits = scored(asked.where(F.col("list").isNotNull()).join(index.blocks, ["list", "block"]), index, same, n_windows, want)
        hits = hits if best is None else hits.unionByName(best.drop("rank"))
        best = cut(hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= want))
        left = asked.where(F.col("list").isNull()).select("anchor", "passed")
        if left.isEmpty():
            return best
        full = best.where(F.col("rank") == want).select("anchor", "window", "score")
        kth = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))  # an entry for each window
        now = going.drop("passed").join(left, "anchor").join(kth, "anchor", "left")
        least = F.transform("windows", lambda x, i: F.when(i % 3 == 2, F.coalesce(F.try_element_at(F.col("kth"), F.floor(i / 3)), x)).otherwise(x))
        going, budget = now.withColumn("windows", F.when(F.col("kth").isNull(), F.col("windows")).otherwise(least)).drop("kth"), budget * 4


def hard_negatives(embeddings: DataFrame, low: int = 30, high: int = 90, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = 100, sample: int = SAMPLE, first: int = FIRST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    positives, the first rows of other labels whose score lies between low and high hundredths of the positive's."""
    bounded_batches(embeddings.sparkSession)
    rows = cut(prepared(embeddings))
    width, largest = rows.agg(F.max(F.size("q")), F.max(F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x))).first()
    width, largest = max(1, width or 0), largest or 0.0
    rows = cut(as_bytes(rows, width))
    index = build(rows, width, largest, sample)
    anchors = rows.where(F.col("vec_id") % every == 0)
    anchors = cut(anchors.repartition(max(1, -(-anchors.count() // PACK)), "vec_id")).select(F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "q")
    anything = F.array(F.lit(LEAST), F.lit(MOST), F.lit(LEAST))
    queries = anchors.withColumn("passed", F.lit(0).cast("bigint"))
    found = search(queries.withColumn("windows", anything), index, True, 1, positives, first)
    tenth = lambda n, up: F.expr(f"({n} * score + pmod(-{n} * score, 100)) div 100" if up else f"({n} * score - pmod({n} * score, 100)) div 100")
    window = F.struct("rank", F.array(tenth(low, True), tenth(high, False), F.lit(LEAST)).alias("w"))
    some = found.groupBy("anchor").agg(F.array_sort(F.collect_list(window)).alias("ws"))  # as many as positives
    none = F.array_repeat(F.array(F.lit(MOST), F.lit(LEAST), F.lit(LEAST)), F.lit(positives) - F.size("ws"))
    asked = queries.join(some, "anchor").withColumn("windows", F.flatten(F.concat(F.transform("ws", lambda x: x["w"]), none))).drop("ws")
    mined = search(asked, index, False, positives, negatives, first).select("anchor", (F.col("window") + 1).cast("int").alias("_p"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = found.select("anchor", F.col("rank").alias("_p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select("anchor", "anchor_id")
    return mined.join(known, ["anchor", "_p"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, with rows whose vec_id is divisible by 100 as anchors."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP13_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT *, row_number() OVER () AS anchor FROM v WHERE vec_id % 100 = 0),
s AS MATERIALIZED (SELECT anchor, a.vec_id AS anchor_id, v.vec_id AS vec_id, a.label = v.label AS same, CAST(list_sum(list_transform(list_zip(a.q, v.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) AS BIGINT) AS score FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor, positive_id, positive_score ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.anchor = s.anchor AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
