"""Quality classifier of supervised subword embeddings.

A document's features are its hashed words, word pairs and character n-grams. Each feature has a learned vector; the
mean of a document's vectors goes through a linear layer to a softmax over two classes. Both are learned together by
stochastic gradient descent in numpy, on a sample of labelled rows that SAMPLE_ROWS bounds, in one task that gets the
sample's features and gives the driver one weight for each. (The softmax of two classes
depends on a linear function of the mean alone.) A whole text is scored by a mean of look-ups.

Defined cases: null and empty texts have no features and get the score of the bias; a row without a label, or with a
null one, isn't learned from; labels of one class or none give a constant score; equal texts get equal scores and
repeated rows equal rows; a text of any length is scored whole, in pieces; an empty table gives an empty result. A null doc_id counts as the empty text in the split by crc32. Columns other than doc_id
and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import code_points as cp
from .common import bounded_batches, documents

#: The labelled rows that are learned from, at most: those of the smallest hashes.
SAMPLE_ROWS = 3000
BUCKETS = 1 << 16
GROUPS = 4  # words, word pairs, 3-grams, 5-grams
DIMENSIONS, EPOCHS, RATE, SEED = 8, 6, 30.0, 7


@dataclass
class Model:
    """The log odds of label 1 are the mean of weight over a document's features, plus bias."""

    weight: np.ndarray
    bias: float


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; any word said twice is one feature."""
    return np.where(h[:-1] == h[1:], np.uint64(0), cp.mix(h[:-1] * np.uint64(3) + h[1:]))


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group of features, the features in order of place and where each text's begin (and their end)."""
    c, bounds = cp.points(texts)
    h, starts = cp.words(c)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    at = np.searchsorted(starts, bounds)
    pairs = _pairs(h)
    inside = np.ones(len(pairs), bool)
    inside[at[1:-1][(at[1:-1] > 0) & (at[1:-1] <= len(pairs))] - 1] = False
    whole = np.concatenate([[0], np.cumsum(inside)])
    found = [
        ((h >> shift).astype(np.int32), at),
        ((pairs[inside] >> shift).astype(np.int32) + BUCKETS, whole[np.minimum(at, len(pairs))]),
    ]
    for group, n in ((2, 3), (3, 5)):
        k = np.zeros(max(0, len(c) - n + 1), np.uint32)
        for i in range(n):
            k = (k + c[i : i + len(k)]) * np.uint32(0x9E3779B1)
        ends = np.maximum(bounds[1:] - n, bounds[:-1])  # n-grams that lie within a text
        lies = np.zeros(len(k) + 1, np.int32)
        np.add.at(lies, np.minimum(bounds[:-1], len(k)), 1)
        np.add.at(lies, np.minimum(ends, len(k)), -1)
        keep = np.cumsum(lies[:-1]) > 0
        places = np.concatenate([[0], np.cumsum(keep)])
        found.append(((k[keep] >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32) + group * BUCKETS, places[np.minimum(bounds, len(k))]))
    return found


def long_features(text: str) -> Iterator[np.ndarray]:
    """All features of one long text, piece by piece, those over the cuts too."""
    last = np.zeros(0, np.uint64)
    for a, b in cp.pieces(text):
        yield np.concatenate([f for f, _ in features([text[a:b]])])
        h = cp.words(cp.points([text[a:b]])[0])[0]
        if a:
            for group, n in ((2, 3), (3, 5)):
                yield features([text[a - n + 1 : min(a + n - 1, b)]])[group][0]
            yield (_pairs(np.concatenate([last, h[:1]])) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32) + BUCKETS
        last = h[-1:] if len(h) else last


def counts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and their counts, for each text."""
    if len(texts) == 1 and len(texts[0]) > cp.LONG:
        n = sum(np.bincount(f, minlength=GROUPS * BUCKETS) for f in long_features(texts[0]))
        yield np.flatnonzero(n).astype(np.int32), n[n > 0]
        return
    found = features(texts)
    for i in range(len(texts)):
        own = np.concatenate([f[at[i] : at[i + 1]] for f, at in found])
        yield np.unique(own, return_counts=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """rows: distinct features, their counts, and the label."""
    labels = np.array([y for *_, y in rows])
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(GROUPS * BUCKETS, np.float32), 0.0 if not len(labels) else 4.0 if labels[0] else -4.0)
    random = np.random.default_rng(SEED)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (GROUPS * BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    balance = len(labels) / (2 * np.bincount(labels, minlength=2))
    step, steps = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            f, c, y = rows[i]
            own, share = vectors[f], (c / max(1, c.sum())).astype(np.float32)
            mean = share @ own
            odds = layer @ mean + bias
            p = np.exp(odds - odds.max())
            error = p / p.sum()
            error[y] -= 1
            error *= min(2.0, balance[y]) * (1 - step / steps)
            vectors[f] = own - RATE * share[:, None] * (error @ layer)
            layer -= np.float32(0.2) * np.outer(error, mean)
            bias -= np.float32(0.02) * error
            step += 1
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def score(texts: list[str], model: Model) -> np.ndarray:
    """Of each text, the probability of label 1."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    if len(texts) == 1 and len(texts[0]) > cp.LONG:
        for f in long_features(texts[0]):
            total += model.weight[f].sum(dtype=np.float64)
            n += len(f)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + model.bias, -30, 30)))
    for f, at in features(texts):
        sums = np.concatenate([[0.0], np.cumsum(model.weight[f], dtype=np.float64)])
        total += sums[at[1:]] - sums[at[:-1]]
        n += np.diff(at)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + model.bias, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from rows that aren't held out."""
    bounded_batches(docs.sparkSession)
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in cp.chunks(x.as_py() for x in batch.column(2)):
                found = list(counts(part))
                columns = [batch.column(i).slice(at, len(part)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x[i].astype(np.int32).tobytes() for x in found], pa.binary()) for i in (0, 1)]], names=["doc_id", "y", "f", "c"])
                at += len(part)

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(run, f"doc_id {kind}, y int, f binary, c binary")

    def learn(table: pa.Table) -> pa.Table:
        got = table.sort_by([(c, "ascending") for c in ("doc_id", "y", "f")])
        model = train([(np.frombuffer(f.as_buffer(), np.int32), np.frombuffer(c.as_buffer(), np.int32), y.as_py()) for f, c, y in zip(got["f"], got["c"], got["y"], strict=True)])
        return pa.table({"weight": pa.array([model.weight.astype("<f4").tobytes()], pa.binary()), "bias": [model.bias]})

    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "weight binary, bias double").collect()  # one row or none
    return Model(np.frombuffer(found[0].weight, "<f4"), found[0].bias) if found else train([])


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, and score, of every row; a column score of docs goes."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = tuple(c for c in keep if c != "score")
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in cp.chunks(x.as_py() for x in batch.column(at)):
                own = [batch.column(i).slice(done, len(part)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(score(part, sent.value), pa.float64())], names=[*keep, "score"])
                done += len(part)

    return rows.mapInArrow(run, T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType())]))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, by a model of the labelled ones that aren't held out."""
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
