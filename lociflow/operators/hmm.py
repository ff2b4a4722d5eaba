"""Hidden Markov models of methylation along segments, with any small number of states.

Observations are rows segment, i (order), m, u (reads by state), and for replicates also replicate, the number from 0 of the
replicate in the model; any may be missing at a place. A null segment is a segment. A segment is what
lies between reset points. Rows are sorted by ranges of (segment, i) and cut into blocks of at most BLOCK rows, whatever
the lengths of segments: a task goes over its blocks one by one. Each block's part of a segment that may go on in another
block is one matrix of path sums; these few matrices (two a block) are put together by segment, and tell each block what
comes before and after it. Within a block, parts are cut into pieces of PIECE rows, and all pieces take a step at once in
numpy.

Training is rounds over rows of whole blocks, with each kind of observation (replicate, m, u) once in a block and the place
of each row's among them: parameters go out, the parts at blocks' edges are put together as above, each block gives expected transitions and sums of posteriors, Spark adds them up,
and the driver gets a row of sums. States emit beta-binomial counts, or beta shares (m of u) where a replicate says so.
Observations without reads say nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.special import lgamma, log_sum_exp
from .distributions import fit_beta
from .ordered import with_before

#: Training stops when no transition rate grew by this share; a rate that shrank counts as settled.
TOLERANCE = 1e-10
EDGE = 1e-2
#: The least rate of a transition where a segment can also end.
LEAST_RATE = 1e-10
BLOCK_BITS, PIECE = 12, 64
#: Matrices of parts are broadcast up to so many blocks.
BROADCAST_BLOCKS = 200_000
#: Blocks of a task where they are gone over many times, and blocks whose pieces take a step at once there.
TASK_BLOCKS, STEP_BLOCKS = 64, 16


@dataclass(frozen=True)
class Model:
    """names of the states, transitions[i][j], shapes (alpha, beta) of each, start shares; end probabilities or none.

    replicates: for each replicate its own family (betabin or beta) and shapes, instead of shapes.
    """

    names: tuple[str, ...]
    transitions: tuple[tuple[float, ...], ...]
    shapes: tuple[tuple[float, float], ...]
    start: tuple[float, ...]
    end: tuple[float, ...] | None = None
    replicates: tuple[tuple[str, tuple[tuple[float, float], ...]], ...] | None = None

    def logs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logarithms of transitions, start and end."""
        with np.errstate(divide="ignore"):
            return np.log(np.array(self.transitions)), np.log(np.array(self.start)), np.zeros(len(self.names)) if self.end is None else np.log(np.array(self.end))


def two_states(p_fb: float, p_bf: float, foreground: tuple[float, float], background: tuple[float, float], end: float | None = None) -> Model:
    """With end, a segment ends from either state with that probability, which staying gives up, and starts as likely in
    a state as it is entered."""
    total, e = p_bf + p_fb, end or 0.0
    stay = ((1 - p_fb - e, p_fb), (p_bf, 1 - p_bf - e))
    start = (p_bf / total, p_fb / total) if end is None else ((p_bf + stay[0][0]) / 2, (stay[1][1] + p_fb) / 2)
    return Model(("foreground", "background"), stay, (foreground, background), start, None if end is None else (end, end))


def three_states(transitions: tuple[tuple[float, ...], ...], hypo: tuple[float, float], hyper: tuple[float, float], hypo2: tuple[float, float]) -> Model:
    """hypo, HYPER and HYPO."""
    return Model(("hypo", "HYPER", "HYPO"), transitions, (hypo, hyper, hypo2), (1 / 3,) * 3)


def with_segments(sites: DataFrame, desert: int, block: int = 1 << 22) -> DataFrame:
    """Adds segment to rows of chrom and pos: another one after each gap of desert bases or more."""
    from .ordered import with_before

    rows = sites.withColumn("_block", F.floor(F.col("pos") / block))
    gaps = with_before(rows, ["chrom"], "_block", [F.col("pos")], _last=("max", F.col("pos")))
    begins = gaps.withColumn("_begin", F.when(F.col("_last").isNull() | (F.col("pos") - F.col("_last") >= desert), F.col("pos")))
    named = with_before(begins, ["chrom"], "_block", [F.col("pos")], _from=("max", F.col("_begin")))
    return named.withColumn("segment", F.concat_ws(":", "chrom", F.coalesce("_begin", "_from").cast("string"))).drop("_block", "_last", "_begin", "_from")


def emissions(m: np.ndarray, u: np.ndarray, shapes, family: str = "betabin") -> np.ndarray:
    """Log-likelihood of each observation under each state."""
    if family == "beta":
        share = np.clip(m / np.where(u > 0, u, 1), 1e-300, 1 - 1e-16)
        each = [(a - 1) * np.log(share) + (b - 1) * np.log1p(-share) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)) for a, b in shapes]
        return np.where((m + u >= 1)[:, None], np.stack(each, axis=1), 0.0)
    m, n = np.floor(m), np.floor(m) + u
    ways = lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1)
    each = [ways + lgamma(a + m) + lgamma(b + u) - lgamma(a + b + n) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)) for a, b in shapes]
    return np.where(n[:, None] > 0, np.stack(each, axis=1), 0.0)


def together(observations: DataFrame) -> DataFrame:
    """Replicates as arrays: segment, i, and k (replicates), m and u as arrays with an element for each row of a place.

    Without a replicate column rows stay as they are, so that two of one place are two; with it, rows of a place are its
    replicates, those of one replicate all counting. A null replicate fails the query.
    """
    number = lambda c: F.col(c).cast("double")
    if "replicate" not in observations.columns:
        return observations.select("segment", "i", F.array(F.lit(0)).alias("k"), *[F.array(number(c)).alias(c) for c in "mu"])
    known = F.coalesce(F.col("replicate").cast("int"), F.raise_error(F.lit("a replicate has to have a number")).cast("int"))
    lists = F.array_sort(F.collect_list(F.struct(known.alias("k"), number("m").alias("m"), number("u").alias("u"))))
    found = observations.groupBy("segment", "i").agg(lists.alias("r"))  # as many as replicates
    return found.select("segment", "i", *[F.col(f"r.{c}").alias(c) for c in "kmu"])


def sorted_blocks(observations: DataFrame) -> DataFrame:
    """segment, i, k, m, u (arrays by replicate) sorted by segment and i, with the number of each row's block."""
    place = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)  # the range is in the high bits, the row in the low ones
    return cut(together(observations).orderBy("segment", "i").withColumn("_block", place))


def _sum(x: np.ndarray, axis: int, best: bool) -> np.ndarray:
    """Logarithm of the sum, or for the best path the greatest."""
    return x.max(axis=axis) if best else log_sum_exp(x, axis=axis)


def _last_best(x: np.ndarray, axis: int) -> np.ndarray:
    """Where the greatest is; of equal ones the last."""
    return x.shape[axis] - 1 - np.argmax(np.flip(x, axis), axis=axis)


@dataclass(frozen=True)
class Rows:
    """The rows of one block: their number, the row where each part of a segment begins, how many observations each row has,
    and each observation's place among the kinds, which are replicate, m and u."""

    n: int
    first: np.ndarray
    sizes: np.ndarray
    code: np.ndarray
    k: np.ndarray
    m: np.ndarray
    u: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Rows:
        segment = table["segment"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        lists = [table[c].combine_chunks() for c in "kmu"]
        k, m, u = (x.flatten().to_numpy(zero_copy_only=False).astype(float) for x in lists)
        return Rows(len(table), first, pa.compute.list_value_length(lists[1]).to_numpy(), np.arange(len(m)), k, m, u)

    def by_kind(self) -> Rows:
        """The same with each kind once."""
        kinds, code = np.unique(np.stack([self.k, self.m, self.u]), axis=1, return_inverse=True)
        return replace(self, code=code.ravel(), k=kinds[0], m=kinds[1], u=kinds[2])

    @staticmethod
    def joined(all: list[Rows]) -> Rows:
        """Blocks one after another as one, in which each block's first row begins a part."""
        at, kind = (np.cumsum([0, *x]) for x in ([x.n for x in all], [len(x.m) for x in all]))
        one = lambda c, base=None: np.concatenate([getattr(x, c) + (0 if base is None else base[i]) for i, x in enumerate(all)])
        return Rows(int(at[-1]), one("first", at), one("sizes"), one("code", kind), one("k"), one("m"), one("u"))

    def edges(self) -> Rows:
        """The first and the last part alone."""
        if len(self.first) < 3:
            return self
        a, b = self.first[1], self.first[-1]
        ends = np.cumsum(self.sizes)
        return replace(self, n=int(a + self.n - b), first=np.array([0, a]), sizes=np.append(self.sizes[:a], self.sizes[b:]), code=np.append(self.code[: ends[a - 1]], self.code[ends[b - 1] :]))


def _each(rows: Rows, model: Model) -> np.ndarray:
    """Log-likelihood of each kind of observation under each state."""
    if model.replicates is None:
        return emissions(rows.m, rows.u, model.shapes)
    if len(rows.k) and not 0 <= rows.k.min() <= rows.k.max() < len(model.replicates):
        raise ValueError(f"the model has replicates 0 to {len(model.replicates) - 1} only")
    found = np.zeros((len(rows.k), len(model.names)))
    for r, (family, shapes) in enumerate(model.replicates):
        own = rows.k == r
        found[own] = emissions(rows.m[own], rows.u[own], shapes, family)
    return found


class Block:
    """The rows of one block: their emissions, and the pieces of the parts of segments.

    paths is worked out for all pieces if every part's whole() is asked for, else for parts of several pieces."""

    def __init__(self, rows: Rows, model: Model, best: bool = False, whole: bool = False) -> None:
        self.step, self.start, self.end = model.logs()
        self.best, self.rows, self.n, self.states = best, rows, rows.n, len(model.names)
        self.first = rows.first  # row where each part begins
        self.last = np.append(self.first[1:], self.n) - 1
        self.owner = np.repeat(np.arange(self.n), rows.sizes)
        each = _each(rows, model)[rows.code]
        if len(each) == self.n:  # a row has one observation at least
            self.emit = each
        else:
            self.emit = np.zeros((self.n, self.states))
            np.add.at(self.emit, self.owner, each)
        size = self.last - self.first + 1
        self.pieces = -(-size // PIECE)  # of each part
        self.part = np.repeat(np.arange(len(size)), self.pieces)
        self.head = np.cumsum(self.pieces) - self.pieces  # first piece of each part
        self.begin = self.first[self.part] + PIECE * (np.arange(len(self.part)) - self.head[self.part])
        self.size = np.minimum(PIECE, self.last[self.part] + 1 - self.begin)
        self.paths = self._paths(np.flatnonzero(whole | (self.pieces > 1)[self.part]))

    def _paths(self, needed: np.ndarray) -> np.ndarray:
        """Of each piece needed, the sums of all paths from a state of its first row to one of its last."""
        q = np.full((len(self.part), self.states, self.states), -np.inf)
        k = np.arange(self.states)
        q[:, k, k] = self.emit[self.begin]
        for t in range(1, int(self.size[needed].max(initial=0))):
            live = needed[self.size[needed] > t]
            q[live] = _sum(q[live][:, :, :, None] + self.step, 2, self.best) + self.emit[self.begin[live] + t][:, None, :]
        return q

    def whole(self) -> np.ndarray:
        """The same of each part."""
        q = self.paths[self.head].copy()
        for r in range(1, int(self.pieces.max(initial=0))):
            live = np.flatnonzero(self.pieces > r)
            moved = _sum(q[live][:, :, :, None] + self.step, 2, self.best)
            q[live] = _sum(moved[:, :, :, None] + self.paths[self.head[live] + r][:, None], 2, self.best)
        return q

    def forward(self, pre: np.ndarray) -> np.ndarray:
        """Of each row; pre has each part's weights before the emissions of its first row."""
        before = np.empty((len(self.part), self.states))
        before[self.head] = pre
        for r in range(1, int(self.pieces.max(initial=0))):
            at = self.head[self.pieces > r] + r
            ended = _sum(before[at - 1][:, :, None] + self.paths[at - 1], 1, self.best)
            before[at] = _sum(ended[:, :, None] + self.step, 1, self.best)
        self.before = before
        f = np.empty_like(self.emit)
        f[self.begin] = before + self.emit[self.begin]
        for t in range(1, int(self.size.max(initial=0))):
            at = self.begin[self.size > t] + t
            f[at] = _sum(f[at - 1][:, :, None] + self.step, 1, self.best) + self.emit[at]
        return f

    def backward(self, post: np.ndarray) -> np.ndarray:
        """Of each row; post has each part's weights after its last row."""
        after = np.empty((len(self.part), self.states))
        after[self.head + self.pieces - 1] = post
        for r in range(int(self.pieces.max(initial=0)) - 2, -1, -1):
            at = self.head[self.pieces > r + 1] + r
            entered = _sum(self.paths[at + 1] + after[at + 1][:, None, :], 2, self.best)
            after[at] = _sum(self.step + entered[:, None, :], 2, self.best)
        b = np.empty_like(self.emit)
        b[self.begin + self.size - 1] = after
        for t in range(int(self.size.max(initial=0)) - 2, -1, -1):
            at = self.begin[self.size > t + 1] + t
            b[at] = _sum(self.step + (self.emit[at + 1] + b[at + 1])[:, None, :], 2, self.best)
        return b

    def path(self, v: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The best state of each row, from best scores v (of forward()) and the last state of each part."""
        tail = np.empty(len(self.part), int)
        tail[self.head + self.pieces - 1] = end
        for r in range(int(self.pieces.max(initial=0)) - 2, -1, -1):
            at = self.head[self.pieces > r + 1] + r
            entered = _last_best(self.before[at + 1] + self.paths[at + 1, :, tail[at + 1]], 1)
            tail[at] = _last_best(v[self.begin[at + 1] - 1] + self.step[:, entered].T, 1)
        state = np.empty(self.n, int)
        state[self.begin + self.size - 1] = tail
        for t in range(int(self.size.max(initial=0)) - 2, -1, -1):
            at = self.begin[self.size > t + 1] + t
            state[at] = _last_best(v[at] + self.step[:, state[at + 1]].T, 1)
        return state


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks of batches that are ordered by block."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        number = table["_block"].to_numpy()
        edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist()] if len(number) else [0]
        for a, b in zip(edges, edges[1:], strict=False):
            yield table.slice(a, b - a)
        held = table.slice(edges[-1])
    if held is not None and len(held):
        yield held


def _parts(rows: DataFrame, model: Model, best: bool = False) -> DataFrame:
    """segment, block, q of each part of a segment, the paths of a part at its block's edge; total of others."""
    kind = dict(rows.dtypes)["segment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            block = Block(Rows.of(table), model, best, whole=True)
            q = block.whole()
            total = _sum(_sum(block.start[None, :, None] + q, 1, best) + block.end, 1, best)
            edge = np.zeros(len(q), bool)
            edge[[0, -1]] = True
            paths = pa.array([x.ravel().tolist() if e else None for x, e in zip(q, edge, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([table["segment"].combine_chunks().take(pa.array(block.first)), pa.array([table["_block"][0].as_py()] * len(q), pa.int64()), paths, pa.array(np.where(edge, np.nan, total))], names=["segment", "_block", "q", "total"])

    return rows.select("segment", "i", "k", "m", "u", "_block").mapInArrow(run, f"segment {kind}, _block bigint, q array<double>, total double")


def _joints(parts: DataFrame, model: Model, best: bool = False) -> DataFrame:
    """segment, _block, before (the forward values of the row before the part, or null), post (the backward values of its
    last row), last (the best path's state there) and total, from the parts at edges."""
    kind, k = dict(parts.dtypes)["segment"], len(model.names)

    def run(table: pa.Table) -> pa.Table:
        step, start, end = model.logs()
        table = table.sort_by("_block")
        q = [np.array(x).reshape(k, k) for x in table["q"].to_pylist()]
        ended, before = [], [None]
        for x in q:
            pre = start if before[-1] is None else _sum(before[-1][:, None] + step, 0, best)
            ended.append(_sum(pre[:, None] + x, 0, best))
            before.append(ended[-1])
        post = [end]
        for x in reversed(q[1:]):
            post.append(_sum(step + _sum(x + post[-1], 1, best)[None, :], 1, best))
        post.reverse()
        last = [int(_last_best(ended[-1] + end, 0))]
        for i in range(len(q) - 1, 0, -1):
            pre = _sum(ended[i - 1][:, None] + step, 0, best)
            entered = int(_last_best(pre + q[i][:, last[-1]], 0))
            last.append(int(_last_best(ended[i - 1] + step[:, entered], 0)))
        last.reverse()
        total = float(_sum(ended[-1] + end, 0, best))
        arrays = [pa.array([None if x is None else x.tolist() for x in c], pa.list_(pa.float64())) for c in (before[:-1], post)]
        return pa.Table.from_arrays([table["segment"], table["_block"], *arrays, pa.array(last, pa.int32()), pa.array([total] * len(q))], names=["segment", "_block", "before", "post", "last", "total"])

    edges = parts.where(F.col("q").isNotNull()).select("segment", "_block", "q")
    return edges.groupBy("segment").applyInArrow(run, f"segment {kind}, _block bigint, before array<double>, post array<double>, last int, total double")


def _scan(rows: DataFrame, model: Model, schema: str, each: Callable[[pa.Table, Block, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], best: bool = False) -> DataFrame:
    """each(table, block, before, post, last) for each block, with what _joints() says of its parts (nan and -1 for none)."""
    joints = _joints(_parts(rows, model, best), model, best).select(F.col("segment").alias("_s"), F.col("_block").alias("_b"), "before", "post", "last")
    small = rows.select("_block").distinct().count() <= BROADCAST_BLOCKS
    joined = rows.join(F.broadcast(joints) if small else joints, (F.col("_block") == F.col("_b")) & F.col("segment").eqNullSafe(F.col("_s")), "left").drop("_s", "_b")
    if not small:
        joined = joined.repartition("_block").sortWithinPartitions("_block", "segment", "i")
    k = len(model.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            block = Block(Rows.of(table), model, best)
            firsts = table.take(pa.array(block.first))
            before, post = (np.array([[np.nan] * k if x is None else x for x in firsts[c].to_pylist()]) for c in ("before", "post"))
            post = np.where(np.isnan(post), block.end, post)
            yield each(table, block, before, post, firsts["last"].fill_null(-1).to_numpy())

    return joined.mapInArrow(run, schema)


def _pre(block: Block, before: np.ndarray) -> np.ndarray:
    """The weights before each part: the start's, or one step from the row before."""
    return np.where(np.isnan(before), block.start, _sum(np.nan_to_num(before)[:, :, None] + block.step, 1, block.best))


def _columns(table: pa.Table, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([table["segment"].combine_chunks(), pa.array(table["i"].to_numpy(), pa.int64()), *more.values()], names=["segment", "i", *more])


def _floats(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))


def decode(observations: DataFrame, model: Model, method: str = "posterior") -> DataFrame:
    """segment, i and state of every observation: by posterior (the greatest of the probabilities p, an array by state,
    which come with it), or by viterbi, the likeliest path of the segment.

    Each method is one pass over the blocks; observations of one place are decoded each, in any order.
    """
    rows = sorted_blocks(observations)
    kind, names = dict(rows.dtypes)["segment"], pa.array(model.names)

    def posterior(table, block, before, post, last):
        log_p = block.forward(_pre(block, before)) + block.backward(post)
        p = np.exp(log_p - log_sum_exp(log_p, axis=1)[:, None])
        p /= p.sum(axis=1, keepdims=True)
        return _columns(table, state=names.take(pa.array(_last_best(p, 1))), p=_floats(p))

    def viterbi(table, block, before, post, last):
        v = block.forward(_pre(block, before))
        end = np.where(last >= 0, last, _last_best(v[block.last] + block.end, 1))
        return _columns(table, state=names.take(pa.array(block.path(v, end))))

    if method == "posterior":
        return _scan(rows, model, f"segment {kind}, i bigint, state string, p array<double>", posterior)
    return _scan(rows, model, f"segment {kind}, i bigint, state string", viterbi, best=True)


def log_odds(observations: DataFrame, model: Model) -> DataFrame:
    """segment, i, state and score: the logarithm of the likeliest state's odds against all others."""
    rows = sorted_blocks(observations)
    names = pa.array(model.names)

    def run(table, block, before, post, last):
        log_p = block.forward(_pre(block, before)) + block.backward(post)
        state, at = _last_best(log_p, 1), np.arange(len(log_p))
        others = log_p.copy()
        others[at, state] = -np.inf
        return _columns(table, state=names.take(pa.array(state)), score=pa.array(log_p[at, state] - log_sum_exp(others, axis=1)))

    return _scan(rows, model, f"segment {dict(rows.dtypes)['segment']}, i bigint, state string, score double", run)


def _moves(block: Block, before: np.ndarray, f: np.ndarray, b: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """Of each row, the probabilities of the transitions into it; 0 at the first of a segment."""
    earlier = np.empty_like(f)
    earlier[1:] = f[:-1]
    earlier[block.first] = np.where(np.isnan(before), -np.inf, before)
    total = log_sum_exp(f + b, axis=1) if total is None else total
    return np.exp(earlier[:, :, None] + block.step + (block.emit + b)[:, None, :] - total[:, None, None])


def transition_posteriors(observations: DataFrame, model: Model, source: str, target: str) -> DataFrame:
    """segment, i and the probability of the transition into i; 0 at the first of a segment."""
    a, c = model.names.index(source), model.names.index(target)
    rows = sorted_blocks(observations)

    def run(table, block, before, post, last):
        f, b = block.forward(_pre(block, before)), block.backward(post)
        return _columns(table, p=pa.array(_moves(block, before, f, b)[:, a, c]))

    return _scan(rows, model, f"segment {dict(rows.dtypes)['segment']}, i bigint, p double", run)


def log_likelihood(observations: DataFrame, model: Model) -> DataFrame:
    """segment and its log-likelihood."""
    parts = cut(_parts(sorted_blocks(observations), model))
    edges = _joints(parts, model).where(F.col("before").isNull())  # a segment's first part
    return parts.where(F.col("q").isNull()).select("segment", F.col("total").alias("log_likelihood")).unionByName(edges.select("segment", F.col("total").alias("log_likelihood")))


def packed(observations: DataFrame) -> tuple[DataFrame, int]:
    """A row for each block, for work that goes over them many times, and their number: _block, ends (the segments of the first
    part and, if there are several, of the last), n, and the arrays of Rows by kind."""
    rows = sorted_blocks(observations)
    arrays = {"first": "int", "sizes": "int", "code": "int", "k": "double", "m": "double", "u": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            own = Rows.of(table).by_kind()
            ends = table["segment"].combine_chunks().take(pa.array(own.first[[0] if len(own.first) == 1 else [0, -1]]))
            lists = [pa.array([getattr(own, c).astype(np.int32 if kind == "int" else float)]) for c, kind in arrays.items()]
            yield pa.RecordBatch.from_arrays([table["_block"][:1].combine_chunks(), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), ends), pa.array([own.n], pa.int32()), *lists], names=["_block", "ends", "n", *arrays])

    schema = f"_block bigint, ends array<{dict(rows.dtypes)['segment']}>, n int, " + ", ".join(f"{c} array<{kind}>" for c, kind in arrays.items())
    found = cut(rows.select("segment", "i", "k", "m", "u", "_block").mapInArrow(run, schema))
    blocks = found.count()
    return cut(found.repartition(_tasks(blocks), "_block")), blocks


def _tasks(blocks: int) -> int:
    return max(8, -(-blocks // TASK_BLOCKS))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Rows]]]:
    """Rows of packed(), as many as take a step at once, and the Rows of each."""
    for batch in batches:
        for a in range(0, batch.num_rows, STEP_BLOCKS):
            own = batch.slice(a, STEP_BLOCKS)
            arrays = [[x.values.to_numpy(zero_copy_only=False) for x in own[c]] for c in ("first", "sizes", "code", "k", "m", "u")]
            yield own, [Rows(*x) for x in zip(own["n"].to_pylist(), *arrays, strict=True)]


def _edges(rows: DataFrame, model: Model) -> DataFrame:
    """segment, _block and q as of _parts(), of packed() blocks: the parts at blocks' edges alone are worked out."""
    kind = dict(rows.dtypes)["ends"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, parts in _unpacked(batches):
            q = Block(Rows.joined([x.edges() for x in parts]), model, whole=True).whole()
            block = own["_block"].take(pa.compute.list_parent_indices(own["ends"]))
            yield pa.RecordBatch.from_arrays([own["ends"].flatten(), block, _floats(q.reshape(len(q), -1))], names=["segment", "_block", "q"])

    return rows.mapInArrow(run, f"segment {kind}, _block bigint, q array<double>")


def _round(rows: DataFrame, model: Model, blocks: int) -> dict:
    """Sums over all rows of packed(): log-likelihood, transitions, and for each replicate and state the posterior and its weighted logs."""
    k, families = len(model.names), [f for f, _ in model.replicates] if model.replicates else ["betabin"]
    size = 1 + k * k + 3 * k * len(families)
    edges = _edges(rows, model).repartition(_tasks(blocks), "segment")  # a number, as these few bytes would become one task
    joints = _joints(edges, model).groupBy(F.col("_block").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("segment", "before", "post"))).alias("joints"))  # two at most, in the order of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, parts in _unpacked(batches):
            block = Block(Rows.joined(parts), model)
            before, post = np.full((len(block.first), k), np.nan), np.tile(block.end, (len(block.first), 1))
            begin = np.cumsum([0, *[len(x.first) for x in parts]])
            for a, b, both in zip(begin, begin[1:], own["joints"].to_pylist(), strict=False):
                for at, joint in zip((a, b - 1), both, strict=False):
                    before[at], post[at] = np.nan if joint["before"] is None else joint["before"], joint["post"]
            yield pa.RecordBatch.from_arrays([pa.array([sums(block, before, post)], pa.list_(pa.float64()))], names=["sums"])

    def sums(block: Block, before: np.ndarray, post: np.ndarray) -> list[float]:
        f, b = block.forward(_pre(block, before)), block.backward(post)
        log_p = f + b
        top = log_sum_exp(log_p, axis=1)
        p = np.exp(log_p - top[:, None])
        begins = np.isnan(before[:, 0])
        found = [top[block.first][begins].sum(), *_moves(block, before, f, b, top).sum(axis=0).ravel()]
        kinds = block.rows
        weights = np.stack([np.bincount(kinds.code, p[block.owner, j], len(kinds.m)) for j in range(k)], axis=1)
        for r, family in enumerate(families):
            own = (kinds.m + kinds.u > 0) & ((kinds.k == r) if model.replicates else True)
            m, n = kinds.m[own], kinds.u[own] if family == "beta" else kinds.m[own] + kinds.u[own]
            share = np.clip(m / np.where(n > 0, n, 1), EDGE, 1 - EDGE)
            w = weights[own]
            found += [*w.sum(axis=0), *(w * np.log(share)[:, None]).sum(axis=0), *(w * np.log(1 - share)[:, None]).sum(axis=0)]
        return [float(x) for x in found]

    joined = rows.join(F.broadcast(joints) if blocks <= BROADCAST_BLOCKS else joints, F.col("_block") == F.col("_b")).drop("_b")
    s = np.array(joined.mapInArrow(run, "sums array<double>").agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(size)]).first(), float)
    logs = s[1 + k * k :].reshape(len(families), 3, k)
    return {"total": s[0], "moves": s[1 : 1 + k * k].reshape(k, k), "logs": logs}


def train(observations: DataFrame, model: Model, max_rounds: int = 10, tolerance: float = TOLERANCE, absolute: bool = False) -> tuple[Model, list[float]]:
    """The trained model and the log-likelihood of each round. absolute: any change counts, not growth alone."""
    rows, blocks = packed(observations)
    history = []
    for _ in range(max_rounds):
        s = _round(rows, model, blocks)
        history.append(float(s["total"]))
        moves = s["moves"] / s["moves"].sum(axis=1, keepdims=True)
        if model.end is not None:
            moves = np.maximum(moves - np.array(model.end)[:, None] / len(model.names), LEAST_RATE)
        fits = [tuple(tuple(fit_beta(a / w, b / w)) for w, a, b in zip(*logs, strict=True)) for logs in s["logs"]]
        old = np.array(model.transitions)
        off = ~np.eye(len(old), dtype=bool)
        change = (moves - old) / np.maximum(np.maximum(np.abs(moves), np.abs(old)), 1e-300)
        settled = ((np.abs(change) if absolute else change)[off] < tolerance).all()
        if settled:
            break
        start = model.start
        if len(old) == 2 and model.end is None:
            start = (moves[1, 0] / (moves[0, 1] + moves[1, 0]), moves[0, 1] / (moves[0, 1] + moves[1, 0]))
        elif model.end is not None:
            start = moves.mean(axis=0)
        emits = {"shapes": fits[0]} if model.replicates is None else {"replicates": tuple((f, x) for (f, _), x in zip(model.replicates, fits, strict=True))}
        model = replace(model, transitions=tuple(map(tuple, moves.tolist())), start=tuple(map(float, start)), **emits)
    return model, history


def prefix_likelihood(observations: DataFrame, model: Model) -> DataFrame:
    """segment, i and the running sum of each state's log-likelihoods; differences give that of any stretch."""
    rows = sorted_blocks(observations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            yield pa.RecordBatch.from_arrays([table["segment"].combine_chunks(), pa.array(table["i"].to_numpy(), pa.int64()), table["_block"].combine_chunks(), _floats(Block(Rows.of(table), model).emit)], names=["segment", "i", "_block", "emit"])

    emit = rows.select("segment", "i", "k", "m", "u", "_block").mapInArrow(run, f"segment {dict(rows.dtypes)['segment']}, i bigint, _block bigint, emit array<double>")
    own = [F.get("emit", F.lit(k)) for k in range(len(model.names))]
    before = with_before(emit, ["segment"], "_block", [F.col("i")], **{f"_{k}": ("sum", x) for k, x in enumerate(own)})
    return before.select("segment", "i", *[(F.coalesce(F.col(f"_{k}"), F.lit(0.0)) + own[k]).alias(n) for k, n in enumerate(model.names)])
