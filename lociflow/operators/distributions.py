"""Distributions: log-likelihoods as columns, and maximum-likelihood fits from sums that Spark makes in one pass.

Fits take a value column and optional weights; only sums, or the counts of distinct discrete values within their range,
come to the driver, where equations without a closed form are solved.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..checkpoints import cut
from ..functions.special import digamma, inverse_digamma, trigamma
from ..functions.special import lgamma as special_lgamma
from .ordered import numbered

#: Names of the families and how many parameters each has.
FAMILIES = {"exp": 1, "gamma": 2, "pois": 1, "nbd": 2, "geo": 1, "beta": 2, "binom": 2, "emp": 0, "discemp": 0}
FLOOR = -40.0


@F.pandas_udf(T.DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    """ln of gamma; null for null, and for values that aren't positive."""
    v = x.to_numpy(dtype=float)
    return pd.Series(np.where(v > 0, special_lgamma(np.where(v > 0, v, 1.0)), np.nan)).astype("Float64")


@dataclass(frozen=True)
class Empirical:
    """A fitted histogram: breaks (one more than bins) and the log density of each bin."""

    breaks: tuple[float, ...]
    log_density: tuple[float, ...]

    def bin(self, x: Column) -> Column:
        """The last bin whose break isn't above x; the greatest value's bin is the last one. Breaks are multiples of the
        second one, so that a division finds the bin, and its neighbours where rounding moved it over a break."""
        size, last = self.breaks[1], len(self.log_density) - 1
        near = F.floor(x / size)
        found = F.when(near * size > x, near - 1).when((near + 1) * size <= x, near + 1).otherwise(near)
        return F.least(found, F.lit(last)).cast("int")

    def log_likelihood(self, x: Column) -> Column:
        """Null below the first break."""
        return F.when(x >= self.breaks[0], F.get(F.array(*[F.lit(float(v)) for v in self.log_density]), self.bin(x)))


def log_likelihood(family: str, x: Column, params: list[float] | Empirical) -> Column:
    """Of a value under a family; params are an Empirical for the two empirical families."""
    if family in ("emp", "discemp") and isinstance(params, Empirical):
        return params.log_likelihood(x)
    if family not in FAMILIES or len(params) != FAMILIES[family]:
        raise ValueError(f"{family} with {len(params)} parameters")
    p = params
    if family == "exp":
        return -math.log(p[0]) - x / p[0]
    if family == "gamma":
        return (p[0] - 1) * F.ln(x) - x / p[1] - p[0] * math.log(p[1]) - math.lgamma(p[0])
    if family == "pois":
        return x * math.log(p[0]) - p[0] - lgamma(x + 1)
    if family == "nbd":
        mu, alpha = p
        n = 1 / alpha
        ll = lgamma(x + n) - lgamma(x + 1) - math.lgamma(n) + n * math.log(n / (n + mu)) + x * math.log(mu / (n + mu))
        return F.when(F.isnan(ll) | ll.isNull() | (F.abs(ll) == float("inf")), FLOOR).otherwise(ll)
    if family == "geo":
        return math.log(p[0]) + x * math.log(1 - p[0])
    if family == "beta":
        return (p[0] - 1) * F.ln(x) + (p[1] - 1) * F.ln(1 - x) + math.lgamma(p[0] + p[1]) - math.lgamma(p[0]) - math.lgamma(p[1])
    if family != "binom":
        raise ValueError(f"{family} is given by fit()")
    n, q = p
    return math.lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * math.log(q) + (n - x) * math.log(1 - q)


def scaled_log_likelihood(family: str, x: Column, scale: Column, params: list[float] | Empirical) -> Column:
    """Of a value whose scale parameter (exp, gamma), mean (pois, nbd) or unit (emp, discemp) is multiplied by a column."""
    if family in ("emp", "discemp"):
        return log_likelihood(family, x / scale, params)
    if family == "exp":
        return -F.ln(params[0] * scale) - x / params[0] / scale
    if family == "gamma":
        return log_likelihood(family, x / scale, params) - F.ln(scale)
    if family == "pois":
        return x * F.ln(params[0] * scale) - params[0] * scale - lgamma(x + 1)
    if family == "nbd":
        n, mean = 1 / params[1], params[0] * scale
        ll = lgamma(x + n) - lgamma(x + 1) - math.lgamma(n) + n * F.ln(n / (n + mean)) + x * F.ln(mean / (n + mean))
        return F.when(F.isnan(ll) | ll.isNull() | (F.abs(ll) == float("inf")), FLOOR).otherwise(ll)
    raise ValueError(f"{family} has no scale")


def fit_scaled(df: DataFrame, family: str, value: str, scale: str, weight: str | None = None) -> list[float] | Empirical:
    """The fit of values divided by their scales."""
    return fit(df.withColumn(value, F.col(value) / F.col(scale)), family, value, weight)


def total_log_likelihood(df: DataFrame, family: str, value: str, params: list[float]) -> DataFrame:
    return df.agg(F.sum(log_likelihood(family, F.col(value), params)).alias("log_likelihood"))


def density(family: str, x: Column, params: list[float]) -> Column:
    return F.exp(log_likelihood(family, x, params))


def moments(df: DataFrame, value: str, weight: str | None = None) -> dict:
    """n, sums of w, wx, w ln x, w ln(1 - x), wx^2 over the rows."""
    x, w = F.col(value).cast("double"), F.col(weight) if weight else F.lit(1.0)
    safe = F.greatest(x, F.lit(1e-10))
    other = F.greatest(1 - x, F.lit(1e-10))
    return df.agg(F.count(x).alias("n"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"), F.sum(w * F.ln(safe)).alias("wlog"), F.sum(w * F.ln(other)).alias("wlog1")).first().asDict()


def fit(df: DataFrame, family: str, value: str, weight: str | None = None, n: float | None = None) -> list[float] | Empirical:
    """Parameters of most likelihood; an Empirical for emp and discemp."""
    if family == "nbd":
        return fit_negative_binomial(df, value, weight)
    if family in ("emp", "discemp"):
        return fit_empirical(df, value, weight, discrete=family == "discemp")
    s = moments(df, value, weight)
    if not s["n"]:
        raise ValueError("no values")
    mean = s["wx"] / s["w"]
    if family in ("exp", "pois"):
        return [mean]
    if family == "geo":
        return [1 / (1 + mean)]
    if family == "binom":
        return [float(n), mean / n]
    if family == "gamma":
        gap = math.log(mean) - s["wlog"] / s["w"]
        k = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
        for _ in range(50):
            k -= (math.log(k) - float(digamma(k)) - gap) / (1 / k - float(trigamma(k)))
        return [k, mean / k]
    if family == "beta":
        return fit_beta(s["wlog"] / s["w"], s["wlog1"] / s["w"])
    raise ValueError(family)


def fit_beta(mean_log: float, mean_log1: float) -> list[float]:
    """The solution of digamma(a) - digamma(a + b) = mean ln x, and the same for b: fixed-point steps from 0.01, then Newton's."""
    a = b = 0.01
    for _ in range(30):
        total = digamma(a + b)
        a, b = float(inverse_digamma(total + mean_log)), float(inverse_digamma(total + mean_log1))
    for _ in range(100):
        x, t = np.array([a, b]), trigamma(np.array([a, b, a + b]))
        miss = digamma(x) - digamma(a + b) - np.array([mean_log, mean_log1])
        step = np.linalg.solve(np.diag(t[:2]) - t[2], miss)
        x = np.where(step < x, x - step, x / 2)
        moved = float(np.max(np.abs(x - [a, b]) / x))
        a, b = map(float, x)
        if moved < 1e-12:
            break
    return [a, b]


def fit_negative_binomial(df: DataFrame, value: str, weight: str | None = None, grid: int = 64, rounds: int = 7) -> list[float]:
    """Mean and dispersion; the dispersion where the score over the counts of values changes its sign.

    Each round is a job that sums the score for a grid of dispersions, between the two that held the change before.
    """
    x, w = F.col(value).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    counts = cut(df.where(x.isNotNull()).groupBy(x.alias("x")).agg(F.sum(w).alias("w")))
    total, mu = counts.agg(F.sum("w"), F.sum(F.col("x") * F.col("w")) / F.sum("w")).first()
    if total is None:
        raise ValueError("no values")
    low, high = math.log(1e-6), math.log(1e6)
    for _ in range(rounds):
        points = np.linspace(low, high, grid)
        n = np.exp(-points)

        def scores(batches, n=n):
            for batch in batches:
                x, w = (batch.column(i).to_numpy() for i in (0, 1))
                yield pa.RecordBatch.from_pydict({"s": [[float((w * (digamma(x + v) - digamma(v))).sum()) for v in n]]}, schema=pa.schema([("s", pa.list_(pa.float64()))]))

        sums = counts.select("x", "w").mapInArrow(scores, "s array<double>").agg(*[F.sum(F.get("s", F.lit(i))) for i in range(grid)]).first()
        score = np.array(sums, float) / total - np.log1p(np.exp(points) * mu)
        below = np.flatnonzero(score <= 0)  # it grows with the dispersion where the values are over-dispersed
        at = int(below[-1]) if len(below) else 0
        low, high = points[at], points[min(at + 1, grid - 1)]
    return [float(mu), math.exp((low + high) / 2)]


def beta_binomial_log_pmf(k: Column, n: Column, a: float, b: float) -> Column:
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(k + a) + lgamma(n - k + b) - lgamma(n + F.lit(a + b)) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))


def weighted_sd(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Weighted sums divided by the number of rows."""
    x, w = F.col(value), F.col(weight)
    n = F.count(F.lit(1))
    return df.agg(F.sqrt(F.sum(w * x * x) / n - F.pow(F.sum(w * x) / n, 2)).alias("sd"))


def class_count(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.least(F.floor(F.sqrt(F.count(F.lit(1)))), F.floor(F.max(value)) + 1).cast("bigint").alias("classes"))


def histogram(df: DataFrame, value: str, breaks: list[float], weight: str | None = None) -> DataFrame:
    """bin, low and n for ascending breaks: a value counts in the last bin whose break isn't above it."""
    edges = F.array(*[F.lit(float(b)) for b in breaks])
    found = F.size(F.filter(edges, lambda b: b <= F.col(value))) - 1
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(found.alias("bin")).agg(n.alias("n")).where(F.col("bin") >= 0).withColumn("low", F.get(edges, F.col("bin")))


def equal_count_breaks(df: DataFrame, value: str, classes: int) -> list[float]:
    """The values at equal distances of their order; values are numbered by ranges, and classes + 1 of them come back."""
    placed = numbered(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x")), ["x"], "n")
    last = placed.count() - 1
    return sorted({r.x for r in placed.where(F.col("n").isin([i * last // classes for i in range(classes + 1)])).collect()})


def equal_span_breaks(df: DataFrame, value: str, classes: int) -> list[float]:
    low, high = df.agg(F.min(value), F.max(value)).first()
    return [low + (high - low) * i / classes for i in range(classes + 1)]


#: The least share of a bin, and the smoothing width of discrete values without and with weights.
LEAST_SHARE = 1e-10
DISCRETE_WIDTH, WEIGHTED_WIDTH = 3.0, 1.5


def fit_empirical(df: DataFrame, value: str, weight: str | None = None, discrete: bool = False) -> Empirical:
    """A histogram of equal bins from 0 to the greatest value, smoothed by local lines, its shares no less than LEAST_SHARE.

    As many bins as class_count() says, smoothed over the (weighted) standard deviation; discrete values have a bin each
    and fixed widths. One job gives the sizes and one the counts; a row for each bin comes to the driver, whose number
    grows with the greatest value of discrete ones and at most with the root of the rows otherwise.
    """
    x, w = F.col(value).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    n = F.count(x)
    wide = F.sqrt(F.sum(w * x * x) / n - F.pow(F.sum(w * x) / n, 2)) if weight else F.stddev_samp(x)
    rows, top, sd = df.agg(n, F.max(x), wide).first()
    if not rows:
        raise ValueError("no values")
    classes = int(top) + 1 if discrete else max(1, int(min(math.sqrt(rows), top + 1)))
    size = 1.0 if discrete else top / classes or 1.0
    at = F.least(F.floor(x / size), F.lit(classes - 1)).cast("int")
    counted = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.sum(w).alias("n")).where(F.col("bin") >= 0).collect()
    hist = np.zeros(classes)
    for r in counted:
        hist[r.bin] = r.n
    mids = np.arange(classes) * size + (0 if discrete else size / 2)
    smooth = smoothed(mids, hist, (WEIGHTED_WIDTH if weight else DISCRETE_WIDTH) if discrete else sd)
    share = np.maximum(smooth / smooth.sum(), LEAST_SHARE)
    return Empirical(tuple(np.arange(classes + 1) * size), tuple(np.maximum(np.log(share) - math.log(size), math.log(LEAST_SHARE))))


def smoothed(x: np.ndarray, y: np.ndarray, bandwidth: float) -> np.ndarray:
    """Local lines through ascending points at the points themselves, by the kernel of smoothing.local_linear()."""
    if not bandwidth > 0:
        return y
    found = np.empty(len(x))
    for i, t in enumerate(x):
        a, b = np.searchsorted(x, [t - bandwidth, t + bandwidth])
        d = x[a:b] - t
        w = 0.75 * (1 - (d / bandwidth) ** 2)
        s0, s1, s2, t0, t1 = w.sum(), (w * d).sum(), (w * d * d).sum(), (w * y[a:b]).sum(), (w * d * y[a:b]).sum()
        det = s0 * s2 - s1 * s1
        found[i] = (s2 * t0 - s1 * t1) / det if abs(det) > 1e-12 else t0 / s0
    return found
