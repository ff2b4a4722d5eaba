"""Kernel smoothing and local linear regression of a series (key, x, y) by running moments.

The Epanechnikov weight is a polynomial of x, so the weighted sums around a target are differences of running sums of
powers of x and of y times powers of x. These run over stretches of one bandwidth, with x measured from a stretch's centre
in bandwidths, so that sums stay small; a target looks them up at four places: before and at the end of the stretch before
its own, at the end of its own, and within the next one. Stretches of many points are cut into blocks. The work follows the
points, whatever the bandwidth and the depth.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered, with_before

#: Points of a block of a stretch, about.
BLOCK_ROWS = 50_000
#: A line is fitted where the points' variance is above this share of the squared bandwidth.
LEAST_SPREAD = 1e-13


def _sums(points: DataFrame, targets: DataFrame, bandwidth: float, key: str, degree: int) -> DataFrame:
    """key, x, and for k up to degree s<k> and t<k>: sums of w d^k and of w d^k y over the points from bandwidth before x up to
    bandwidth after it; d is the distance in bandwidths, w its weight. Rows without x are left out; y may be null."""
    h = float(bandwidth)
    points, targets = points.where(F.col("x").isNotNull()), targets.where(F.col("x").isNotNull()).select(key, "x").distinct()
    own = F.floor(F.col("x") / h)
    deepest = points.groupBy(key, own).count().agg(F.max("count")).first()[0] or 1
    blocks = math.ceil(deepest / BLOCK_ROWS)
    powers = range(degree + 3)
    at = points.select(key, own.alias("_stretch"), F.col("x").cast("double").alias("_at"), F.lit(None).cast("double").alias("x"), F.lit(0).alias("_sign"), F.lit(1).alias("_one"), F.col("y").cast("double").alias("_y"))
    end = F.lit(math.inf)
    places = [(own - 1, F.col("x") - h, -1), (own - 1, end, 1), (own, end, 1), (own + 1, F.col("x") + h, 1)]
    asked = targets.withColumn("p", F.explode(F.array(*[F.struct(s.alias("s"), a.cast("double").alias("a"), F.lit(sign).alias("sign")) for s, a, sign in places])))
    asked = asked.select(key, F.col("p.s").alias("_stretch"), F.col("p.a").alias("_at"), F.col("x").cast("double").alias("x"), F.col("p.sign").alias("_sign"), F.lit(0).alias("_one"), F.lit(None).cast("double").alias("_y"))
    centre = (F.col("_stretch") + 0.5) * h
    u = (F.col("_at") - centre) / h
    power = lambda v, k: F.lit(1.0) if k == 0 else F.pow(v, F.lit(float(k)))
    inside = F.when(F.col("_at") == math.inf, blocks - 1).otherwise(F.least(F.lit(blocks - 1), F.greatest(F.lit(0), F.floor((u + 0.5) * blocks)))).cast("int")
    point = lambda value: F.when(F.col("_one") == 1, value)
    moments = {f"_m{k}": ("sum", point(power(u, k))) for k in powers} | {f"_n{k}": ("sum", point(power(u, k) * F.col("_y"))) for k in powers}
    found = with_before(at.unionByName(asked).withColumn("_block", inside), [key, "_stretch"], "_block", [F.col("_at"), F.col("_one")], **moments).where(F.col("_one") == 0)
    shift = (centre - F.col("x")) / h

    def around(name: str, k: int) -> Column:
        """The moment of a power of the distance from x."""
        return sum((math.comb(k, j) * power(shift, k - j) * F.coalesce(F.col(f"_{name}{j}"), F.lit(0.0)) for j in range(k + 1)), F.lit(0.0))

    weighted = lambda name, k: F.sum(F.col("_sign") * 0.75 * (around(name, k) - around(name, k + 2)))
    return found.groupBy(key, "x").agg(*[weighted("m", k).alias(f"s{k}") for k in range(degree + 1)], *[weighted("n", k).alias(f"t{k}") for k in range(degree + 1)])


def kernel_smooth(points: DataFrame, bandwidth: float, key: str = "key", targets: DataFrame | None = None) -> DataFrame:
    """key, x and the Epanechnikov mean of y around x."""
    return _sums(points, points if targets is None else targets, bandwidth, key, 0).where(F.col("s0") > LEAST_SPREAD).select(key, "x", (F.col("t0") / F.col("s0")).alias("y"))


def kernel_smooth_by_rank(points: DataFrame, bandwidth: float, key: str = "key") -> DataFrame:
    """The same on the index of each point in its key's order of x; points are numbered over all keys, by ranges."""
    placed = numbered(points.select(key, "x", "y"), [key, "x", "y"], "_n")
    first = placed.groupBy(F.col(key).alias("_k")).agg(F.min("_n").alias("_first"))
    ranked = placed.join(first, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_i", (F.col("_n") - F.col("_first")).cast("double"))
    targets = ranked.select(key, "_i", F.col("x").alias("_own"))
    smooth = kernel_smooth(ranked.select(key, F.col("_i").alias("x"), "y"), bandwidth, key).withColumnRenamed(key, "_k")
    return targets.join(smooth, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_i") == F.col("x"))).select(key, F.col("_own").alias("x"), "y")


def local_linear(points: DataFrame, bandwidth: float, key: str = "key", targets: DataFrame | None = None) -> DataFrame:
    """key, x and the value at x of a line fitted to the points around it; their mean where they lie at one place."""
    sums = _sums(points, points if targets is None else targets, bandwidth, key, 2).where(F.col("s0") > LEAST_SPREAD)
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det
    return sums.select(key, "x", F.when(det > LEAST_SPREAD * F.col("s0") * F.col("s0"), line).otherwise(F.col("t0") / F.col("s0")).alias("y"))
