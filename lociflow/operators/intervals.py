"""Genomic intervals (chrom, start, end, ...), half open, as joins and groups of DataFrames.

Joins deal both sides to bins of BIN bases that an interval touches and compare within a bin; a pair is told once, in
the bin where the later of the two begins. Islands (collapse, merge) come from running maxima over blocks of positions,
so a chromosome isn't one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from .ordered import with_before

BIN = 1 << 14
BLOCK = 1 << 22
#: The table of chroms is broadcast up to so many rows.
BROADCAST_CHROMS = 500_000


def _block(size: int = BLOCK) -> Column:
    return F.floor(F.col("start") / size)


def islands(df: DataFrame, gap: int = 0, order: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Adds island, the number within its chrom of the group of intervals joined by end + gap >= next start.

    Intervals are taken by (start, end, further order columns), ends as the greatest so far.
    """
    by = [F.col(c) for c in ("start", "end", *order)]
    rows = df.withColumn("_block", _block(block))
    ends = with_before(rows, ["chrom"], "_block", by, _end=("max", F.col("end")))
    marked = ends.withColumn("_new", F.when(F.col("_end").isNull() | (F.col("_end") + gap < F.col("start")), 1).otherwise(0)).drop("_end")
    numbered = with_before(marked, ["chrom"], "_block", by, _n=("sum", F.col("_new")))
    return numbered.withColumn("island", F.coalesce("_n", F.lit(0)) + F.col("_new")).drop("_n", "_new", "_block")


def _joined(df: DataFrame, first: list[str], order: list[str], score: bool, total_end: Column | None = None) -> DataFrame:
    head = F.min_by(F.struct(*first), F.struct("start", "end", *order)).alias("_first") if first else None
    aggs = [F.min("start").alias("start"), F.max("end").alias("end"), *([F.min("score").alias("score")] if score else []), *([head] if first else [])]
    out = df.groupBy("chrom", "island").agg(*aggs)
    return out.select("chrom", "start", "end", *([F.col(f"_first.{c}").alias(c) for c in first]), *(["score"] if score else []))


def collapse(hits: DataFrame, keep: tuple[str, ...] = ("name",), order: tuple[str, ...] = ("name",)) -> DataFrame:
    """Windows in CpG space (both ends inclusive) that touch or overlap, as one: the least score, the first one's other columns."""
    return _joined(islands(hits, 1, order), list(keep), list(order), score=True)


def merge_by_gap(regions: DataFrame, gap: int, keep: tuple[str, ...] = ("name",), order: tuple[str, ...] = ("name",)) -> DataFrame:
    """Regions no more than gap bases apart, as one."""
    return _joined(islands(regions, gap, order), list(keep), list(order), score=True)


def union_intervals(regions: DataFrame, keep: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """Overlapping or touching intervals as one, with the other columns of the first."""
    return _joined(islands(regions, 0, order), list(keep), list(order), score=False)


def _binned(df: DataFrame, size: int) -> DataFrame:
    last = F.greatest(F.col("end") - 1, F.col("start"))
    return df.withColumn("_bin", F.explode_outer(F.sequence(F.floor(F.col("start") / size), F.floor(last / size))))


def overlap_join(a: DataFrame, b: DataFrame, size: int = BIN, how: str = "overlap") -> DataFrame:
    """All pairs of overlapping intervals: a's columns, and b's with b_ before them. how="start": b begins within a."""
    right = _binned(b, size) if how == "overlap" else b.withColumn("_bin", F.floor(F.col("start") / size))
    right = right.select(*[F.col(c).alias(c if c == "_bin" else f"b_{c}") for c in right.columns])
    pairs = _binned(a, size).join(right, "_bin").where(F.col("chrom") == F.col("b_chrom"))
    if how == "start":
        return pairs.where((F.col("b_start") >= F.col("start")) & (F.col("b_start") < F.col("end"))).drop("_bin")
    meet = (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    return pairs.where(meet & (F.col("_bin") == F.floor(F.greatest("start", "b_start") / size))).drop("_bin")


def intersect_by_base(a: DataFrame, b: DataFrame, size: int = BIN) -> DataFrame:
    """The bases that each overlapping pair shares."""
    return overlap_join(a, b, size).select("chrom", F.greatest("start", "b_start").alias("start"), F.least("end", "b_end").alias("end"))


def _of_chroms(df: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of df whose chrom the other table has: no row of another one can meet."""
    chroms = cut(other.select(F.col("chrom").alias("_chrom")).distinct())
    known = F.broadcast(chroms) if chroms.count() <= BROADCAST_CHROMS else chroms
    return df.join(known, F.col("chrom").eqNullSafe(F.col("_chrom")), "left_semi")


def sweep(a: DataFrame, b: DataFrame, by: str = "start", order: tuple[tuple[str, ...], tuple[str, ...]] = ((), ()), block: int = BLOCK) -> DataFrame:
    """The pairs that one pass over both sorted lists compares, where they overlap: a's columns in a, b's in b (structs).

    The pass drops the lesser of the two foremost regions, by start or by end, and b's of equal ones. A region is so
    compared with the foremost of the other list at its turn, which is the next one of that list in the merged order: a
    running value from the far end, over blocks; chroms that only one list has are left out before. Of nested regions that are fewer pairs than overlap_join() has. By end,
    a region takes its turn by the greatest end so far in its list, as those before it hold it up. order: columns that
    decide between equal regions of a and of b.
    """
    strand = ["strand"] if "strand" in a.columns and "strand" in b.columns else []
    a, b = _of_chroms(a, b), _of_chroms(b, a)
    sides = []
    for side, (df, ties) in enumerate(((b, order[1]), (a, order[0]))):
        place = F.struct("start", "end", *strand)
        other = [F.lit(None).cast(x.select(F.struct(*x.columns).alias("x")).schema["x"].dataType).alias(n) for n, x in (("_b", b), ("_a", a))]
        other[side] = F.struct(*df.columns).alias("_a" if side else "_b")
        tie = [F.lit(None).cast(x.select(F.struct(F.lit(0).alias("_0"), *t).alias("x")).schema["x"].dataType).alias(f"_tie{i}") for i, (x, t) in enumerate(((b, order[1]), (a, order[0])))]
        tie[side] = F.struct(F.lit(0).alias("_0"), *ties).alias(f"_tie{side}")
        sides.append(df.select("chrom", "start", "end", place.alias("_place"), F.struct("end", "start", *strand).alias("_turn"), F.lit(side).alias("_side"), *tie, *other))
    rows = sides[0].unionByName(sides[1]).withColumn("_block", _block(block))
    if by == "end":
        far = with_before(rows, ["chrom", "_side"], "_block", [F.col("_place"), F.col("_tie0"), F.col("_tie1")], _far=("max", F.col("_turn")))
        rows = far.withColumn("_turn", F.greatest("_turn", "_far")).withColumn("_block", F.floor(F.col("_turn.end") / block))
    else:
        rows = rows.withColumn("_turn", F.col("_place"))
    rank = F.struct("_turn", "_side", "_place", "_tie0", "_tie1")
    following = [F.when(F.col("_side") == side, F.struct(rank.alias("rank"), F.col(name).alias("own"))) for side, name in ((0, "_b"), (1, "_a"))]
    back = rows.withColumn("_back", -F.col("_block")).withColumn("_rank", rank)
    met = with_before(back, ["chrom"], "_back", [F.col("_rank").desc()], _next_b=("min", following[0]), _next_a=("min", following[1]))
    pairs = met.select(F.coalesce("_a", F.col("_next_a.own")).alias("a"), F.coalesce("_b", F.col("_next_b.own")).alias("b"))
    return pairs.where(overlaps(F.col("a"), F.col("b")))


def sweep_intersection(a: DataFrame, b: DataFrame, order: tuple[tuple[str, ...], tuple[str, ...]] = ((), ()), block: int = BLOCK) -> DataFrame:
    """The regions of b that overlap, told once for each step of the sweep by start at which they do."""
    return sweep(a, b, "start", order, block).select("b.*")


def sweep_by_base(a: DataFrame, b: DataFrame, order: tuple[tuple[str, ...], tuple[str, ...]] = ((), ()), block: int = BLOCK) -> DataFrame:
    """chrom, start and end of what is shared at each step of the sweep by end."""
    return sweep(a, b, "end", order, block).select("a.chrom", F.greatest("a.start", "b.start").alias("start"), F.least("a.end", "b.end").alias("end"))


def assign_by_start(regions: DataFrame, big: DataFrame, size: int = BIN, order: tuple[str, ...] = (), how: str = "start") -> DataFrame:
    """Each region with the first big region (big_ columns) that its start falls into, or with how="overlap" that it meets."""
    own = regions.columns
    counted = regions.groupBy(*own).agg(F.count(F.lit(1)).cast("int").alias("_copies"))  # equal regions are found once and told as often as they come
    pairs = overlap_join(big, counted, size, how)
    picked = pairs.groupBy(*[f"b_{c}" for c in own], "b__copies").agg(F.min_by(F.struct(*big.columns), F.struct("start", "end", *order)).alias("_big"))
    copies = picked.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("b__copies"))))
    return copies.select(*[F.col(f"b_{c}").alias(c) for c in own], *[F.col(f"_big.{c}").alias(f"big_{c}") for c in big.columns])


def nearest(a: DataFrame, b: DataFrame, order: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Each a with the nearest b (near_ columns), looking at the b before and the b after it by (start, end); ties go to the one before."""
    b = _of_chroms(b, a)
    own, other = a.columns, b.columns
    left = a.select("chrom", "start", "end", F.lit(1).alias("_side"), F.struct(*own).alias("_a"), F.lit(None).cast(b.select(F.struct(*other).alias("x")).schema["x"].dataType).alias("_b"))
    right = b.select("chrom", "start", "end", F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_a"].dataType).alias("_a"), F.struct(*other).alias("_b"))
    rows = left.unionByName(right).withColumn("_block", _block(block)).withColumn("_back", -F.col("_block"))
    key = F.when(F.col("_side") == 0, F.struct("start", "end", "_b"))
    tie = [F.to_json("_a"), F.to_json("_b")]
    ahead = with_before(rows, ["chrom"], "_block", [F.col("start"), F.col("end"), F.col("_side").desc(), *tie], _prev=("max", key))
    both = with_before(ahead, ["chrom"], "_back", [F.col("start").desc(), F.col("end").desc(), F.col("_side").asc(), *tie], _next=("min", key))
    gap = lambda s, e: F.when((F.col("start") < e) & (s < F.col("end")), 0).otherwise(F.greatest(s - F.col("end"), F.col("start") - e) + 1)
    before, after = gap(F.col("_prev.start"), F.col("_prev.end")), gap(F.col("_next.start"), F.col("_next.end"))
    near = F.when(F.col("_prev").isNull(), F.col("_next")).when(F.col("_next").isNull() | (before <= after), F.col("_prev")).otherwise(F.col("_next"))
    return both.where(F.col("_side") == 1).withColumn("_near", near["_b"]).select(*[F.col(f"_a.{c}").alias(c) for c in own], *[F.col(f"_near.{c}").alias(f"near_{c}") for c in other])


def extend_to_clusters(clusters: DataFrame, members: DataFrame, on: str = "name") -> DataFrame:
    """Each name's least start and greatest end over both tables."""
    both = clusters.select(on, "chrom", "start", "end").unionByName(members.select(on, "chrom", "start", "end"))
    return both.groupBy(on, "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def align_chroms(stable: DataFrame, other: DataFrame) -> DataFrame:
    """Each chrom of stable with other's rows of it, or nulls; chroms of other alone go."""
    return stable.select("chrom").distinct().join(other, "chrom", "left")


def check_sorted(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row: whether the rows, in the order of line_no, ascend by (chrom, start, end, strand)."""
    key = F.struct("chrom", "start", "end", "strand")
    rows = with_before(df.withColumn("_block", F.shiftright("line_no", 20)), [], "_block", [F.col("line_no")], _last=("lag", key))
    return rows.agg(F.coalesce(F.bool_and(F.col("_last").isNull() | (F.col("_last") <= key)), F.lit(True)).alias("sorted"))


def relative_order(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with lookup, the index of each one's name in names (index, name; of equal names the last); a name without one
    fails the query."""
    known = names.groupBy("name").agg(F.max("index").alias("lookup"))
    missing = F.raise_error(F.concat(F.lit("not found: "), F.coalesce("name", F.lit("")))).cast("bigint")
    return rows.join(known, "name", "left").select(*rows.columns, F.coalesce(F.col("lookup").cast("bigint"), missing).alias("lookup"))


def width(a: Column) -> Column:
    return a["end"] - a["start"]


def same_chrom(a: Column, b: Column) -> Column:
    return a["chrom"] == b["chrom"]


def contains(a: Column, b: Column) -> Column:
    """Whether region a (a struct of chrom, start, end) has all of b."""
    return same_chrom(a, b) & (a["start"] <= b["start"]) & (b["end"] <= a["end"])


def overlaps(a: Column, b: Column) -> Column:
    """Whether they share a base; an empty region overlaps what it lies in, its start included."""
    ends, begins = (a["start"] < b["end"]) & (b["end"] <= a["end"]), (a["start"] <= b["start"]) & (b["start"] < a["end"])
    return same_chrom(a, b) & (ends | begins | contains(b, a))


def distance(a: Column, b: Column) -> Column:
    """0 where they overlap, else the bases between them and one; null on different chromosomes."""
    apart = F.greatest(b["start"] - a["end"], a["start"] - b["end"]) + 1
    return F.when(same_chrom(a, b), F.when(overlaps(a, b) | overlaps(b, a), F.lit(0).cast("bigint")).otherwise(apart))


def site_distance(a: Column, b: Column) -> Column:
    """Bases between two sites (structs of chrom and pos); null on different chromosomes."""
    return F.when(same_chrom(a, b), F.abs(a["pos"] - b["pos"]))


def intersection(a: Column, b: Column) -> Column:
    """struct(chrom, start, end) of what two regions share; 0 and 0 where they don't overlap."""
    shared = F.struct(a["chrom"].alias("chrom"), F.greatest(a["start"], b["start"]).alias("start"), F.least(a["end"], b["end"]).alias("end"))
    return F.when(overlaps(a, b), shared).otherwise(F.struct(a["chrom"].alias("chrom"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end")))


def start_order(a: Column) -> Column:
    """What regions are compared by."""
    return F.struct(a["chrom"], a["start"], a["end"], a["strand"])


def end_order(a: Column) -> Column:
    """The order by ends first."""
    return F.struct(a["chrom"], a["end"], a["start"], a["strand"])
