"""Running values over ordered rows without one task for a whole order.

The rows of a key are cut into blocks of their order. A window within each block gives the local part of a running
value, and a table with a row for each block gives what comes before it. A chromosome or file of any length is so
shared among as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import cut

_TOGETHER = {"sum": F.sum, "max": F.max, "min": F.min}


def with_before(df: DataFrame, keys: list[str], block: str, order: list[Column], **values: tuple[str, Column]) -> DataFrame:
    """Adds, for each name=(kind, column), the value over all rows before a row: kind is sum, max, min or lag.

    keys and block are columns; blocks ascend with the order, in which rows have no ties. Null where no row is before.
    """
    df = cut(df)  # it is read twice here, and steps of this kind stand on each other
    within = W.partitionBy(*keys, block).orderBy(*order)
    before = within.rowsBetween(W.unboundedPreceding, -1)
    blocks_before = W.partitionBy(*keys).orderBy(block) if keys else W.partitionBy(F.lit(0)).orderBy(block)
    local, whole, ahead = [], [], []
    for name, (kind, value) in values.items():
        if kind == "lag":
            boxed = F.struct(value.alias("x"))  # so that a null value is not taken for no row
            local.append(F.lag(boxed).over(within).alias(f"_{name}_here"))
            whole.append(F.max_by(boxed, F.struct(*order)).alias(f"_{name}_all"))
            ahead.append(F.lag(f"_{name}_all").over(blocks_before).alias(f"_{name}_ahead"))
        else:
            local.append(_TOGETHER[kind](value).over(before).alias(f"_{name}_here"))
            whole.append(_TOGETHER[kind](value).alias(f"_{name}_all"))
            ahead.append(_TOGETHER[kind](f"_{name}_all").over(blocks_before.rowsBetween(W.unboundedPreceding, -1)).alias(f"_{name}_ahead"))
    rows = df.select("*", *local)
    blocks = df.groupBy(*keys, block).agg(*whole).select(*[F.col(c).alias(f"_at_{c}") for c in [*keys, block]], *ahead)
    same = F.lit(True)
    for c in [*keys, block]:
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    joined = rows.join(blocks, same)
    out = []
    for name, (kind, _) in values.items():
        here, prior = F.col(f"_{name}_here"), F.col(f"_{name}_ahead")
        if kind == "lag":
            out.append(F.coalesce(here, prior)["x"].alias(name))
        elif kind == "sum":
            out.append(F.when(here.isNull(), prior).when(prior.isNull(), here).otherwise(here + prior).alias(name))
        else:
            out.append((F.greatest if kind == "max" else F.least)(here, prior).alias(name))
    return joined.select(*df.columns, *out)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the number of each row, without gaps from 0, in the order of columns: a sort by ranges, then counts of the ranges."""
    placed = cut(df.orderBy(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = cut(placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")))  # a row for each range
    first = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    joined = placed.withColumn("_part", part).join(F.broadcast(first), "_part")
    return joined.withColumn(name, F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).select(*df.columns, name)


def value_blocks(df: DataFrame, value: str, blocks: int = 64) -> Column:
    """A block number for each value of a numeric column, ascending with it, from approximate quantiles."""
    cuts = sorted(set(df.approxQuantile(value, [i / blocks for i in range(1, blocks)], 0.002))) if blocks > 1 else []
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c < F.col(value))) if cuts else F.lit(0)
