"""Windows over long series without a task that has a whole series: rows are dealt to blocks by
their number, and a block also gets the neighbours' rows that its windows reach."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.sampling import with_position

#: Rows of a block.
BLOCK = 4096
_ORDERED = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "string", "date", "timestamp")


def same(keys: Sequence[str], prefix: str) -> Column:
    """Whether a row's keys equal another row's, whose names have the prefix; null is a series too."""
    out = F.lit(True)
    for k in keys:
        out &= F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def numbered(df: DataFrame, time: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds rn, the row's number from 1 in its series' order of time. Rows that share a time are
    numbered by their other values."""
    order = list(dict.fromkeys([*keys, time, *[c for c, kind in df.dtypes if kind.startswith(_ORDERED)]]))
    placed = with_position(df, order, "__at")
    if not keys:
        return placed.withColumn("rn", F.col("__at") + 1).drop("__at")
    first = placed.groupBy(*keys).agg(F.min("__at").alias("__first")).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    return placed.join(first, same(keys, "__k_")).withColumn("rn", F.col("__at") - F.col("__first") + 1).drop("__at", "__first", *[f"__k_{k}" for k in keys])


def with_windows(df: DataFrame, keys: Sequence[str], before: int, after: int, columns) -> DataFrame:
    """Adds ``columns(partition)``, a dict of window expressions that reach at most ``before`` rows
    back and ``after`` rows ahead in the order of rn, for the window partition that it is given."""
    own = F.floor(F.col("rn") / BLOCK)
    blocks = F.sequence(F.greatest(F.floor((F.col("rn") - after) / BLOCK), F.lit(0)), F.floor((F.col("rn") + before) / BLOCK))
    spread = df.withColumn("__block", F.explode(blocks))
    return spread.withColumns(columns(Window.partitionBy(*keys, "__block"))).filter(F.col("__block") == own).drop("__block")


def with_running_total(df: DataFrame, keys: Sequence[str], value: Column, name: str, levels: int = 2) -> DataFrame:
    """Adds the sum of ``value`` over the rows up to this one in the order of rn: blocks are summed
    first, then blocks of blocks, so that a task has a block's rows, or a series' blocks of blocks."""
    placed = df.withColumn("__block", F.floor(F.col("rn") / BLOCK)).withColumn("__value", value)
    sums = placed.groupBy(*keys, F.col("__block").alias("rn")).agg(F.sum("__value").alias("__sum"))
    if levels > 1:
        sums = with_running_total(sums, keys, F.col("__sum"), "__to", levels - 1)
    else:
        sums = sums.withColumn("__to", F.sum("__sum").over(Window.partitionBy(*keys).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("rn").alias("__b"), (F.col("__to") - F.col("__sum")).alias("__first"))
    inside = Window.partitionBy(*keys, "__block").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.withColumn("__in", F.sum("__value").over(inside)).join(sums, same(keys, "__k_") & (F.col("__block") == F.col("__b")))
    return joined.withColumn(name, F.col("__first") + F.col("__in")).drop("__block", "__value", "__b", "__first", "__in", *[f"__k_{k}" for k in keys])
