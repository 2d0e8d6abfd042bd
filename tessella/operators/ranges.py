"""Totals over ranges of a sorted value: a tree of sums instead of a join with every row in range."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.stats import running_sums
from tessella.sources.tables import settled

#: Nodes of a level that make a node of the next.
FAN = 8


def range_totals(asked: DataFrame, low: str, high: str, rows: DataFrame, value: str, totals: Mapping[str, tuple[str | int, Callable]], passes: Column | None = None) -> DataFrame:
    """``asked`` with the totals of the rows whose value is between its columns ``low`` and ``high``, both
    included; rows of ``asked`` without any are left out. A total is a column (or 1, of rows) and how it is merged
    (``F.sum``, ``F.min`` or ``F.max``). ``passes`` decides about the values in the two last blocks of
    ``FAN`` at either end, where bounds may be a little too wide.

    Distinct values are numbered in their order and summed up in a tree. A range is a few nodes of each
    level, so that what is joined grows with the queries and the logarithm of the rows.
    """
    found = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(*[merge(F.col(c) if isinstance(c, str) else F.lit(c)).alias(n) for n, (c, merge) in totals.items()])
    placed = settled(running_sums(found.withColumn("__one", F.lit(1)), "__v", "__one").withColumnRenamed("__before", "__node").drop("__one", "__all"), "values")
    asks = settled(asked.withColumn("__ask", F.monotonically_increasing_id()), "asks")

    # how many values are below each bound: an as-of lookup, by a union sorted within ranges
    bounds = asks.select(F.explode(F.array(low, high)).alias("__v")).distinct().withColumn("__one", F.lit(0))
    marks = bounds.unionByName(placed.select("__v", F.lit(1).alias("__one"))).groupBy("__v").agg(F.sum("__one").alias("__one"))
    marks = settled(running_sums(marks, "__v", "__one").select("__v", "__before", (F.col("__before") + F.col("__one")).alias("__to")), "marks")
    firsts, lasts = marks.select(F.col("__v").alias("__l"), F.col("__before").alias("__a")), marks.select(F.col("__v").alias("__h"), (F.col("__to") - 1).alias("__b"))
    spans = asks.join(firsts, F.col(low) == F.col("__l")).join(lasts, F.col(high) == F.col("__h")).drop("__l", "__h").filter("__a <= __b")

    size, levels = placed.count(), 1
    while FAN**levels < size:
        levels += 1
    run = lambda level, x, y: F.when(x <= y, F.transform(F.sequence(x, F.greatest(x, y)), lambda i: F.struct(F.lit(level).alias("level"), i.alias("node")))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))
    over = lambda c: F.floor(c / FAN)
    a, b = F.col("__a"), F.col("__b")
    end = F.least(b, (over(a) + 2) * FAN - 1)
    parts = [run(0, a, end), run(0, F.greatest(end + 1, (over(b) - 1) * FAN), b)]
    spans = spans.withColumns({"__x1": over(a) + 2, "__y1": over(b) - 2})
    for level in range(1, levels + 1):
        x, y = F.col(f"__x{level}"), F.col(f"__y{level}")
        if level == levels:
            parts.append(run(level, x, y))
            break
        spans = spans.withColumns({f"__x{level + 1}": F.ceil(x / FAN), f"__y{level + 1}": over(y + 1) - 1})
        end = F.least(y, F.col(f"__x{level + 1}") * FAN - 1)
        parts += [run(level, x, end), run(level, F.greatest(end + 1, (F.col(f"__y{level + 1}") + 1) * FAN, x), y)]
    wanted = spans.select(*[c for c in asks.columns], F.explode(F.flatten(F.array(*parts))).alias("__w")).select(*asks.columns, "__w.*")

    merged = lambda df: [merge(n).alias(n) for n, (_, merge) in totals.items()]
    tree = placed.withColumn("__l", F.lit(0))
    step = placed
    for level in range(1, levels + 1):
        step = settled(step.groupBy(F.floor(F.col("__node") / FAN).alias("__node")).agg(*merged(step)), "nodes")
        tree = tree.unionByName(step.withColumn("__l", F.lit(level)), allowMissingColumns=True)
    hit = (F.col("level") == F.col("__l")) & (F.col("node") == F.col("__node"))
    if passes is not None:
        hit &= (F.col("__l") > 0) | passes
    # both sides are sorted: what is wanted has many more rows than its size on disk tells
    return wanted.join(tree.hint("merge"), hit).groupBy(*asked.columns, "__ask").agg(*merged(tree)).drop("__ask")
