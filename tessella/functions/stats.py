"""Statistics: ranks, bins, robust and regression measures, covariance."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.tables import settled


def running_sums(counts: DataFrame, value: str, n: str, groups: Iterable[str] = ()) -> DataFrame:
    """Adds __before (the sum of ``n`` over a group's smaller values) and __all to rows of distinct
    values. One sort by group and value in ranges; the ranges' sums, a row per group and range, give each
    range its start. So neither a group nor all values are one task, and ``counts`` is computed once."""
    groups = list(groups)
    placed = settled(counts.repartitionByRange(*groups, value).withColumn("__part", F.spark_partition_id()), "counts")
    sums = placed.groupBy("__part", *groups).agg(F.sum(n).alias("__size"))
    per = Window.partitionBy(*groups)  # a row per range
    sums = sums.withColumns({"__first": F.coalesce(F.sum("__size").over(per.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__all": F.sum("__size").over(per)})
    sums = sums.select(F.col("__part").alias("__p"), "__first", "__all", *[F.col(g).alias(f"__g_{g}") for g in groups])
    on = F.col("__part") == F.col("__p")
    for g in groups:
        on &= F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    inside = Window.partitionBy("__part", *groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("__in", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(sums if groups else F.broadcast(sums), on)
    return rows.withColumn("__before", F.col("__first") + F.col("__in")).drop("__part", "__p", "__first", "__in", *[f"__g_{g}" for g in groups])


def with_percentile_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average rank over count of the rows with a value; null without value. Ranks come from the
    distinct values' counts, rows themselves are never sorted."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranks = running_sums(counts, "__v", "__n").select("__v", ((F.col("__before") + (F.col("__n") + 1) / 2) / F.col("__all")).alias(name))
    return df.join(ranks, F.col(column) == F.col("__v"), "left").drop("__v")


def quantile_table(df: DataFrame, wanted: Mapping[str, Iterable[float]], groups: Iterable[str] = ()) -> DataFrame:
    """A row (per group) with an array ``<column>_q`` of exact interpolated quantiles for each column,
    null without values. All columns in one pass: their distinct values' counts are ranked by
    running sums, and only the ranks that a quantile lies between are kept."""
    groups, wanted = list(groups), {c: list(p) for c, p in wanted.items()}
    long = df.select(*groups, F.explode(F.array(*[F.struct(F.lit(c).alias("__column"), F.col(c).cast("double").alias("__v")) for c in wanted])).alias("__x")).select(*groups, "__x.*").filter("__v is not null")
    ranks = running_sums(long.groupBy(*groups, "__column", "__v").agg(F.count(F.lit(1)).alias("__n")), "__v", "__n", [*groups, "__column"])
    place = lambda p: F.lit(float(p)) * (F.col("__all") - 1)
    ends = lambda ps: F.array_distinct(F.array(*[f(place(p)) for p in ps for f in (F.floor, F.ceil)]))
    hits = F.filter(F.coalesce(*[F.when(F.col("__column") == c, ends(p)) for c, p in wanted.items()]), lambda i: (i >= F.col("__before")) & (i < F.col("__before") + F.col("__n")))
    picked = ranks.select(*groups, "__column", "__v", "__all", F.explode(hits).alias("__i")).groupBy(*groups, "__column").agg(F.map_from_entries(F.collect_list(F.struct("__i", "__v"))).alias("at"), F.max("__all").alias("__all"))  # two entries a probability
    low, high = lambda p: F.element_at("at", F.floor(place(p))), lambda p: F.element_at("at", F.ceil(place(p)))
    values = {c: F.array(*[low(p) + (high(p) - low(p)) * (place(p) - F.floor(place(p))) for p in ps]) for c, ps in wanted.items()}
    return picked.groupBy(*groups).agg(*[F.max(F.when(F.col("__column") == c, v)).alias(f"{c}_q") for c, v in values.items()])


def quantiles(df: DataFrame, column: str, probabilities: Iterable[float], name: str = "q") -> DataFrame:
    """One row with the exact interpolated quantiles of all rows' values as an array ``name``, null
    without values."""
    return quantile_table(df, {column: probabilities}).withColumnRenamed(f"{column}_q", name)


def _edges(quantiles_: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(quantiles_, F.array().cast("array<double>"))))


def quantile_edges(df: DataFrame, column: str, bins: int, keys: Iterable[str] = ()) -> DataFrame:
    """One row (per key) with the distinct edges of equally filled bins, as an array."""
    return quantile_table(df, {column: [i / bins for i in range(bins + 1)]}, keys).select(*keys, _edges(F.col(f"{column}_q")).alias(f"{column}_edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """Bin number of a value: bins are open on the left but for the first; null without value."""
    return F.when(value.isNotNull(), F.greatest(F.size(F.filter(edges, lambda e: e < value)) - 1, F.lit(0)))


def with_quantile_bins(df: DataFrame, bins: Mapping[str, int]) -> DataFrame:
    """Adds ``<column>_bin`` for each column, of all rows' quantiles."""
    edges = quantile_table(df, {c: [i / n for i in range(n + 1)] for c, n in bins.items()}).select(*[_edges(F.col(f"{c}_q")).alias(f"__{c}_edges") for c in bins])
    out = df.crossJoin(F.broadcast(edges))  # one row
    return out.withColumns({f"{c}_bin": bin_of(F.col(c), F.col(f"__{c}_edges")) for c in bins}).drop(*[f"__{c}_edges" for c in bins])


def robust_stats(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """A row per column: median, iqr, mean, std (of the population); iqr and std of under 1e-12
    are 1."""
    columns = list(columns)
    floor = lambda x: F.when(x < 1e-12, F.lit(1.0)).otherwise(x)
    one = df.agg(*[a for c in columns for a in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))])
    one = one.crossJoin(quantile_table(df, {c: [0.25, 0.5, 0.75] for c in columns}).withColumnsRenamed({f"{c}_q": f"{c}__q" for c in columns}))  # one row each
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__q")[1].alias("median"), floor(F.col(f"{c}__q")[2] - F.col(f"{c}__q")[0]).alias("iqr"), F.col(f"{c}__m").alias("mean"), floor(F.col(f"{c}__s")).alias("std")) for c in columns]))
    return one.select(rows.alias("r")).select("r.*")


def robust_normalized(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Columns as (x - median) / iqr of all rows."""
    columns = list(columns)
    q = quantile_table(df, {c: [0.25, 0.5, 0.75] for c in columns}).withColumnsRenamed({f"{c}_q": f"{c}__q" for c in columns})
    scaled = {c: (F.col(c) - F.col(f"{c}__q")[1]) / F.when(F.col(f"{c}__q")[2] - F.col(f"{c}__q")[0] < 1e-12, F.lit(1.0)).otherwise(F.col(f"{c}__q")[2] - F.col(f"{c}__q")[0]) for c in columns}
    return df.crossJoin(F.broadcast(q)).withColumns(scaled).drop(*[f"{c}__q" for c in columns])  # one row


def covariance(df: DataFrame, columns: Iterable[str], reg_lambda: float = 1e-6) -> np.ndarray:
    """Sample covariance plus ``reg_lambda`` times the mean of its diagonal on the diagonal, of
    rows without null. One aggregation, whatever the number of rows."""
    columns = list(columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.dropna(subset=columns).agg(*[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"c{i}_{j}"] if row[f"c{i}_{j}"] is not None else np.nan
    return out + reg_lambda * np.trace(out) / len(columns) * np.eye(len(columns))


def weighted_inverse(cov: np.ndarray, weights: Iterable[float]) -> np.ndarray:
    """Pseudo-inverse with the square roots of the weights on both sides."""
    w = np.sqrt(np.maximum(np.asarray(list(weights), float), 0))
    return w[:, None] * np.linalg.pinv(cov) * w[None, :]


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: Iterable[str] = ()) -> DataFrame:
    """n, r2 (of two rows or more), mae, rmse and mape (a fraction; denominators of 1e-8 at
    least), of rows that have both values."""
    y, error = F.col(actual), F.col(actual) - F.col(predicted)
    return df.filter(y.isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) >= 2, 1 - F.sum(error * error) / F.nullif(F.count(F.lit(1)) * F.var_pop(y), F.lit(0.0))).alias("r2"),
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error) / F.greatest(F.abs(y), F.lit(1e-8))).alias("mape"),
    )


def residual_report(df: DataFrame, residual: str) -> DataFrame:
    """One row: mean, median, std (of the population), iqr, mean_abs and p90_abs."""
    one = df.agg(F.avg(residual).alias("mean"), F.stddev_pop(residual).alias("std"), F.avg(F.abs(residual)).alias("mean_abs"))
    far = df.select(F.col(residual).alias("__own"), F.abs(residual).alias("__far"))
    one = one.crossJoin(quantile_table(far, {"__own": [0.25, 0.5, 0.75], "__far": [0.9]}))  # one row each
    q = F.col("__own_q")
    return one.select("mean", q[1].alias("median"), "std", (q[2] - q[0]).alias("iqr"), "mean_abs", F.col("__far_q")[0].alias("p90_abs"))
