"""Strata, splits, folds, samples and time windows; orders are hashes, so runs agree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.stats import quantile_table, with_quantile_bins
from tessella.sources.tables import settled


def shuffled(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def outliers_removed(df: DataFrame, load: str, columns: Sequence[str], bins: int = 15, low: float = 0.02, high: float = 0.98, most_bad: int = 2) -> DataFrame:
    """Rows with at most ``most_bad`` columns outside their load bin's quantiles; rows without load
    go. Adds load_bin and bad_count."""
    binned = with_quantile_bins(df.filter(F.col(load).isNotNull()), {load: bins}).withColumnRenamed(f"{load}_bin", "load_bin")
    limits = F.broadcast(bin_limits(binned, columns, low, high)).withColumnRenamed("load_bin", "__bin")  # ``bins`` rows
    bad = sum([F.coalesce((F.col(c) < F.col(f"{c}_low")) | (F.col(c) > F.col(f"{c}_high")), F.lit(False)).cast("int") for c in columns], F.lit(0))
    return binned.join(limits, F.col("load_bin") == F.col("__bin")).withColumn("bad_count", bad).filter(F.col("bad_count") <= most_bad).drop("__bin", *[f"{c}_{s}" for c in columns for s in ("low", "high")])


def bin_limits(binned: DataFrame, columns: Sequence[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Per load bin the two quantiles of each column."""
    table = quantile_table(binned, {c: [low, high] for c in columns}, ["load_bin"])
    return table.select("load_bin", *[F.get(f"{c}_q", F.lit(i)).alias(f"{c}_{s}") for c in columns for i, s in enumerate(("low", "high"))])


def bin_quantiles(binned: DataFrame, columns: Sequence[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """``bin_limits`` of each bin, and its rows."""
    counts = binned.groupBy(F.col("load_bin").alias("__bin")).agg(F.count(F.lit(1)).alias("n"))  # a row per bin
    return counts.join(bin_limits(binned, columns, low, high), F.col("__bin").eqNullSafe(F.col("load_bin")), "left").drop("load_bin").withColumnRenamed("__bin", "load_bin")


def with_strata(df: DataFrame, bins: Mapping[str, int]) -> DataFrame:
    """Adds a bin per column and ``strata``, their label; a row without value has <NA> there."""
    df = with_quantile_bins(df, bins)
    return df.withColumn("strata", F.concat_ws("|", *[F.coalesce(F.col(f"{c}_bin").cast("string"), F.lit("<NA>")) for c in bins]))


def with_group_places(df: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds __place, from 0 in each group's order of columns, and __n, the group's rows. Rows are sorted
    in ranges by group and order, and the ranges' counts, a row per group and range, are summed: a group
    of any size is many tasks."""
    groups = list(groups)
    placed = settled(df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id()), "places")
    per = Window.partitionBy(*groups)  # a row per range
    sums = placed.groupBy("__part", *groups).agg(F.count(F.lit(1)).alias("__size"), F.min("__in").alias("__low"))
    sums = sums.withColumns({"__first": F.coalesce(F.sum("__size").over(per.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__n": F.sum("__size").over(per)})
    sums = sums.select(F.col("__part").alias("__p"), (F.col("__first") - F.col("__low")).alias("__shift"), "__n", *[F.col(g).alias(f"__g_{g}") for g in groups])
    on = F.col("__part") == F.col("__p")
    for g in groups:
        on &= F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return placed.join(sums, on).withColumn("__place", F.col("__in") + F.col("__shift")).drop("__part", "__in", "__p", "__shift", *[f"__g_{g}" for g in groups])


def split_sizes(n: Column, train: float = 0.70, valid: float = 0.15) -> tuple[Column, Column]:
    """Training and validation rows of a stratum of ``n``; the rest are for testing. Halves round
    to even."""
    t = F.greatest(F.lit(1), F.bround(n * F.lit(train)).cast("int"))
    v = F.greatest(F.lit(1), F.bround(n * F.lit(valid)).cast("int"))
    full = n - t - v <= 0
    t4 = F.when(full, F.greatest(F.lit(1), n - v - 1)).otherwise(t)
    return (
        F.when(n <= 3, F.lit(1)).otherwise(t4),
        F.when(n <= 2, F.lit(0)).when(n == 3, F.lit(1)).otherwise(v),
    )


def with_split(df: DataFrame, key: str, strata: str = "strata", train: float = 0.70, valid: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds split (train, valid or test), by a shuffled order in each stratum."""
    placed = with_group_places(df.withColumn("__h", shuffled(F.col(key), seed)), [strata], ["__h", key])
    t, v = split_sizes(F.col("__n"), train, valid)
    return placed.withColumn("split", F.when(F.col("__place") < t, "train").when(F.col("__place") < t + v, "valid").otherwise("test")).drop("__n", "__place", "__h")


def with_folds(df: DataFrame, key: str, strata: str = "strata", folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold, dealt in turn over each stratum's shuffled rows; the only row of a stratum has -1."""
    placed = with_group_places(df.withColumn("__h", shuffled(F.col(key), seed)), [strata], ["__h", key])
    return placed.withColumn("fold", F.when(F.col("__n") <= 1, F.lit(-1)).otherwise(F.col("__place") % folds).cast("int")).drop("__n", "__place", "__h")


def split_report(df: DataFrame, strata: str = "strata") -> DataFrame:
    count = lambda s: F.count_if(F.col("split") == s).alias(s)
    return df.groupBy(strata).agg(F.count(F.lit(1)).alias("n"), count("train"), count("valid"), count("test"))


def daily_sample(df: DataFrame, time: str, key: str, days: int, per_day: int, seed: int = 42) -> DataFrame:
    """``per_day`` rows of each of ``days`` dates, both drawn by hash; adds day and rank."""
    dated = df.filter(F.col(time).isNotNull()).withColumn("day", F.to_date(time))
    chosen = dated.select("day").distinct().orderBy(shuffled(F.col("day"), seed)).limit(days)
    order = Window.partitionBy("day").orderBy(shuffled(F.col(key), seed), key)
    return dated.join(F.broadcast(chosen), "day").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_day)  # ``days`` rows


def densest_window(df: DataFrame, time: str, hours: int) -> DataFrame:
    """Start and rows of the ``hours`` hours with most rows; of equal ones the first."""
    counts = df.filter(F.col(time).isNotNull()).groupBy(F.date_trunc("hour", F.col(time).cast("timestamp")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    grid = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("hour")).join(counts, "hour", "left")
    ahead = Window.orderBy("hour").rowsBetween(0, hours - 1)
    rolled = grid.select("hour", F.sum(F.coalesce("n", F.lit(0))).over(ahead).alias("n_rows"), F.count(F.lit(1)).over(ahead).alias("n_hours"))
    return rolled.filter(F.col("n_hours") == F.least(F.lit(hours), F.lit(hours))).orderBy(F.desc("n_rows"), "hour").limit(1).select(F.col("hour").cast("timestamp_ntz").alias("start_ts"), "n_rows")


def with_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Adds positions from 0 in the order of columns, the same in every run (rows that agree in all
    of them are alike). Rows are sorted in ranges, whose sizes are summed first; never in one task."""
    placed = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id()), "ordered")
    firsts, at = [], 0
    for r in sorted(placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__in").alias("low")).collect()):  # a row per range
        firsts.append((r["__part"], at - r["low"]))
        at += r["n"]
    out = placed.join(F.broadcast(df.sparkSession.createDataFrame(firsts, "__p int, __first long")), F.col("__part") == F.col("__p"))
    return out.withColumn(name, F.col("__first") + F.col("__in")).drop("__part", "__p", "__in", "__first")


def row_at(df: DataFrame, time: str, index: int) -> DataFrame:
    """The row at ``index`` from 0 in the order of time; raises ValueError if there is none."""
    placed = settled(with_position(df.filter(F.col(time).isNotNull()), [time, *[c for c in df.columns if c != time]], "__pos").filter(F.col("__pos") == index).drop("__pos"), "row")
    if not placed.head(1):
        raise ValueError(f"no row {index}")
    return placed


def stepped(df: DataFrame, time: str, step: int, wanted: Column | None = None) -> DataFrame:
    """Every ``step``-th row, from the first, of the rows that ``wanted`` marks, by time."""
    rows = df if wanted is None else df.filter(wanted)
    return with_position(rows, [time, *[c for c in df.columns if c != time]], "__pos").filter(F.col("__pos") % step == 0).drop("__pos")


def random_window(df: DataFrame, time: str, days: int, seed: int = 42, tries: int = 20) -> DataFrame:
    """Rows of ``days`` dates in a row: of up to ``tries`` first dates drawn by hash the first whose
    window has a row on every date, else the densest window. Half-open: the last date is whole.
    Only dates and their counts are looked at to choose."""
    counts = df.filter(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = counts.agg(F.max("day").alias("last"))
    ahead = Window.orderBy(F.unix_date("day")).rangeBetween(0, days - 1)  # a row per date
    windows = counts.select("day", F.count(F.lit(1)).over(ahead).alias("filled"), F.sum("n").over(ahead).alias("rows")).crossJoin(F.broadcast(last))
    windows = windows.filter(F.date_add("day", days - 1) <= F.col("last"))
    draws = windows.orderBy(shuffled(F.col("day"), seed)).limit(tries).filter(F.col("filled") == days).orderBy(shuffled(F.col("day"), seed)).limit(1).select("day", F.lit(0).alias("rank"))
    dense = windows.orderBy(F.desc("rows"), "day").limit(1).select("day", F.lit(1).alias("rank"))
    whole = counts.agg(F.min("day").alias("day")).select("day", F.lit(2).alias("rank"))
    chosen = F.broadcast(draws.unionByName(dense).unionByName(whole).orderBy("rank").limit(1).select(F.col("day").alias("__day")))  # one row
    return df.crossJoin(chosen).filter((F.to_date(time) >= F.col("__day")) & (F.to_date(time) < F.date_add("__day", days))).drop("__day")


def date_batches(df: DataFrame, time: str, dates: Sequence[str]) -> DataFrame:
    """The rows of each listed date, told apart by the column batch, in one plan."""
    return df.withColumn("batch", F.to_date(time).cast("string")).filter(F.col("batch").isin(list(dates)))
