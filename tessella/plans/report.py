"""Reports: status shares, tidy data for figures, and time distances of matches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.columns import days_between, window_midpoint


def status_histogram(df: DataFrame, status: str) -> DataFrame:
    counts = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row per status


def tidy(df: DataFrame, time: str, panels: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """(ts, panel, series, value) rows of the columns of each panel: what a figure draws."""
    rows = [F.struct(F.lit(panel).alias("panel"), F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for panel, columns in panels.items() for c in columns]
    return df.select(F.col(time).alias("ts"), F.explode(F.array(*rows)).alias("r")).select("ts", "r.*")


def axis_ranges(tidied: DataFrame, margin: float = 0.1) -> DataFrame:
    """Least and greatest value of each panel, widened by ``margin`` of their distance."""
    lo, hi = F.min("value"), F.max("value")
    return tidied.groupBy("panel").agg((lo - margin * (hi - lo)).alias("axis_min"), (hi + margin * (hi - lo)).alias("axis_max"))


def time_distances(ranked: DataFrame, query_time: str, window: str) -> DataFrame:
    """Per query top1_days and topk_mean_days: how far the matched samples' windows (``start~end``)
    have their middle from the query's time."""
    days = days_between(F.col(query_time), window_midpoint(F.col(window)))
    return ranked.withColumn("__days", days).groupBy("qid").agg(F.max(F.when(F.col("rank") == 1, F.col("__days"))).alias("top1_days"), F.avg("__days").alias("topk_mean_days"))
