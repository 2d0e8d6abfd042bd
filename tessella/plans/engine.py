"""The engine: a store, its metric and a configuration, answering batches of queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import Config, feature_weights, weight_vector
from tessella.functions.columns import features, in_range, numeric, renamed, require, time_column
from tessella.functions.stats import covariance, weighted_inverse, with_percentile_rank
from tessella.operators.blocks import numbered
from tessella.operators.continuity import apply_continuity
from tessella.operators.matching import PointIndex, best_pairs, match_details, plan_points
from tessella.operators.models import Model, with_models
from tessella.operators.sampling import daily_sample, random_window, row_at, with_position
from tessella.operators.sequences import planned_sequences
from tessella.plans.report import time_distances
from tessella.sources.tables import settled


class PlanningEngine:
    """Point and sequence plans over a store of standard samples.

    The covariance's inverse is kept without weights, so presets of weights take effect.
    """

    def __init__(self, spark: SparkSession, config: Config, samples: DataFrame, cov_reg_inverse: np.ndarray | None = None, models: Mapping[str, Model] | None = None):
        self.spark, self.config, self._samples, self._inverse, self.models = spark, config, samples, cov_reg_inverse, dict(models or {})
        self.reload()

    def __repr__(self) -> str:
        return f"PlanningEngine({len(self.config.features.similarity)} features, top {self.config.matching.top_k})"

    def reload(self, samples: DataFrame | None = None) -> None:
        """Builds the store again: rows with all values, a position, and the efficiency's rank."""
        self._samples = samples if samples is not None else self._samples
        f = self.config.features
        own = list(dict.fromkeys([f.load_col, *f.similarity, f.eff_col, *f.plan_center_cols]))
        df = numeric(require(renamed(self._samples, f.column_aliases), own, "the store"), own).dropna(subset=own)
        if "pos" not in df.columns:
            df = with_position(df, own)
        self.windows = settled(df.select("pos", F.col("window").cast("string")), "windows") if "window" in df.columns else None
        df = df.withColumn("load", F.col(f.load_col)).withColumn("eff", F.col(f.eff_col))
        store = with_percentile_rank(df, "eff", "eff_score").select("pos", "load", "eff", "eff_score", *dict.fromkeys([*f.similarity, *[c for c in f.plan_center_cols if c != "load"]]))
        self.store, self._indexes = settled(store, "store"), {}
        if self._inverse is None:
            self._inverse = np.linalg.pinv(covariance(self.store, f.similarity, self.config.training.reg_lambda))

    def metric(self, weights: dict[str, float] | None = None) -> np.ndarray:
        f = self.config.features
        w = weight_vector(f.similarity, weights or feature_weights(f))
        return weighted_inverse(np.linalg.pinv(self._inverse), w)

    def index(self, weights: dict[str, float] | None = None) -> PointIndex:
        """The store placed for queries, once for each weighting until it is built again."""
        f, c, metric = self.config.features, self.config, self.metric(weights)
        if metric.tobytes() not in self._indexes:
            self._indexes[metric.tobytes()] = PointIndex(self.store, f.similarity, metric, c.gate, c.matching)
        return self._indexes[metric.tobytes()]

    def queries_of(self, minutes: DataFrame, qid: str | Column, lenient: bool = False) -> DataFrame:
        """Query rows of a table that has the features; residuals that it lacks come from the
        engine's models. A missing column is an error unless ``lenient``."""
        f = self.config.features
        df = renamed(minutes, f.column_aliases)
        df = with_models(df, {t: m for t, m in self.models.items() if f"resid_{t}" not in df.columns})
        wanted = list(dict.fromkeys([*f.similarity, *f.plan_center_cols]))
        cols = features(df, wanted, lenient)
        key = F.col(qid) if isinstance(qid, str) else qid
        return df.select(key.alias("qid"), F.col(f.load_col).cast("double").alias("q_load"), *[c.alias(f"q_{n}") for c, n in zip(cols, wanted) if n != "load"])

    def plan(self, queries: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
        """A plan row for each query, without continuity."""
        f, c = self.config.features, self.config
        return plan_points(queries, self.store, f.similarity, self.metric(weights), c.gate, c.matching, f.plan_center_cols, self.index(weights))

    def plan_one(self, values: Mapping[str, float | None], previous: Mapping[str, float | None] | None = None) -> DataFrame:
        """The plan of one row of features, as one row. With ``previous``, the last final centre
        values, the plan's values move by their rate limits at most (final_<column>)."""
        own = self.spark.createDataFrame([tuple(None if v is None else float(v) for v in values.values())], ", ".join(f"`{c}` double" for c in values))
        one = self.plan(self.queries_of(own.withColumn("row", F.lit(0)), "row"))
        limits = self.config.continuity.rate_limits if self.config.continuity.enable_rate_limit else {}
        for c in self.config.features.plan_center_cols:
            value, last, limit = F.col(f"plan_{c}"), (previous or {}).get(c), limits.get(c)
            if last is not None and limit is not None:
                value = F.when(F.abs(value - last) > limit, F.lit(float(last)) + F.signum(value - last) * F.lit(float(limit))).otherwise(value)
            one = one.withColumn(f"final_{c}", value)
        return one

    def plan_row(self, minutes: DataFrame, index: int) -> DataFrame:
        """The plan of the row at ``index`` (from 0, by time), with the samples nearest by load if
        no sample passes the gate."""
        time = time_column(minutes, self.config.time_col)
        row = row_at(minutes, time, index)
        f, c = self.config.features, self.config
        return plan_points(self.queries_of(row, time), self.store, f.similarity, self.metric(), c.gate, replace(c.matching, allow_fallback_nearest_load=True), f.plan_center_cols)

    def sample_run(self, minutes: DataFrame, days: int, per_day: int) -> tuple[DataFrame, DataFrame]:
        """(plans, details) of ``per_day`` rows of each of ``days`` dates."""
        time = time_column(minutes, self.config.time_col)
        drawn = daily_sample(minutes, time, time, days, per_day, self.config.training.seed)
        queries = self.queries_of(drawn, F.struct(time, "rank"))  # rows may share a time
        return self.plan(queries), self.details(queries)

    def validation(self, minutes: DataFrame, days: int, seed: int = 42) -> DataFrame:
        """Planned against actual values in a window of ``days`` days: qid, column, actual, planned, and the
        plan's match_status, s_topk_mean, and how many days its samples' windows are away (top1_days,
        topk_mean_days; null unless the samples have the column window, ``start~end``)."""
        time = time_column(minutes, self.config.time_col)
        queries = settled(self.queries_of(random_window(minutes, time, days, seed), time), "validation")
        plans = self.plan(queries)
        if self.windows is not None:
            best = self.index().best(queries)
            away = time_distances(best.select("qid", "rank", "pos").join(self.windows, "pos"), "qid", "window")
            plans = plans.join(away.withColumnRenamed("qid", "__qid"), F.col("qid") == F.col("__qid"), "left").drop("__qid")
        else:
            plans = plans.withColumns({c: F.lit(None).cast("double") for c in ("top1_days", "topk_mean_days")})
        rows = [F.struct(F.lit(c).alias("column"), (F.col(f"q_{c}") if f"q_{c}" in plans.columns else F.col("q_load")).alias("actual"), F.col(f"plan_{c}").alias("planned")) for c in self.config.features.plan_center_cols]
        return plans.select("qid", F.explode(F.array(*rows)).alias("r"), "match_status", "s_topk_mean", "top1_days", "topk_mean_days").select("qid", "r.*", "match_status", "s_topk_mean", "top1_days", "topk_mean_days")

    def details(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """One row per query and matched sample."""
        f, c = self.config.features, self.config
        return match_details(best_pairs(queries, self.store, f.similarity, self.metric(), c.gate, c.matching, k), f.similarity)

    def run_batch(self, minutes: DataFrame, start=None, end=None, keys: Sequence[str] = (), output: str | None = None) -> DataFrame:
        """Plans for all rows of a time range, with continuity per series; written if ``output``."""
        time = time_column(minutes, self.config.time_col)
        rows = in_range(minutes, time, start, end)
        qid = F.struct(*keys, time)
        plans = self.plan(self.queries_of(rows, qid)).withColumn("ts", F.col("qid")[time]).withColumns({k: F.col("qid")[k] for k in keys})
        centers = [f"plan_{c}" for c in self.config.features.plan_center_cols]
        limits = self.config.continuity
        renamed_limits = type(limits)(limits.enable_rate_limit, {f"plan_{c}": v for c, v in limits.rate_limits.items()}, limits.reset_on_time_gap, limits.max_gap_minutes)
        done = apply_continuity(plans.drop("qid"), "ts", centers, renamed_limits, keys)
        if output:
            done.write.mode("overwrite").parquet(output)
        return done

    def presets(self, queries: DataFrame, presets: dict[str, dict[str, float]]) -> DataFrame:
        """The plans of several weightings, told apart by the column preset."""
        out = None
        for name, weights in presets.items():
            one = self.plan(queries, weights).withColumn("preset", F.lit(name))
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError("no presets")
        return out

    def plan_sequences(self, minutes: DataFrame, queries: Column, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
        """Sequence plans for the rows that ``queries`` marks as a query's end, a row each: those that
        fail have a status that tells why. Series by ``keys``."""
        f = self.config.features
        time = time_column(minutes, self.config.time_col)
        center = list(columns or f.plan_center_cols)
        grid = settled(numbered(minutes, time, keys).withColumn("load", F.col(f.load_col)), "grid")
        return planned_sequences(grid, f.similarity, center, self.config.sequence, queries, time, keys=keys)
