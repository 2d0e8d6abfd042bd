"""Training: filter, strata, split, folds, residual models, covariance and the store's table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.config import Config
from tessella.functions.columns import before_cutoff, numeric, renamed, require, without_last_month
from tessella.functions.stats import covariance, residual_report
from tessella.operators.models import Model, fitted, save_models
from tessella.operators.sampling import outliers_removed, split_report, with_folds, with_split, with_strata
from tessella.sources.tables import settled, write_covariance, write_parquet


@dataclass
class Trained:
    store: DataFrame
    splits: DataFrame
    models: DataFrame
    residuals: DataFrame
    cov_reg_inverse: np.ndarray
    fitted: dict[str, Model]
    config: Config

    def write(self, path: str) -> None:
        """The artifacts: tables store, splits, models and residuals, the covariance and the models."""
        for name in ("store", "splits", "models", "residuals"):
            write_parquet(getattr(self, name), f"{path}/{name}")
        write_covariance(self.store.sparkSession, f"{path}/covariance", self.cov_reg_inverse, self.config.features.similarity, self.config.training.reg_lambda)
        save_models(self.store.sparkSession, f"{path}/fitted", self.fitted)


def train(samples: DataFrame, config: Config, key: str, cutoff=None, newest: DataFrame | None = None, newest_col: str | None = None) -> Trained:
    """The whole training run as lazy tables; only the models and the covariance are computed.

    With ``newest``, the month before its last time is left out, so that queries of that month
    aren't answered from themselves. The store's residuals are out of fold. Without strata columns
    all rows are one stratum.
    """
    f, t = config.features, config.training
    own = list(dict.fromkeys([f.load_col, *f.raw, f.eff_col]))
    df = numeric(require(renamed(samples, f.column_aliases), own), own)
    if cutoff is not None:
        df = before_cutoff(df, f.date_col, cutoff)
    if newest is not None:
        df = without_last_month(df, f.date_col, newest, newest_col or f.date_col)
    df = df.dropna(subset=own)
    if t.filter_cols:
        df = outliers_removed(df, f.load_col, t.filter_cols, t.filter_bins, t.filter_q_low, t.filter_q_high, t.max_bad_features)
    df = with_strata(df, t.strata_bins) if t.strata_bins else df.withColumn("strata", F.lit("all"))
    df = with_folds(with_split(df, key, "strata", t.train_ratio, t.valid_ratio, t.seed), key, "strata", t.oof_n_splits, t.seed)
    df = settled(df, "training")  # the models read it many times
    trees = dict(max_iter=t.max_iter, step=t.learning_rate, depth=t.max_depth, min_leaf=t.min_samples_leaf, seed=t.seed) if t.model == "trees" else None
    models = reports = None
    full: dict[str, Model] = {}
    for target in f.residual_targets:
        df, full[target], m = fitted(df, f.residual_inputs, target, t.oof_n_splits, trees)
        r = residual_report(df, f"resid_{target}").withColumn("target", F.lit(target))
        models = m if models is None else models.unionByName(m)
        reports = r if reports is None else reports.unionByName(r)
    inverse = np.linalg.pinv(covariance(df, f.similarity, t.reg_lambda))
    kept = list(dict.fromkeys([key, f.load_col, *f.similarity, f.eff_col]))
    return Trained(df.select(*kept), split_report(df), models, reports, inverse, full, config)
