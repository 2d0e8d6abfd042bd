"""Residual models as artifacts: fitted, saved, loaded, and applied to batches at query time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.stats import regression_metrics
from tessella.operators.residuals import linear, ols_coefficients, solved, with_fold_residuals

INDEX = "target string, kind string, inputs array<string>, coefficients array<double>"


class Model(Protocol):
    """What predicts a target: it adds a column of predictions; a row with a null input has none."""

    inputs: tuple[str, ...]

    def add(self, df: DataFrame, name: str) -> DataFrame: ...


@dataclass(frozen=True)
class LinearModel:
    inputs: tuple[str, ...]
    coefficients: tuple[float, ...]

    def add(self, df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, linear(self.inputs, self.coefficients))


@dataclass(frozen=True)
class TreeModel:
    """Gradient-boosted trees of Spark's library."""

    inputs: tuple[str, ...]
    model: Any

    def add(self, df: DataFrame, name: str) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        whole = F.lit(True)
        for c in self.inputs:
            whole &= F.col(c).isNotNull()
        filled = df.withColumns({f"__in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.inputs})
        made = VectorAssembler(inputCols=[f"__in_{c}" for c in self.inputs], outputCol="__x", handleInvalid="keep").transform(filled)
        out = self.model.copy({self.model.featuresCol: "__x", self.model.predictionCol: "__p"}).transform(made)
        return out.withColumn(name, F.when(whole, F.col("__p"))).drop("__x", "__p", *[f"__in_{c}" for c in self.inputs])


@dataclass(frozen=True)
class ForeignModel:
    """Any object's ``predict`` on a frame of the inputs, batch by batch."""

    inputs: tuple[str, ...]
    predict: Callable[[pd.DataFrame], Sequence[float]]

    def add(self, df: DataFrame, name: str) -> DataFrame:
        predict, inputs = self.predict, self.inputs

        @F.pandas_udf("double")
        def of(x: pd.DataFrame) -> pd.Series:
            out, whole = pd.Series([None] * len(x), dtype="float64"), x.notna().all(axis=1).to_numpy()
            if whole.any():
                out[whole] = list(predict(x[whole].set_axis(list(inputs), axis=1)))
            return out

        return df.withColumn(name, of(F.struct(*[F.col(c).cast("double") for c in inputs])))


def with_models(df: DataFrame, models: Mapping[str, Model]) -> DataFrame:
    """Adds ``pred_<target>``, and ``resid_<target>`` where the target's own column is there."""
    for target, model in models.items():
        df = model.add(df, f"pred_{target}")
        if target in df.columns:
            df = df.withColumn(f"resid_{target}", F.col(target) - F.col(f"pred_{target}"))
    return df


def fit_linear(df: DataFrame, inputs: Sequence[str], target: str) -> LinearModel:
    return LinearModel(tuple(inputs), tuple(solved(ols_coefficients(df, inputs, target).first(), len(inputs) + 1)))


def fit_trees(df: DataFrame, inputs: Sequence[str], target: str, max_iter: int = 200, step: float = 0.05, depth: int = 6, min_leaf: int = 20, seed: int = 42) -> TreeModel:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    made = VectorAssembler(inputCols=list(inputs), outputCol="__x").transform(df.dropna(subset=[*inputs, target]))
    return TreeModel(tuple(inputs), GBTRegressor(featuresCol="__x", labelCol=target, predictionCol="__p", maxIter=max_iter, stepSize=step, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed).fit(made))


def fitted(df: DataFrame, inputs: Sequence[str], target: str, folds: int, trees: Mapping[str, Any] | None = None) -> tuple[DataFrame, Model, DataFrame]:
    """(rows, model, report) of rows that have split and fold: the rows with predictions out of
    fold (rows of fold -1 by the full model), the model of all rows, and n, r2, mae, rmse, mape
    and full_model_fill_n by split (of a model of the training rows) and for oof. ``trees`` are
    parameters of boosted trees; without, models are linear."""
    fit = (lambda rows: fit_trees(rows, inputs, target, **trees)) if trees is not None else (lambda rows: fit_linear(rows, inputs, target))
    full, name = fit(df), f"pred_{target}"
    if trees is None:
        rows = with_fold_residuals(df, inputs, target, folds)
    else:
        parts = [fit(df.filter(F.col("fold") != k)).add(df.filter(F.col("fold") == k), name) for k in range(folds)]
        rows = full.add(df.filter("fold = -1"), name)
        for part in parts:
            rows = rows.unionByName(part)
        rows = rows.withColumn(f"resid_{target}", F.col(target) - F.col(name))
    by_split = regression_metrics(fit(df.filter("split = 'train'")).add(df, "__pred"), target, "__pred", ["split"])
    report = by_split.unionByName(regression_metrics(rows.withColumn("split", F.lit("oof")), target, name, ["split"]))
    filled = df.agg(F.count_if(F.col("fold") == -1).alias("full_model_fill_n"))
    return rows, full, report.withColumn("target", F.lit(target)).crossJoin(F.broadcast(filled))  # one row


def save_models(spark: SparkSession, path: str, models: Mapping[str, Model]) -> None:
    """An index table at ``path/index`` and each tree model in a folder of its own."""
    rows = []
    for target, model in models.items():
        if isinstance(model, LinearModel):
            rows.append((target, "linear", list(model.inputs), [float(x) for x in model.coefficients]))
        elif isinstance(model, TreeModel):
            model.model.write().overwrite().save(f"{path}/tree-{target}")
            rows.append((target, "trees", list(model.inputs), None))
        else:
            raise ValueError(f"the model of {target} has no stored form")
    spark.createDataFrame(rows, INDEX).coalesce(1).write.mode("overwrite").json(f"{path}/index")


def load_models(spark: SparkSession, path: str, targets: Iterable[str]) -> dict[str, Model]:
    """Raises ValueError with all targets that have no model."""
    from pyspark.ml.regression import GBTRegressionModel

    found = {r["target"]: r for r in spark.read.schema(INDEX).json(f"{path}/index").collect()}  # a row per target
    if missing := [t for t in targets if t not in found]:
        raise ValueError(f"no models of {missing} at {path}")
    rows = {t: found[t] for t in targets}
    return {t: LinearModel(tuple(r["inputs"]), tuple(r["coefficients"])) if r["kind"] == "linear" else TreeModel(tuple(r["inputs"]), GBTRegressionModel.load(f"{path}/tree-{t}")) for t, r in rows.items()}


def weighted_columns(df: DataFrame, stats: Mapping[str, tuple[float, float]], weights: Mapping[str, float]) -> dict[str, Column]:
    """Of each column (x - median) / iqr * sqrt(weight) as float; null, NaN and infinities are 0.
    An iqr under 1e-12 counts as 1, a weight below 0 as 0."""
    from tessella.functions.columns import zero_filled

    out = {}
    for c, (median, iqr) in stats.items():
        scale = max(weights.get(c, 1.0), 0.0) ** 0.5 / (iqr if iqr >= 1e-12 else 1.0)
        out[c] = (zero_filled((F.col(c).cast("double") - F.lit(float(median))) * F.lit(float(scale)))).cast("float")
    return out


def weighted_matrix(df: DataFrame, stats: Mapping[str, tuple[float, float]], weights: Mapping[str, float]) -> DataFrame:
    """The columns replaced by their weighted forms."""
    return df.withColumns(weighted_columns(df, stats, weights))


def weighted_vector(df: DataFrame, stats: Mapping[str, tuple[float, float]], weights: Mapping[str, float], name: str = "vector") -> DataFrame:
    """The weighted forms of a row as one array, in the order of ``stats``."""
    return df.withColumn(name, F.array(*weighted_columns(df, stats, weights).values()))
