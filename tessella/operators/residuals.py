"""Residual features: models of a column from others, and what they leave."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ols_coefficients(df: DataFrame, inputs: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per key the sums of the normal equations of a linear model with intercept, one aggregation."""
    terms = [F.lit(1.0), *[F.col(c) for c in inputs]]
    whole = df.dropna(subset=[*inputs, target])
    cells = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(len(terms)) for j in range(i, len(terms))]
    return whole.groupBy(*keys).agg(*cells, *[F.sum(t * F.col(target)).alias(f"b{i}") for i, t in enumerate(terms)])


def solved(row, size: int) -> list[float]:
    a, b = np.zeros((size, size)), np.array([row[f"b{i}"] for i in range(size)])
    for i in range(size):
        for j in range(i, size):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    return ((np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=None)[0]) / scale).tolist()


def linear(inputs: Sequence[str], coefficients: Sequence[float]) -> Column:
    return sum([F.lit(float(w)) * F.col(c) for w, c in zip(coefficients[1:], inputs)], F.lit(float(coefficients[0])))


def with_residuals(df: DataFrame, inputs: Sequence[str], targets: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Adds ``pred_<target>`` and ``resid_<target>`` of linear models fitted on ``fitted_on``."""
    new = {}
    for t in targets:
        row = ols_coefficients(fitted_on or df, inputs, t).first()
        new[f"pred_{t}"] = linear(inputs, solved(row, len(inputs) + 1))
    df = df.withColumns(new)
    return df.withColumns({f"resid_{t}": F.col(t) - F.col(f"pred_{t}") for t in targets})


def with_fold_residuals(df: DataFrame, inputs: Sequence[str], target: str, folds: int) -> DataFrame:
    """The same out of fold: a row of fold k is predicted by the model of all other folds; rows of
    fold -1 by the model of all rows. The sums of a fold are taken from those of all."""
    rows = {r["fold"]: r for r in ols_coefficients(df, inputs, target, ["fold"]).collect()}  # a row per fold
    size = len(inputs) + 1
    names = [f"a{i}_{j}" for i in range(size) for j in range(i, size)] + [f"b{i}" for i in range(size)]
    total = {n: sum(r[n] for r in rows.values()) for n in names}
    prediction = linear(inputs, solved(total, size))
    for k in range(folds):
        if k in rows:
            rest = {n: total[n] - rows[k][n] for n in names}
            prediction = F.when(F.col("fold") == k, linear(inputs, solved(rest, size))).otherwise(prediction)
    return df.withColumn(f"pred_{target}", prediction).withColumn(f"resid_{target}", F.col(target) - F.col(f"pred_{target}"))


def with_tree_residuals(df: DataFrame, inputs: Sequence[str], target: str, train: Column, max_iter: int = 200, step: float = 0.05, depth: int = 6, min_leaf: int = 20, seed: int = 42) -> DataFrame:
    """The same by gradient-boosted trees fitted on the rows that ``train`` marks; rows with a null
    input go."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    made = VectorAssembler(inputCols=list(inputs), outputCol="__x", handleInvalid="skip").transform(df)
    model = GBTRegressor(featuresCol="__x", labelCol=target, predictionCol=f"pred_{target}", maxIter=max_iter, stepSize=step, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed).fit(made.filter(train & F.col(target).isNotNull()))
    return model.transform(made).withColumn(f"resid_{target}", F.col(target) - F.col(f"pred_{target}")).drop("__x")
