"""Distances and kernels as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.columns import zero_filled


def squared_distance(a: Sequence[Column], b: Sequence[Column], metric: np.ndarray) -> Column:
    """(a - b)' M (a - b), not below 0; null, NaN and infinite components are 0. Components whose
    row of M is 0 don't appear."""
    d = [zero_filled(x) - zero_filled(y) for x, y in zip(a, b)]
    terms = []
    for i in range(len(d)):
        if metric[i, i]:
            terms.append(F.lit(float(metric[i, i])) * d[i] * d[i])
        terms += [F.lit(float(metric[i, j] + metric[j, i])) * d[i] * d[j] for j in range(i + 1, len(d)) if metric[i, j] or metric[j, i]]
    return F.greatest(sum(terms[1:], terms[0]) if terms else F.lit(0.0), F.lit(0.0))


def whitening(metric: np.ndarray) -> np.ndarray:
    """L with M = L' L, a row for each eigenvalue that isn't 0: distances become plain sums. Components
    are scaled to a diagonal of 1 first, so that those with small weights keep their digits."""
    scale = np.sqrt(np.maximum(np.diag(metric), 0))
    inverse = np.divide(1, scale, out=np.zeros_like(scale), where=scale > 0)
    values, vectors = np.linalg.eigh(inverse[:, None] * (metric + metric.T) / 2 * inverse[None, :])
    keep = values > 1e-12
    return (vectors[:, keep] * np.sqrt(values[keep])).T * scale[None, :]


def whitened(columns: Sequence[Column], metric: np.ndarray) -> list[Column]:
    filled = [zero_filled(c) for c in columns]
    out = []
    for row in whitening(metric):
        terms = [F.lit(float(w)) * c for w, c in zip(row, filled) if w]
        out.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
    return out


def cauchy(squared: Column) -> Column:
    return 1 / (1 + squared)


def cosine01(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 of arrays, between 0 and 1; 0.5 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(dot(a, b) / F.nullif(norm, F.lit(0.0)), F.lit(0.0)) + 1) / 2))
