"""Boosted trees on cells against boosting row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import boosting


def by_rows(x, y, edges, rounds, rate, depth, leaves, least, l2):
    """Rows are split one leaf at a time, the leaf that gains most first."""
    bins = np.stack([np.where(np.isnan(c), max(1, len(e) - 1), np.clip(np.searchsorted(e, c, "left") - 1, 0, max(0, len(e) - 2))) for c, e in zip(x.T, edges)], 1)
    now = np.full(len(y), y.mean())
    for _ in range(rounds):
        r = y - now
        score = lambda rows: r[rows].sum() ** 2 / (len(rows) + l2)
        tree = [(np.arange(len(y)), 0)]

        def split(rows, level):
            best = (1e-9 * max(1.0, abs(score(rows))), None)
            for f in range(bins.shape[1]) if level < depth else ():
                for b in range(bins[:, f].max()):
                    low, high = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                    if len(low) >= least and len(high) >= least and score(low) + score(high) - score(rows) > best[0] * (1 + 1e-12):
                        best = (score(low) + score(high) - score(rows), (low, high))
            return best

        splits = [split(*leaf) for leaf in tree]
        while len(tree) < leaves and any(s[1] is not None for s in splits):
            k = max((i for i, s in enumerate(splits) if s[1] is not None), key=lambda i: splits[i][0])
            level = tree[k][1] + 1
            low, high = splits[k][1]
            tree[k : k + 1] = []
            splits[k : k + 1] = []
            tree += [(low, level), (high, level)]
            splits += [split(low, level), split(high, level)]
        for rows, _ in tree:
            now[rows] += rate * r[rows].sum() / (len(rows) + l2)
    return now


def data(n=500):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(n, 2)), 2)
    y = 3 * x[:, 0] + np.where(x[:, 1] > 0.3, 5, 0) + rng.normal(0, 0.3, n)
    x[rng.random((n, 2)) < 0.05] = np.nan
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r], float(t), i % 4) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, y double, fold int").repartition(3)


def test_cells_give_what_rows_give(spark):
    x, y = data()
    how = dict(rounds=12, rate=0.1, depth=3, leaves=6, least=20, l2=1.0)
    model = boosting.fit_boosted(frame(spark, x, y), ["a", "b"], "y", bins=8, **how)[None]
    assert np.allclose(model.predict(list(x.T)), by_rows(x, y, model.edges, **how), atol=1e-9)
    assert [len(e) for e in model.edges] == [9, 9] and np.allclose(model.edges[0], np.quantile(x[~np.isnan(x[:, 0]), 0], np.linspace(0, 1, 9)))


def test_full_size_out_of_fold(spark):
    x, y = data()
    df = frame(spark, x, y)
    models = boosting.fit_boosted(df, ["a", "b"], "y", "fold")
    rows = boosting.with_boosted_residuals(df, models, "y", "fold").collect()
    assert sorted(models, key=str) == [0, 1, 2, 3, None] and len(rows) == 500
    out = np.array([r["resid_y"] for r in rows])
    assert 0.3 < np.sqrt(np.mean(out**2)) < 1.5 < np.std(y)
    k = 2
    alone = boosting.fit_boosted(df.filter(F.col("fold") != k), ["a", "b"], "y")[None]
    same = boosting.BoostedTrees(alone.inputs, models[k].edges, models[k].table)
    mine = [r["pred_y"] for r in sorted(rows, key=lambda r: r["id"]) if r["fold"] == k]
    own = [i for i in range(500) if i % 4 == k]
    assert np.allclose(mine, same.predict(list(x[own].T)))


def test_edges_of_boosting(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None), (float("nan"), 3.0)], "a double, y double")
    models = boosting.fit_boosted(df, ["a"], "y")
    assert [r["pred_y"] for r in boosting.with_boosted_residuals(df, models, "y").collect()] == [2.0, 2.0, 2.0]
    with pytest.raises(ValueError):
        boosting.fit_boosted(df.filter("y > 9"), ["a"], "y")
    with pytest.raises(ValueError):
        boosting.fit_boosted(df, ["a"] * 5, "y")
