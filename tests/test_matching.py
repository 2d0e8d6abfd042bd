"""The best pairs by cells of a whitened space against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.config import Gate, Matching
from tessella.operators import leaves
from tessella.operators import matching as M

METRIC = np.array([[1.0, 0.4, 0.0], [0.4, 2.0, 0.0], [0.0, 0.0, 0.0]])


@pytest.mark.parametrize("gate,matching", [
    (Gate(abs_threshold=8.0), Matching()), (Gate(mode="relative", rel_threshold=0.1), Matching(d_weight_s=0.6, d_weight_e=0.4)),
    (Gate(enable=False), Matching(top_k=3)), (Gate(abs_threshold=0.5), Matching(d_weight_s=0.0, d_weight_e=1.0)), (Gate(abs_threshold=30.0), Matching(d_weight_s=0.9, d_weight_e=-0.3)),
])
def test_best_pairs_equal_all_pairs(spark, gate, matching):
    rng = np.random.default_rng(3)
    n = 400
    x = np.round(rng.normal(size=(n, 3)) * [3, 1, 1], 1)
    x[50:70] = x[50]  # ties go to the smaller position
    load, eff = np.round(rng.uniform(80, 120, n)), rng.random(n)
    store = spark.createDataFrame([(i, float(l), *[None if (i + j) % 97 == 0 else float(v) for j, v in enumerate(r)], float(e)) for i, (l, r, e) in enumerate(zip(load, x, eff))], "pos long, load double, a double, b double, c double, eff_score double")
    filled = np.array([[0.0 if (i + j) % 97 == 0 else v for j, v in enumerate(r)] for i, r in enumerate(x)])
    queries = store.filter("pos % 10 = 0").select(F.col("pos").alias("qid"), F.col("load").alias("q_load"), F.col("a").alias("q_a"), F.col("b").alias("q_b"), F.col("c").alias("q_c"))
    metrics = {"one": METRIC, "two": np.diag([0.01, 0.0, 5.0])}
    for metric in (METRIC, metrics):
        asked = queries.withColumn("preset", F.explode(F.array(F.lit("one"), F.lit("two")))) if metric is metrics else queries
        rows = M.best_pairs(asked, store, ["a", "b", "c"], metric, gate, matching).collect()
        got = {}
        for r in rows:
            got.setdefault((r["qid"], r["preset"] if metric is metrics else "one"), {})[r["rank"]] = (r["pos"], r["d"])
            assert (r["a"], r["q_b"]) == (filled[r["pos"]][0], filled[r["qid"]][1])
        for name, m in (metrics.items() if metric is metrics else [("one", METRIC)]):
            for q in range(0, n, 10):
                apart = filled - filled[q]
                s = 1 / (1 + np.maximum(np.einsum("ij,jk,ik->i", apart, m, apart), 0))
                d = matching.d_weight_s * s + (matching.d_weight_e * eff if matching.d_weight_e else 0)
                near = np.ones(n, bool) if not gate.enable else np.abs(load - load[q]) <= gate.abs_threshold if gate.mode == "absolute" else np.abs(load - load[q]) / np.abs(load) <= gate.rel_threshold
                order = sorted(np.flatnonzero(near), key=lambda i: (-round(d[i], 12), i))[: matching.top_k]
                mine = [got[q, name][i + 1] for i in range(len(got[q, name]))]
                assert np.allclose([v for _, v in mine], d[order]) and sorted(p for p, _ in mine if abs(_ - d[order[-1]]) > 1e-9) == sorted(i for i in order if abs(d[i] - d[order[-1]]) > 1e-9)


@pytest.mark.parametrize("gate,matching", [
    (Gate(abs_threshold=8.0), Matching(d_weight_s=0.8, d_weight_e=0.2)), (Gate(mode="relative", rel_threshold=0.1), Matching()),
    (Gate(enable=False), Matching(d_weight_s=0.5, d_weight_e=0.5)), (Gate(abs_threshold=30.0), Matching(d_weight_s=-0.4, d_weight_e=-0.3)),
])
def test_best_pairs_of_many_regions(spark, monkeypatch, gate, matching):
    """As above, with regions of about 16 points, dealt ones among them, and crowds of 8 queries."""
    monkeypatch.setattr(M, "REGION", 8)
    monkeypatch.setattr(M, "FEW", 16)
    monkeypatch.setattr(M, "CROWD", 8)
    test_best_pairs_equal_all_pairs(spark, gate, matching)


@pytest.mark.parametrize("gate,matching", [(Gate(abs_threshold=8.0), Matching(d_weight_s=0.8, d_weight_e=0.2)), (Gate(mode="relative", rel_threshold=0.1), Matching()), (Gate(enable=False), Matching(d_weight_s=0.0, d_weight_e=1.0))])
@pytest.mark.parametrize("same", [False, True])
def test_leaves_find_the_best(gate, matching, same):
    """Leaf by leaf against all points: ties by first position, scores without value last."""
    rng = np.random.default_rng(11)
    n, m, k = 3000, 200, 5
    x, q = rng.normal(size=(3, n)), rng.normal(size=(3, m))
    load, q_load, e = rng.uniform(80, 120, n), rng.uniform(75, 125, m), np.round(rng.random(n), 2)
    if same:
        x[:], q[:] = 1.0, 1.0
    first, adds = rng.permutation(n), matching.d_weight_e * e
    adds[rng.random(n) < 0.05] = leaves.NONE
    if gate.mode == "relative":
        adds[:] = 0.0
    bar = np.where(np.arange(m) % 3 == 0, 0.5, leaves.NONE)
    own, point, s = leaves.Leaves(x, load, adds, first, 1, gate, matching).best(x, q, q_load, bar, k)
    for i in range(m):
        alike = 1 / (1 + ((x - q[:, i : i + 1]) ** 2).sum(0))
        score = matching.d_weight_s * alike + adds
        inside = np.flatnonzero(leaves.passes(gate)(q_load[i], load) & (score >= bar[i]))
        want = sorted(inside, key=lambda p: (-score[p], first[p]))[:k]
        assert sorted(point[own == i]) == sorted(want) and np.allclose(s[own == i], alike[point[own == i]])


def test_queries_are_not_spread_over_cells(spark):
    """With blended scores a query is a row for each region that it meets; no step has rows per query and cell."""
    rng = np.random.default_rng(7)
    n = 40_000
    store = spark.createDataFrame(pd.DataFrame({"pos": range(n), "load": rng.uniform(0, 100, n), **{c: rng.normal(size=n) for c in "abcd"}, "eff_score": rng.random(n)}))
    asked = store.filter("pos % 100 = 0").select(F.col("pos").alias("qid"), F.col("load").alias("q_load"), *[F.col(c).alias(f"q_{c}") for c in "abcd"])
    rows = M.best_pairs(asked, store, list("abcd"), np.eye(4), Gate(abs_threshold=50.0), Matching(d_weight_s=0.8, d_weight_e=0.2))
    assert rows.count() == 5 * 400
    rows.collect()
    most, todo = 0, [rows._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        if name == "GenerateExec":
            most = max(most, node.metrics().apply("numOutputRows").value())
    assert 0 < most <= 400 * 30


def test_no_samples_and_no_queries(spark):
    schema = "pos long, load double, a double, eff_score double"
    empty = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(1, 5.0, 1.0, 0.5), (2, None, 1.0, 0.5), (3, 5.0, float("nan"), None)], schema)
    asked = lambda df: df.select(F.col("pos").alias("qid"), F.col("load").alias("q_load"), F.col("a").alias("q_a"))
    run = lambda q, s: M.best_pairs(asked(q), s, ["a"], np.eye(1), Gate(), Matching()).collect()
    assert run(some, empty) == [] and run(empty, some) == []
    assert sorted((r["qid"], r["pos"], r["rank"]) for r in run(some, some)) == [(1, 1, 1), (1, 3, 2), (3, 1, 2), (3, 3, 1)]


def test_rows_that_share_a_qid_are_one_query(spark):
    store = spark.createDataFrame([(i, 5.0, float(i // 8), 0.5) for i in range(64)], "pos long, load double, a double, eff_score double")
    asked = spark.createDataFrame([(1, 5.0, 0.2), (1, 5.0, 0.2), (1, 5.0, 3.1), (2, 5.0, 2.0), (2, 5.0, 2.0)], "qid long, q_load double, q_a double")
    rows = M.best_pairs(asked, store, ["a"], np.eye(1), Gate(), Matching(top_k=5)).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["rank"], r["pos"]) for r in rows] == [(1, i + 1, p) for i, p in enumerate([24, 25, 26, 27, 28])] + [(2, i + 1, p) for i, p in enumerate([16, 16, 17, 17, 18])]


def test_pairs_in_question_dont_grow_with_copies(spark):
    """Copies of samples and of queries, and queries far from all loads, add no pairs to what is ranked."""
    copies = 40
    rng = np.random.default_rng(5)
    base = [(float(l), float(a), float(b)) for l, a, b in zip(rng.uniform(0, 100, 200), rng.normal(size=200), rng.normal(size=200))]
    store = spark.createDataFrame([(i + 200 * c, l, a, b, 0.5) for c in range(copies) for i, (l, a, b) in enumerate(base)], "pos long, load double, a double, b double, eff_score double")
    asked = store.filter("pos % 10 = 0").select(F.col("pos").alias("qid"), F.col("load").alias("q_load"), F.col("a").alias("q_a"), F.col("b").alias("q_b"))
    far = asked.withColumn("qid", F.col("qid") + 1_000_000).withColumn("q_load", F.lit(1e9) + F.col("q_load"))
    rows = M.best_pairs(asked.unionByName(far), store, ["a", "b"], np.eye(2), Gate(abs_threshold=20.0), Matching(top_k=5))
    got = rows.collect()
    assert len(got) == 5 * asked.count() and all(r["s"] == 1.0 and r["pos"] == r["qid"] % 200 + 200 * (r["rank"] - 1) for r in got)
    joins, todo = [], [rows._jdf.queryExecution().executedPlan()]
    while todo:  # rows made by the plan's joins
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        if name.endswith("JoinExec"):
            joins.append(node.metrics().apply("numOutputRows").value())
    assert joins and max(joins) <= 5 * asked.count()


def test_nearest_by_load_ranks_few_pairs(spark):
    """Queries above all loads, and loads with more samples than a block, against all pairs."""
    loads = [1.0] * 700 + [2.0] * 3 + [float(x) for x in range(10, 900)]
    store = spark.createDataFrame([(i, l) for i, l in enumerate(loads)], "pos long, load double")
    asked = spark.createDataFrame([(i, q) for i, q in enumerate([1e6, 1e6, -5.0, 1.5, 6.0, 455.5, 899.0, 899.0])], "qid long, q_load double")
    rows = M.nearest_by_load(asked, store, 4, near_rows=64)
    got = {}
    for r in rows.collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["pos"]
    for i, q in enumerate([1e6, 1e6, -5.0, 1.5, 6.0, 455.5, 899.0, 899.0]):
        assert [got[i][r] for r in range(1, 5)] == sorted(range(len(loads)), key=lambda p: (abs(q - loads[p]), p))[:4]
