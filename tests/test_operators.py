"""Operators against plain Python on random, tie-heavy and null-heavy input."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.config import Config, Continuity, Features, Gate, Matching, Training
from tessella.operators import continuity, matching, sequences
from tessella.plans.engine import PlanningEngine
from tessella.plans.training import train


def loads(spark, name, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{'qid' if name == 'q_load' else 'pos'} int, {name} double")


@pytest.mark.parametrize("gate", [Gate(abs_threshold=15.0), Gate(mode="relative", rel_threshold=0.05)])
def test_gate_join_equals_all_pairs(spark, gate):
    rng = np.random.default_rng(1)
    q = [100.0, 0.0, -3.0, 1e-10, -1e-9, None, float("nan"), *np.round(rng.normal(0, 60, 40), 1).tolist()]
    x = [85.0, 115.0, 115.01, 96.0, 95.0, 0.0, 1e-10, -1e-10, 1.02e-9, None, *np.round(rng.normal(0, 60, 60), 1).tolist()]
    ok = lambda a, b: a is not None and b is not None and not math.isnan(a) and (abs(a - b) <= 15 if gate.mode == "absolute" else abs(a - b) / max(abs(b), 1e-9) <= 0.05)
    want = {(i, j) for i, a in enumerate(q) for j, b in enumerate(x) if ok(a, b)}
    rows = matching.gate_join(loads(spark, "q_load", q), loads(spark, "load", x), gate).select("qid", "pos").collect()
    assert len(rows) == len(want) and {(r["qid"], r["pos"]) for r in rows} == want


def test_nearest_by_load_over_several_blocks(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 50, 300), 0).tolist()
    q = [-500.0, 0.0, 12.0, 500.0]
    rows = matching.nearest_by_load(loads(spark, "q_load", q), loads(spark, "load", x), 3, near_rows=40).collect()
    for i, a in enumerate(q):
        want = sorted(range(len(x)), key=lambda j: (abs(x[j] - a), j))[:3]
        assert [r["pos"] for r in sorted((r for r in rows if r["qid"] == i), key=lambda r: r["rank"])] == want


def test_plan_statuses_and_centres(spark):
    store = spark.createDataFrame([(0, 100.0, 0.0, 10.0, 0.9, 1.0), (1, 101.0, 1.0, 20.0, 0.8, 0.5)], "pos int, load double, f double, v double, eff double, eff_score double")
    queries = spark.createDataFrame([(1, 100.0, 0.0, 7.0), (2, 900.0, 0.0, 8.0), (3, 100.0, 50.0, 9.0), (4, None, 0.0, 9.0)], "qid int, q_load double, q_f double, q_v double")
    m = np.array([[1.0]])
    plans = {r["qid"]: r for r in matching.plan_points(queries, store, ["f"], m, Gate(), Matching(), ["v"]).collect()}
    assert plans[1]["match_status"] == "matched" and plans[1]["plan_v"] == pytest.approx((10 * 1 + 20 * 0.5) / 1.5)
    assert plans[2]["match_status"] == plans[4]["match_status"] == "no_gate_hit" and plans[2]["plan_v"] is None and plans[2]["topk_count"] == 0
    assert plans[3]["match_status"] == "matched;low_similarity_fallback" and plans[3]["plan_v"] == 9.0 and plans[3]["center_source"] == "actual"
    how = Matching(allow_fallback_nearest_load=True, d_weight_e=1.0)
    near = {r["qid"]: r for r in matching.plan_points(queries, store, ["f"], m, Gate(), how, ["v"]).collect()}
    assert near[2]["match_status"] == "nearest_load;low_similarity_fallback" and near[2]["plan_v"] == 8.0
    assert near[2]["topk_pos"] == "0,1"
    with pytest.raises(ValueError):
        matching.plan_center(queries, [], Matching(plan_center_mode=7))


def limited(rows, limit, gap):
    """What the fold should give for rows (time, value)."""
    out, last, previous = [], None, None
    for t, v in rows:
        final = v
        if v is not None:
            if last is not None and (t - last).total_seconds() <= gap * 60 and abs(v - previous) > limit:
                final = previous + math.copysign(limit, v - previous)
            last, previous = t, final
        out.append(final)
    return out


def test_rate_limit_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    start, rows = datetime(2025, 1, 1), []
    for key in range(4):
        t = start
        for _ in range(60):
            t += timedelta(seconds=int(rng.choice([60, 299, 300, 301, 900])))
            rows.append((key, t, None if rng.random() < 0.2 else float(rng.integers(0, 20))))
    df = spark.createDataFrame(rows, "key int, ts timestamp_ntz, v double")
    how = Continuity(enable_rate_limit=True, rate_limits={"v": 3.0})
    got = continuity.apply_continuity(df, "ts", ["v"], how, ["key"]).collect()
    for key in range(4):
        own = [(t, v) for k, t, v in rows if k == key]
        assert [r["final_v"] for r in sorted((r for r in got if r["key"] == key), key=lambda r: r["ts"])] == limited(own, 3.0, 5.0)
    statuses = {r["continuity_status"] for r in got}
    assert statuses == {continuity.NO_CENTER, continuity.RESET, continuity.FIRST, continuity.LIMITED, continuity.UNCHANGED}


def test_stream_equals_batch(spark, tmp_path):
    from tessella.streaming.continuity import stream_continuity, use_state_store

    use_state_store(spark)
    start = datetime(2025, 1, 1)
    rows = [(k, start + timedelta(minutes=m), float(v)) for k in (0, 1) for m, v in zip((0, 1, 2, 3, 20, 21), (1, 9, 9, 2, 50, 40))]
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, v double")
    df.filter("minute(ts) < 3").coalesce(1).write.parquet(str(tmp_path / "a"))
    df.filter("minute(ts) >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    how = Continuity(enable_rate_limit=True, rate_limits={"v": 3.0})
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "a"))
    running = stream_continuity(stream, "key", "ts", ["v"], how).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    got = sorted((r["key"], r["ts"], r["final_v"], r["continuity_status"]) for r in spark.table("limited").collect())
    want = sorted((r["key"], r["ts"], r["final_v"], r["continuity_status"]) for r in continuity.apply_continuity(df, "ts", ["v"], how, ["key"]).collect())
    assert got == want and [g[2] for g in got[:6]] == [1.0, 4.0, 7.0, 4.0, 50.0, 47.0]


def warped(d, band):
    """Cost, mean similarity and length of the best path, by tables and a walk back."""
    n, m = d.shape
    w = max(band, abs(n - m)) if band > 0 else max(n, m)
    c = np.full((n + 1, m + 1), np.inf)
    c[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if abs(i - j) <= w:
                c[i, j] = d[i - 1, j - 1] + min(c[i - 1, j - 1], c[i - 1, j], c[i, j - 1])
    i, j, path = n, m, []
    while i and j:
        path.append(d[i - 1, j - 1])
        best = min(c[i - 1, j - 1], c[i - 1, j], c[i, j - 1])
        i, j = (i - 1, j - 1) if c[i - 1, j - 1] == best else (i - 1, j) if c[i - 1, j] == best else (i, j - 1)
    return c[n, m], float(np.mean([1 / (1 + x * x) for x in path])), len(path)


@pytest.mark.parametrize("band", [0, 1, 2])
def test_warping_equals_tables(spark, band):
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(0, 3, (5, 1)).astype(float), rng.integers(0, 3, (6, 1)).astype(float)) for _ in range(60)]
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(pairs)], "id int, a array<array<double>>, b array<array<double>>")
    for r in sequences.with_alignment(df, "a", "b", 5, 6, band).collect():
        a, b = pairs[r["id"]]
        cost, sim, length = warped(np.abs(a - b.T), band)
        assert (r["path_cost"], r["path_length"]) == (cost, length) and r["similarity"] == pytest.approx(sim)


def test_training_and_engine_end_to_end(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(l), float(a), float(2 * a + l + e), float(rng.random()), datetime(2025, 1, 1) + timedelta(minutes=i)) for i, (l, a, e) in enumerate(zip(rng.uniform(100, 140, 200), rng.normal(0, 1, 200), rng.normal(0, 0.1, 200)))]
    df = spark.createDataFrame(rows, "id int, load double, a double, b double, eff double, ts timestamp_ntz")
    features = Features(raw=("a", "b"), residual_targets=("b",), residual_inputs=("load", "a"), weights={"a": 1.0, "b": 1.0}, plan_center_cols=("a", "b"))
    config = Config(features=features, training=Training(filter_cols=("a",), filter_bins=4, max_bad_features=0, strata_bins={"load": 3}))
    trained = train(df, config, "id")
    assert trained.splits.count() == 3 and trained.models.filter("split = 'train'").first()["r2"] > 0.99
    engine = PlanningEngine(spark, config, trained.store.withColumnRenamed("id", "pos"), trained.cov_reg_inverse)
    minutes = df.withColumn("resid_b", F.lit(0.0))
    plans = engine.run_batch(minutes, "2025-01-01", "2025-01-01 00:59:00")
    assert plans.count() == 59 and plans.filter("plan_a is null").count() == 0
    weights = [{"a": 1.0, "b": 0.0, "resid_b": 0.0}, {"a": 0.0, "b": 1.0, "resid_b": 0.0}]
    both = engine.presets(engine.queries_of(minutes.limit(5), "id"), dict(zip("xy", weights)))
    assert both.groupBy("preset").count().count() == 2
    assert engine.details(engine.queries_of(minutes.limit(2), "id"), 3).count() == 6
    checked = PlanningEngine(spark, config, trained.store.withColumnRenamed("id", "pos").withColumn("window", F.lit("2025-01-01 00:00:00~2025-01-01 02:00:00")), trained.cov_reg_inverse).validation(minutes, 1)
    rows = checked.collect()
    assert {r["column"] for r in rows} == {"a", "b"} and len(rows) == 400 and all(r["match_status"].startswith("matched") and abs(r["top1_days"] - r["topk_mean_days"]) < 1e-9 for r in rows)
    assert all(abs(r["top1_days"] - abs((r["qid"] - datetime(2025, 1, 1, 1)).total_seconds()) / 86400) < 1e-9 for r in rows)
