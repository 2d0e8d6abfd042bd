"""Hand-computed cases of columns, statistics, similarity and configuration."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import config
from tessella.functions import columns as C
from tessella.functions import similarity, stats
from tessella.operators.sampling import split_sizes, with_folds, with_group_places


def values(df, column):
    return [r[column] for r in df.collect()]


def test_percentile_rank_shares_ties(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 5.0), (5, None)], "id int, v double")
    out = {r["id"]: r["e"] for r in stats.with_percentile_rank(df, "v", "e").collect()}
    assert out == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0, 5: None}
    assert values(stats.with_percentile_rank(df.filter("id = 1"), "v", "e"), "e") == [1.0]
    assert stats.with_percentile_rank(df.filter("id > 9"), "v", "e").count() == 0


def test_percentile_rank_equals_ranks_of_many_values(spark):
    x = np.round(np.random.default_rng(0).normal(size=700), 2)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, v double")
    out = {r["id"]: r["e"] for r in stats.with_percentile_rank(df, "v", "e").collect()}
    want = [((x < v).sum() + ((x == v).sum() + 1) / 2) / len(x) for v in x]
    assert np.allclose([out[i] for i in range(len(x))], want)


def test_quantile_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, None)], "v double")
    out = {r["v"]: r["v_bin"] for r in stats.with_quantile_bins(df, {"v": 2}).collect()}
    assert out == {1.0: 0, 2.0: 0, 3.0: 1, 4.0: 1, None: None}


@pytest.mark.parametrize("n, sizes", [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (4, (2, 1, 1)), (10, (7, 2, 1)), (15, (10, 2, 3))])
def test_split_sizes(spark, n, sizes):
    train, valid = split_sizes(F.lit(n))
    row = spark.range(1).select(train.alias("t"), valid.alias("v")).first()
    if n == 4:  # 2.8 rounds to 3, and then nothing is left for testing
        assert (row["t"], row["v"], n - row["t"] - row["v"]) == sizes
    else:
        assert (row["t"], row["v"], n - row["t"] - row["v"]) == sizes


def test_covariance_and_weights():
    assert config.weight_vector(["a", "b"], {"a": 3.0, "b": -1.0}) == [1.0, 0.0]
    with pytest.raises(ValueError):
        config.weight_vector(["a"], {})
    f = config.Features(raw=("a", "b"), residual_targets=("b",), weights={"a": 1.0, "b": 0.5})
    assert config.feature_weights(f) == {"a": 1.0, "b": 0.5, "resid_b": 0.25}
    m = stats.weighted_inverse(np.array([[2.0, 0.5], [0.5, 1.0]]), [0.6, 0.4])
    assert np.allclose(m, np.sqrt(np.outer([0.6, 0.4], [0.6, 0.4])) * np.linalg.inv([[2.0, 0.5], [0.5, 1.0]]))
    w = similarity.whitening(m)
    assert np.allclose(w.T @ w, m)


def test_distance_whitening_and_cosine(spark):
    m = np.array([[2.0, 0.3], [0.3, 1.0]])
    df = spark.createDataFrame([(1.0, 2.0, 3.0, float("nan"))], "a double, b double, p double, q double")
    row = df.select(
        similarity.squared_distance([F.col("a"), F.col("b")], [F.col("p"), F.col("q")], m).alias("d"),
        F.array(*similarity.whitened([F.col("a"), F.col("b")], m)).alias("x"), F.array(*similarity.whitened([F.col("p"), F.col("q")], m)).alias("y"),
        similarity.cosine01(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-2.0), F.lit(0.0))).alias("c"), similarity.cosine01(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"),
        similarity.cauchy(F.lit(3.0)).alias("k"),
    ).first()
    d = np.array([-2.0, 2.0])  # NaN counts as 0
    assert row["d"] == pytest.approx(d @ m @ d)
    assert np.sum((np.array(row["x"]) - np.array(row["y"])) ** 2) == pytest.approx(row["d"])
    assert (row["c"], row["z"], row["k"]) == (0.0, 0.5, 0.25)


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, "3", "x")], "a int, old int, n string, bad string")
    assert C.renamed(df, {"old": "new"}).columns == ["a", "new", "n", "bad"]
    assert C.renamed(df, {"old": "a"}).columns == ["a", "n", "bad"]
    assert C.copied(df, {"old": "new"}).columns == ["a", "old", "n", "bad", "new"]
    assert C.numeric(df, ["n", "bad"]).select("n", "bad").first() == (3.0, None)
    assert C.first_of_duplicates(df.select("a", "old", "a")).columns == ["a", "old"]
    with pytest.raises(ValueError, match="zz"):
        C.require(df, ["a", "zz"])
    with pytest.raises(ValueError):
        C.features(df, ["zz"])
    assert df.select(*C.features(df, ["zz"], lenient=True)).first() == (0.0,)


def test_time_bounds_and_ranges(spark):
    assert C.time_bound("2025-01-02", True) == datetime(2025, 1, 3)
    assert C.time_bound("2025-01-02 10:00:00", True) == datetime(2025, 1, 2, 10)
    df = spark.sql("select timestamp_ntz'2025-01-02 23:59:59.999' ts union all select timestamp_ntz'2025-01-03' union all select null")
    assert C.in_range(df, "ts", "2025-01-01", "2025-01-02").count() == 1
    assert C.time_column(df) == "ts"
    row = spark.range(1).select(C.window_midpoint(F.lit("2025-01-01 00:00:00~2025-01-01 00:10:00")).alias("m"), C.window_midpoint(F.lit("no")).alias("n")).first()
    assert row["m"].minute == 5 and row["n"] is None


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0), (None, 1.0)], "y double, p double")
    row = stats.regression_metrics(df, "y", "p").first()
    assert row["n"] == 3 and row["mae"] == pytest.approx(0.5) and row["r2"] == pytest.approx(1 - 1.25 / (14 / 3))


def test_config_merges_and_checks(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"matching": {"top_k": 3}, "features": {"raw": ["a"]}}')
    made = config.load_config(str(path), {"matching": {"d_weight_e": 0.5}})
    assert (made.matching.top_k, made.matching.d_weight_e, made.features.raw) == (3, 0.5, ("a",))
    for bad in ({"matching": {"d_weight_s": 0.0}}, {"features": {"plan_center_cols": ["z"]}}, {"gate": {"mode": "?"}}, {"what": 1}):
        with pytest.raises(ValueError):
            config.load_config(None, bad)


def test_quantiles_and_places_in_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(None if g == 3 else int(g), i, float(v) if rng.random() > 0.1 else None, float(np.round(w, 1))) for i, (g, v, w) in enumerate(zip(rng.integers(0, 4, 400), rng.normal(size=400), rng.normal(size=400)))]
    df = spark.createDataFrame([*rows, (9, 400, None, 1.0)], "g int, id int, v double, w double").repartition(6)
    table = {r["g"]: r for r in stats.quantile_table(df, {"v": [0.02, 0.5, 0.98], "w": [0.25]}, ["g"]).collect()}
    for g in (0, 1, 2, None):
        own = [r for r in rows if r[0] == g]
        assert np.allclose(table[g]["v_q"], np.quantile([r[2] for r in own if r[2] is not None], [0.02, 0.5, 0.98]))
        assert np.allclose(table[g]["w_q"], np.quantile([r[3] for r in own], [0.25]))
    assert table[9]["v_q"] is None and table[9]["w_q"] == [1.0]
    placed = with_group_places(df, ["g"], ["w", "id"])
    for g in (0, 1, 2, None, 9):
        own = sorted((r["w"], r["id"], r["__place"], r["__n"]) for r in placed.collect() if r["g"] == g)
        assert [o[2] for o in own] == list(range(len(own))) and {o[3] for o in own} == {len(own)}


def test_one_stratum_is_many_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).select(F.lit("all").alias("strata"), "id")
        folds = with_folds(df, "id")
        sizes = [r["count"] for r in folds.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 3 and max(sizes) < 1500
        assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [600] * 5
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_whitening_keeps_small_weights():
    m = np.diag([1e-10, 4e3, 1.0])
    m[0, 2] = m[2, 0] = 5e-6
    w = similarity.whitening(m)
    assert np.allclose(w.T @ w, m, rtol=1e-12, atol=0) or np.max(np.abs(w.T @ w - m) / np.sqrt(np.outer(np.diag(m), np.diag(m)))) < 1e-12


def test_shipped_names_of_a_configuration(tmp_path):
    shipped = tmp_path / "shipped.json"
    shipped.write_text("""{"features": {"raw_features": ["a", "b"], "residual_targets": ["b"], "plan_center_cols": ["a", "load"], "load_col": "load", "heat_value_col": "h", "weights": {"a": 1.0}},
      "flow_gate": {"enable": true, "mode": "relative", "rel_threshold": 0.1}, "paths": {"cache_path": null}, "optimize": {"x": 1}, "time_col": null,
      "continuity": {"enable_rate_limit": true, "rate_limit_features": ["a"], "rate_limit_abs": {"a": 2.0, "b": 3.0}, "max_gap_minutes": 7},
      "train": {"enable_filter": false, "filter_cols": ["a"], "filter_n_bins": 9, "test_ratio": 0.15, "residual_model_params": {"max_iter": 50, "l2_regularization": 2.0, "random_state": 7}},
      "dtw_query": {"query_seq_len": 4, "dtw_max_len": 5, "n_workers": 4, "slide_step": 3, "prefilter": {"enable": false, "slide_step": 2, "sim_threshold": 0.6}}}""")
    c = config.load_config(str(shipped), {"flow_gate": {"rel_threshold": 0.2}, "matching": {"top_k": 3}})
    assert c.features.raw == ("a", "b") and c.gate == config.Gate(mode="relative", rel_threshold=0.2) and c.matching.top_k == 3
    assert c.continuity.rate_limits == {"a": 2.0} and c.continuity.max_gap_minutes == 7
    assert (c.training.filter_cols, c.training.filter_bins, c.training.max_iter, c.training.l2, c.training.seed) == ((), 9, 50, 2.0, 7)
    assert (c.sequence.query_len, c.sequence.candidate_len, c.sequence.slide_step, c.sequence.prefilter, c.sequence.prefilter_step, c.sequence.sim_threshold) == (4, 5, 3, False, 2, 0.6)
    with pytest.raises(ValueError, match="unheard"):
        config.load_config(None, {"unheard": 1})
