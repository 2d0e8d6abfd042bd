"""Models as artifacts, training and single plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.config import Config, Continuity, Features, Gate, Matching, Training
from tessella.operators import models
from tessella.operators.sampling import with_position
from tessella.plans.engine import PlanningEngine
from tessella.plans.training import train
from tessella.sources.tables import read_covariance


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x, z = rng.uniform(0, 10, 400), rng.uniform(0, 5, 400)
    made = [(i, float(100 + x[i]), float(x[i]), float(z[i]), float(2 * x[i] + z[i] + rng.normal(0, 0.1)), float(0.5 + x[i] / 100), f"2024-01-{1 + i % 28:02d} 00:00:00") for i in range(400)]
    return spark.createDataFrame(made, "id long, load double, x double, z double, y double, eff double, date string").withColumn("date", F.col("date").cast("timestamp_ntz")).cache()


def test_models_come_back_from_disk(spark, rows, tmp_path):
    trees = models.fit_trees(rows, ["x", "z"], "y", max_iter=3, depth=2)
    linear = models.fit_linear(rows, ["x", "z"], "y")
    models.save_models(spark, str(tmp_path / "m"), {"y": linear, "other": trees})
    back = models.load_models(spark, str(tmp_path / "m"), ["y", "other"])
    gap = rows.limit(5).unionByName(rows.limit(1).withColumn("z", F.lit(None).cast("double")))
    for name, model in (("y", linear), ("other", trees)):
        one, two = ([r["p"] for r in m.add(gap, "p").orderBy("id", "z").collect()] for m in (model, back[name]))
        assert one == two and sum(v is None for v in one) == 1
    with pytest.raises(ValueError, match="a.*b"):
        models.load_models(spark, str(tmp_path / "m"), ["a", "y", "b"])


def test_a_foreign_model_predicts(rows):
    model = models.ForeignModel(("x", "z"), lambda frame: frame["x"] * 2 + frame["z"])
    got = models.with_models(rows, {"y": model}).agg(F.max(F.abs("resid_y")).alias("m")).first()["m"]
    assert got < 0.5


@pytest.mark.parametrize("kind", ["linear", "trees"])
def test_training_and_planning(spark, rows, tmp_path, kind):
    features = Features(raw=("x", "z"), weights={"x": 1.0, "z": 1.0}, residual_targets=("y",), residual_inputs=("x", "z"), plan_center_cols=("load", "x"), column_aliases={})
    config = Config(features=features, matching=Matching(top_k=3), gate=Gate(abs_threshold=2.0), training=Training(model=kind, max_iter=2, max_depth=2, oof_n_splits=2), continuity=Continuity(enable_rate_limit=True, rate_limits={"x": 0.25}))
    trained = train(rows, config, "id")
    trained.write(str(tmp_path / "out"))
    report = {r["split"]: r for r in spark.read.parquet(str(tmp_path / "out/models")).collect()}
    assert set(report) == {"train", "valid", "test", "oof"} and report["oof"]["n"] == 400 and report["oof"]["full_model_fill_n"] == 0
    inverse = read_covariance(spark, str(tmp_path / "out/covariance"), features.similarity)
    fitted = models.load_models(spark, str(tmp_path / "out/fitted"), ["y"])
    engine = PlanningEngine(spark, config, spark.read.parquet(str(tmp_path / "out/store")), inverse, fitted)
    plan = engine.plan_one({"load": 105.0, "x": 5.0, "z": 2.0, "y": 12.0}, {"x": 1.0}).first()
    assert plan["topk_count"] == 3 and plan["final_x"] == 1.25
    far = engine.plan_row(rows.withColumn("load", F.col("load") + 1000), 3).first()
    assert far["match_status"].startswith("nearest_load")
    plans, details = engine.sample_run(rows, 2, 3)
    assert plans.count() == 6 and details.count() == 18
    assert engine.validation(rows, 2).count() > 0


def test_last_month_is_left_out(spark, rows):
    features = Features(raw=("x", "z"), plan_center_cols=("load",))
    newest = spark.sql("SELECT timestamp_ntz'2024-02-11 00:00:00' AS t")
    got = train(rows, Config(features=features), "id", newest=newest, newest_col="t").store.count()
    assert got == rows.filter("date < '2024-01-11'").count()


def test_positions_are_the_same_in_every_run(spark, rows):
    first, second = ({r["id"]: r["pos"] for r in with_position(df, ["load", "id"]).collect()} for df in (rows, rows.repartition(7)))
    assert first == second and sorted(first.values()) == list(range(400))
