"""Streams: state that expires, late rows, restarts in the middle of a batch."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.config import Config, Continuity, Features, Gate, Matching
from tessella.operators import continuity as K
from tessella.plans.engine import PlanningEngine
from tessella.streaming import plans as live
from tessella.streaming.continuity import LATE, stream_continuity, use_state_store, write_parts

START = dt.datetime(2025, 1, 1)
HOW = Continuity(enable_rate_limit=True, rate_limits={"v": 3.0}, max_gap_minutes=30.0)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def files(spark, folder, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_rows_are_a_second_output(spark, tmp_path):
    use_state_store(spark)
    parts = [[("a", at(0), 1.0), ("a", at(3), 9.0), ("b", at(1), None)], [("a", at(1), 50.0), ("a", at(2), None), ("a", at(4), 9.0), ("b", at(0), 2.0)], [("a", at(3), 8.0), ("b", at(5), 9.0)]]
    stream = files(spark, str(tmp_path / "in"), parts, "k string, ts timestamp_ntz, v double")
    limited = stream_continuity(stream, "k", "ts", ["v"], HOW)
    query = write_parts(limited, str(tmp_path / "out"), str(tmp_path / "late"), str(tmp_path / "state"))
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    late = sorted(spark.read.parquet(str(tmp_path / "late")).collect(), key=lambda r: r["ts"])
    assert [(r["k"], r["ts"], r["v"], r["final_v"], r["continuity_status"]) for r in late] == [("a", at(1), 50.0, None, LATE), ("a", at(3), 8.0, None, LATE)]
    got = sorted((r["k"], r["ts"], r["final_v"] if r["final_v"] is not None else -1, r["continuity_status"]) for r in rows)
    assert got[:3] == [("a", at(0), 1.0, K.FIRST), ("a", at(2), -1, K.NO_CENTER), ("a", at(3), 4.0, K.LIMITED)]
    assert len(rows) + len(late) == sum(map(len, parts))


def test_a_restart_replaces_the_batch(spark, tmp_path):
    use_state_store(spark)
    stream = files(spark, str(tmp_path / "in"), [[("a", at(i), float(5 * i))] for i in range(4)], "k string, ts timestamp_ntz, v double")
    run = lambda: write_parts(stream_continuity(stream, "k", "ts", ["v"], HOW), str(tmp_path / "out"), str(tmp_path / "late"), str(tmp_path / "state"))
    run().awaitTermination()
    spark.createDataFrame([("a", at(9), 0.0)], "k string, ts timestamp_ntz, v double").write.mode("append").parquet(str(tmp_path / "in"))
    run().awaitTermination()
    got = sorted((r["ts"], r["final_v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [v for _, v in got] == [0.0, 3.0, 6.0, 9.0, 6.0]


def test_silent_series_leave_the_state(spark, tmp_path):
    use_state_store(spark)
    parts = [[(f"{b}-{i}", at(b * 600), 1.0) for i in range(30)] for b in range(4)]
    stream = files(spark, str(tmp_path / "in"), parts, "k string, ts timestamp_ntz, v double")
    query = write_parts(stream_continuity(stream, "k", "ts", ["v"], HOW, "0 minutes", 60.0), str(tmp_path / "out"), str(tmp_path / "late"), str(tmp_path / "state"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 60 and held[-1] == 30  # of 120 series
    with pytest.raises(ValueError):
        stream_continuity(stream, "k", "ts", ["v"], HOW, expire_minutes=5.0)


def engine(spark):
    rng = np.random.default_rng(0)
    store = spark.createDataFrame([(i, float(l), float(a), float(b), float(e)) for i, (l, a, b, e) in enumerate(zip(rng.uniform(90, 110, 80), rng.normal(0, 5, 80), rng.normal(0, 1, 80), rng.random(80)))], "pos long, load double, a double, b double, eff double")
    how = Continuity(enable_rate_limit=True, rate_limits={"a": 0.7}, max_gap_minutes=30.0)
    return PlanningEngine(spark, Config(features=Features(raw=("a", "b"), weights={"a": 0.5, "b": 0.5}, plan_center_cols=("a",)), gate=Gate(abs_threshold=5.0), matching=Matching(enable_low_sim_fallback=False), continuity=how), store)


def test_live_plans_survive_a_crash_and_equal_the_batch(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    schema = "s string, ts timestamp_ntz, load double, a double, b double"
    rows = [(s, at(20 * i + k), float(rng.uniform(85, 115)), float(rng.normal(0, 5)), float(rng.normal())) for i in range(15) for k, s in enumerate("xy") if not (s == "y" and 5 < i < 9)]
    rows.sort(key=lambda r: r[1])
    parts = [rows[:7], rows[7:9], rows[9:18], rows[18:20], rows[20:]]
    eng = engine(spark)
    stream = files(spark, str(tmp_path / "in"), parts, schema)
    mine = live.LivePlans(eng, str(tmp_path / "out"), "ts", ["s"], expire_minutes=200.0)
    whole, crashed = mine.run_batch, []

    def crash_once(batch, number):
        whole(batch, number)
        if number == 2 and not crashed:
            crashed.append(number)
            raise RuntimeError("the driver is lost")  # all is written, nothing is committed

    monkeypatch.setattr(mine, "run_batch", crash_once)
    with pytest.raises(Exception, match="the driver is lost"):
        mine.start(stream, str(tmp_path / "state")).awaitTermination()
    mine.start(stream, str(tmp_path / "state")).awaitTermination()
    shown = lambda df: sorted((r["s"], r["ts"], round(r["final_plan_a"], 9) if r["final_plan_a"] is not None else -99.0, r["continuity_status"]) for r in df.collect())
    assert crashed and shown(mine.plans()) == shown(eng.run_batch(spark.createDataFrame(rows, schema), keys=["s"])) and mine.late().count() == 0


def test_live_state_is_bounded_and_late_rows_are_kept(spark, tmp_path):
    schema = "s string, ts timestamp_ntz, load double, a double, b double"
    parts = [[(f"{b}", at(b * 100), 100.0, 1.0, 0.0)] for b in range(4)] + [[("3", at(50), 100.0, 9.0, 0.0), ("3", at(301), 100.0, 1.0, 0.0)]]
    mine = live.LivePlans(engine(spark), str(tmp_path / "out"), "ts", ["s"], expire_minutes=150.0)
    mine.start(files(spark, str(tmp_path / "in"), parts, schema), str(tmp_path / "state")).awaitTermination()
    assert [(r["s"], r["ts"], r["final_plan_a"]) for r in mine.late().collect()] == [("3", at(50), None)] and mine.plans().count() == 5
    assert sorted(r["s"] for r in spark.read.parquet(str(tmp_path / "out" / "state" / "batch=4")).collect()) == ["2", "3"]


def test_rows_of_a_series_that_share_a_time_have_one_plan(spark, tmp_path):
    schema = "s string, ts timestamp_ntz, load double, a double, b double"
    parts = [[("x", at(0), 100.0, 9.0, 0.0)], [("x", at(10), 100.0, -9.0, 0.0), ("x", at(10), 100.0, -9.0, 0.0), ("x", at(10), 100.0, 4.0, 1.0)]]
    mine = live.LivePlans(engine(spark), str(tmp_path / "out"), "ts", ["s"])
    mine.start(files(spark, str(tmp_path / "in"), parts, schema), str(tmp_path / "state")).awaitTermination()
    rows = mine.plans().filter(f"ts = timestamp_ntz'{at(10)}'").select("plan_a", "final_plan_a", "continuity_status").collect()
    assert len(rows) == 3 and len(set(rows)) == 1 and rows[0]["continuity_status"] == "limited"


def test_the_store_is_placed_once_for_all_batches(spark, tmp_path, monkeypatch):
    from tessella.operators import matching

    placed, settle = [], matching.settled
    monkeypatch.setattr(matching, "settled", lambda df, name: placed.append(name) or settle(df, name))
    schema = "s string, ts timestamp_ntz, load double, a double, b double"
    mine = live.LivePlans(engine(spark), str(tmp_path / "out"), "ts", ["s"])
    mine.start(files(spark, str(tmp_path / "in"), [[("x", at(10 * i), 100.0, float(i), 0.0)] for i in range(3)], schema), str(tmp_path / "state")).awaitTermination()
    assert mine.plans().count() == 3 and placed.count("points") == 1
