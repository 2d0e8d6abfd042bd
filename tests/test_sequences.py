"""Sequence windows over blocks with halos, by series and with steps, against plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import queries as library
from tessella.config import Sequence
from tessella.operators import blocks, sequences

START = dt.datetime(2025, 1, 1)


def grid_rows(seed, n=150, series="x"):
    rng = np.random.default_rng(seed)
    load = np.repeat(rng.choice([50.0, 60.0, 90.0], n // 6 + 1), 6)[:n] + rng.normal(0, 2, n)
    return [(series, START + dt.timedelta(minutes=int(i) * 7), None if rng.random() < 0.03 else float(v), float(rng.normal()), float(rng.normal())) for i, v in enumerate(load)]


def starts_by_loop(rows, config, every):
    """Per query (its row's number from 1) the first rows of its windows."""
    q, m, out = config.query_len, config.candidate_len, {}
    t = [r[1] for r in rows]
    load = np.array([np.nan if r[2] is None else r[2] for r in rows])
    x = np.array([r[3:] for r in rows])
    for end in range(every - 1, len(rows), every):
        if end + 1 < q:
            continue
        lo = next(i for i in range(len(rows)) if t[i] >= t[end] - dt.timedelta(days=config.ref_days))
        ref, hi = range(lo, end - q + 1), end - q + 1
        mean = np.nanmean(load[hi : end + 1])
        near = [abs(load[i] - mean) <= config.load_threshold for i in ref]
        runs, i = [], 0
        while i < len(near):
            j = i
            while j < len(near) and near[j]:
                j += 1
            if j - i >= q:
                runs.append((lo + i, lo + j))
            i = max(j, i + 1)
        if not runs or runs == [(lo, hi)]:
            found = list(range(lo, hi - q + 1, config.slide_step))
        else:
            sim = lambda s: np.mean([1 / (1 + np.sum((x[hi + k] - x[s + k]) ** 2)) for k in range(q)])
            found = [s for a, b in runs for s in range(a, b - q + 1, config.prefilter_step) if sim(s) >= config.sim_threshold] or [a for a, _ in runs]
        found = [s + 1 for s in found if s + m <= hi]
        if found and len(ref) >= m:
            out[end + 1] = sorted(found)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, load double, a double, b double").repartition(3)


@pytest.mark.parametrize("prefilter_step,slide_step,threshold", [(1, 1, 0.3), (2, 3, 0.3), (3, 2, 0.99)])
def test_window_starts_equal_a_loop(spark, monkeypatch, prefilter_step, slide_step, threshold):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    rows = grid_rows(prefilter_step)
    config = Sequence(ref_days=0.4, load_threshold=7.0, sim_threshold=threshold, prefilter_step=prefilter_step, slide_step=slide_step)
    grid = sequences.numbered(table(spark, rows), "ts")
    got = {}
    for r in sequences.candidates(grid, ["a", "b"], config, F.col("rn") % 4 == 0).collect():
        got.setdefault(r["qid"], []).append(r["start"])
        assert r["candidate"] == [list(x[3:]) for x in rows[r["start"] - 1 : r["start"] - 1 + config.candidate_len]]
    assert {k: sorted(v) for k, v in got.items()} == starts_by_loop(rows, config, 4)


def test_two_series_equal_two_runs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    config = Sequence(ref_days=0.4, load_threshold=7.0, sim_threshold=0.3)
    parts = {"x": grid_rows(5, 90), None: grid_rows(6, 60, None), "y": grid_rows(7, 8, "y")}
    run = lambda rows, keys: sequences.planned_sequences(sequences.numbered(table(spark, rows), "ts", keys), ["a", "b"], ["load"], config, F.col("rn") % 4 == 0, keys=keys)
    both = run([r for rows in parts.values() for r in rows], ["series"])
    columns = [c for c in both.columns if c != "series"]
    for name, rows in parts.items():
        one = run(rows, []).select(*columns).collect()
        assert sorted(map(str, both.filter(F.col("series").eqNullSafe(F.lit(name))).select(*columns).collect())) == sorted(map(str, one))
    status = {(r["series"], r["qid"]): r["match_status"] for r in both.collect()}
    assert status["y", 4] == status["y", 8] == sequences.TOO_FEW_ROWS and sequences.SEQUENCE_MATCHED in status.values() and len(status) == 22 + 15 + 2


def test_runs_and_totals_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 4)
    rng = np.random.default_rng(1)
    flags = rng.random(200) < 0.8
    df = spark.createDataFrame([(i + 1, bool(f), float(i)) for i, f in enumerate(flags)], "rn long, f boolean, load double").repartition(5)
    got = sorted((r["first_rn"], r["last_rn"], r["length"], r["mean_load"]) for r in sequences.load_runs(df, F.col("f")).collect())
    want, i = [], 0
    while i < len(flags):
        j = i
        while j < len(flags) and flags[j]:
            j += 1
        if j > i:
            want.append((i + 1, j, j - i, float(np.mean(np.arange(i, j)))))
        i = max(j, i + 1)
    assert got == want
    totals = blocks.with_running_total(df, [], F.col("rn"), "total").collect()
    assert all(r["total"] == r["rn"] * (r["rn"] + 1) // 2 for r in totals) and len(totals) == 200


def test_no_task_has_a_whole_series(spark, data):
    for name in ("dtw_topk", "window_prefilter"):
        assert "SinglePartition" not in library.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_empty_grid(spark):
    grid = sequences.numbered(table(spark, []), "ts", ["series"])
    assert sequences.planned_sequences(grid, ["a"], ["load"], Sequence(), F.lit(True), keys=["series"]).count() == 0
