"""Totals over ranges against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.config import Gate
from tessella.operators import matching as M
from tessella.operators.ranges import range_totals

TOTALS = {"n": (1, F.sum), "first": ("pos", F.min), "last": ("pos", F.max)}


def test_range_totals_equal_all_rows(spark):
    rng = np.random.default_rng(7)
    at = [int(v) for v in rng.integers(0, 900, 1500)]
    spans = [(int(l), int(l + w)) for l, w in zip(rng.integers(-50, 950, 60), rng.integers(0, 700, 60))] + [(5, 4), (-9, 2000), (-9, -5)]
    rows = spark.createDataFrame(list(enumerate(at)), "pos long, at long")
    asked = spark.createDataFrame(spans, "low long, high long")
    got = sorted(tuple(r) for r in range_totals(asked, "low", "high", rows, "at", TOTALS).collect())
    inside = [(l, h, [p for p, v in enumerate(at) if l <= v <= h]) for l, h in spans]
    assert got == sorted((l, h, len(p), min(p), max(p)) for l, h, p in inside if p)


@pytest.mark.parametrize("gate", [Gate(abs_threshold=0.3), Gate(mode="relative", rel_threshold=0.2), Gate(enable=False)])
def test_gate_totals_equal_pairs(spark, gate):
    """Ends that differ by rounding are decided by the gate; loads of 0 and below 0 too."""
    loads = [round(0.1 * i, 1) for i in range(-40, 300)] * 2 + [0.0, 1e-9, -2e-9, None, float("nan")]
    store = spark.createDataFrame(list(enumerate(loads)), "pos long, load double")
    asked = store.filter("pos % 3 = 0").select(F.col("pos").alias("qid"), F.col("load").alias("q_load"))
    got = M.gate_totals(asked, store, gate, TOTALS)
    pairs = M.gate_join(asked, store, gate).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    plan = got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect())) and "__node" in plan
