"""The rate limit as a scan of composed maps against a plain fold; streams against the batch form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessella.config import Continuity
from tessella.operators import continuity as K

START = dt.datetime(2024, 1, 1)
LIMITS = {"a": 3.0, "b": 0.5}


def plain(rows, limits, gap_minutes):
    """(final a, final b, c, status, number limited, reset) of rows (time, a, b, c) in order."""
    last = seen = None
    out = []
    for t, *values in rows:
        reset = gap_minutes is not None and seen is not None and t is not None and abs((t - seen).total_seconds()) > gap_minutes * 60
        now, changed = list(values), 0
        if last is not None and not reset:
            for i, name in enumerate("abc"):
                limit, v, p = limits.get(name), values[i], last[i]
                if limit is not None and v is not None and p is not None and abs(v - p) > limit:
                    now[i], changed = p + (limit if v > p else -limit), changed + 1
        has = any(v is not None for v in values)
        status = K.NO_CENTER if not has else K.RESET if reset else K.FIRST if last is None else K.LIMITED if changed else K.UNCHANGED
        out.append((*now, status, changed, reset))
        if has:
            last, seen = now, t if t is not None else seen
    return out


def series(rng, n, jumpy=4.0):
    t, level, rows = START, 0.0, []
    for _ in range(n):
        t += dt.timedelta(seconds=rng.choice([0, 60, 60, 60, 300, 4000]))
        level += rng.gauss(0, jumpy)
        rows.append((t if rng.random() > 0.02 else None, *[None if rng.random() < p else round(level * k + rng.gauss(0, 2), 3) for p, k in ((0.1, 1), (0.3, 0.2), (0.5, 1))]))
        if rng.random() < 0.1:
            rows[-1] = (rows[-1][0], None, None, None)
    key = lambda r: tuple((x is not None, x if x is not None else START if i == 0 else 0.0) for i, x in enumerate(r))
    return sorted(rows, key=key)


@pytest.fixture
def many_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,gap", [(1, None), (2, 45.0), (3, None), (4, 45.0)])
def test_scan_equals_the_fold(spark, many_tasks, seed, gap):
    rng = random.Random(seed)
    rows = series(rng, 400, 0.3 if seed > 2 else 4.0)
    how = Continuity(enable_rate_limit=True, rate_limits=LIMITS, max_gap_minutes=gap or 0.0, reset_on_time_gap=gap is not None)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "ts timestamp_ntz, a double, b double, c double, __row long").repartition(5)
    got = K.apply_continuity(df, "ts", ["a", "b", "c"], how)
    assert got.drop("__row").columns == ["ts", "a", "b", "c", "reset", "final_a", "final_b", "final_c", "continuity_status", "limited_count"]
    mine = [(r["final_a"], r["final_b"], r["final_c"], r["continuity_status"], r["limited_count"], r["reset"]) for r in sorted(got.collect(), key=lambda r: r["__row"])]
    want = plain(rows, LIMITS, gap)
    alike = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-9)
    groups = {}
    for r, x, y in zip(rows, mine, want):  # rows that agree in all columns are alike
        groups.setdefault(r, ([], []))
        groups[r][0].append(x)
        groups[r][1].append(y)
    for x, y in groups.values():
        for p, q in zip(sorted(x, key=str), sorted(y, key=str)):
            assert all(map(alike, p, q)), (p, q)


def test_series_by_key_in_one_range_order(spark, many_tasks):
    rng = random.Random(7)
    rows = {k: series(rng, n) for k, n in (("x", 150), ("y", 1), ("z", 90), (None, 40))}
    how = Continuity(enable_rate_limit=True, rate_limits=LIMITS, max_gap_minutes=45.0)
    df = spark.createDataFrame([(k, *r) for k, own in rows.items() for r in own], "name string, ts timestamp_ntz, a double, b double, c double").repartition(3)
    got = K.apply_continuity(df, "ts", ["a", "b", "c"], how, ["name"]).collect()
    for k, own in rows.items():
        mine = sorted(str([r["ts"], *[None if x is None else round(x, 9) for x in (r["final_a"], r["final_b"], r["final_c"])], r["continuity_status"], r["limited_count"], r["reset"]]) for r in got if r["name"] == k)
        want = sorted(str([r[0], *[None if x is None else round(x, 9) for x in w[:3]], *w[3:]]) for r, w in zip(own, plain(own, LIMITS, 45.0)))
        assert mine == want


def test_no_rows_and_no_values(spark):
    how = Continuity(enable_rate_limit=True, rate_limits=LIMITS)
    schema = "ts timestamp_ntz, a double, b double"
    assert K.apply_continuity(spark.createDataFrame([], schema), "ts", ["a", "b"], how).count() == 0
    got = K.apply_continuity(spark.createDataFrame([(START, None, None), (None, None, 1.0)], schema), "ts", ["a", "b"], how).collect()
    assert sorted((r["continuity_status"], r["final_b"]) for r in got) == [(K.FIRST, 1.0), (K.NO_CENTER, None)]


def test_many_rows_are_many_tasks(spark, many_tasks):
    """As many rows as a year and a quarter of minutes; only a summary of each range meets in one task."""
    n = 674_002
    df = spark.range(n).selectExpr("timestamp_micros(id * 60000000)::timestamp_ntz AS ts", "100 * sin(id / 50) + 9 * sin(id * id) AS a")
    got = K.apply_continuity(df, "ts", ["a"], Continuity(enable_rate_limit=True, rate_limits={"a": 1.0}))
    single = [line for line in got._jdf.queryExecution().executedPlan().toString().split("Exchange SinglePartition")[1:]]
    assert len(single) == 1 and "ReadSchema: struct<__part:int,__summary:binary>" in single[0]
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == n and len(sizes) > 4 and max(sizes) < n / 2


def test_composed_maps_equal_their_steps():
    rng = random.Random(3)
    for _ in range(200):
        m, limit = K.LimitMap(), rng.choice([0.5, 1.0, 4.0])
        steps = [rng.gauss(0, 5) for _ in range(rng.randint(1, 40))]
        for v in steps:
            m.then(v, limit)
        for p in [rng.gauss(0, 20) for _ in range(20)] + [steps[0]]:
            q = p
            for v in steps:
                q = v if abs(v - q) <= limit else q + (limit if v > q else -limit)
            assert abs(m(p) - q) < 1e-9
