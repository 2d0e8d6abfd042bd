"""Continuity of plans over time: gap reset and rate limit, as an ordered fold per series."""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tessella.config import Continuity
from tessella.sources.tables import settled

NO_CENTER, RESET, FIRST, LIMITED, UNCHANGED = "no_valid_center", "time_gap_reset", "first_valid_point", "limited", "not_limited"


def with_gap_reset(df: DataFrame, time: str, valid: Column, max_gap_minutes: float, keys: Sequence[str] = ()) -> DataFrame:
    """Adds prev_ts, the time of the last valid row before, and reset: whether more than the
    allowed minutes lie between. No row before, or no time: no reset."""
    before = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    df = df.withColumn("prev_ts", F.last(F.when(valid, F.col(time)), ignorenulls=True).over(before))
    return df.withColumn("reset", F.coalesce(F.abs(micros(F.col(time)) - micros(F.col("prev_ts"))) > F.lit(max_gap_minutes * 60e6), F.lit(False)))


class LimitMap:
    """What some rows' rate limit makes of the value before them. A row's map, p to the value v kept
    within p - limit and p + limit, is monotone and made of pieces of slope 0 or 1; so are their
    compositions, held as knots with slope 1 outside. ``fixed``: the rows forget the value before."""

    def __init__(self):
        self.x, self.y, self.fixed, self.value = [0.0], [0.0], False, None

    def forget(self, value: float) -> None:
        self.fixed, self.value = True, value

    def _at(self, level: float) -> float | None:
        """Where the map reaches a level that no knot has."""
        k = bisect_left(self.y, level)
        if k < len(self.y) and self.y[k] == level:
            return None
        return self.x[0] - (self.y[0] - level) if k == 0 else self.x[k - 1] + (level - self.y[k - 1])

    def then(self, v: float, limit: float) -> None:
        """Appends a row with a value."""
        if self.fixed:
            p = self.value
            self.value = v if p != p or abs(v - p) <= limit else p + (limit if v > p else -limit)
            return
        if v != v:
            self.forget(v)
            return
        for level in (v - limit, v + limit):
            at = self._at(level)
            if at is not None:
                k = bisect_left(self.y, level)
                self.x.insert(k, at)
                self.y.insert(k, level)
        lo, hi = bisect_left(self.y, v - limit), bisect_right(self.y, v + limit) - 1
        ends = sorted({lo, hi})
        self.x = self.x[:lo] + [self.x[k] for k in ends] + self.x[hi + 1 :]
        self.y = [y + limit for y in self.y[:lo]] + [v] * len(ends) + [y - limit for y in self.y[hi + 1 :]]

    def __call__(self, p: float) -> float:
        if self.fixed:
            return self.value
        k = bisect_right(self.x, p) - 1
        if k < 0:
            return self.y[0] - (self.x[0] - p)
        if k == len(self.x) - 1:
            return self.y[k] + (p - self.x[k])
        return min(self.y[k] + (p - self.x[k]), self.y[k + 1])


def limited_values(v: np.ndarray, fresh: np.ndarray, limit: float | None, before: float) -> tuple[np.ndarray, np.ndarray]:
    """Final values of a column's rows in order, and which were limited. NaN: no value. At ``fresh``
    rows, or without a value before, the value passes. Only where a value jumps are rows followed
    one by one, until they have caught up."""
    out, hit = v.copy(), np.zeros(len(v), bool)
    if limit is None or not len(v):
        return out, hit
    jumps = np.flatnonzero((np.abs(np.diff(v, prepend=before)) > limit) & ~fresh)
    k = 0
    while k < len(jumps):
        i = int(jumps[k])
        p = float(v[i - 1]) if i else before
        while i < len(v):
            now = float(v[i])
            if fresh[i] or not abs(now - p) > limit:
                break
            p += limit if now > p else -limit
            out[i], hit[i] = p, True
            i += 1
        k = int(np.searchsorted(jumps, i + 1))
    return out, hit


class _Rows:
    """A batch's rows as arrays: validity, times, and where a series begins."""

    def __init__(self, batch: pa.RecordBatch, keys: Sequence[str], time: str, columns: Sequence[str]):
        self.series = list(zip(*(batch[k].to_pylist() for k in keys))) if keys else [()] * batch.num_rows
        t = batch[time].cast(pa.timestamp("us")).cast(pa.int64())
        self.times, self.timed = t.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(t.is_valid())
        self.null = [np.asarray(batch[c].is_null()) for c in columns]
        self.values = [batch[c].fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in columns]
        self.valid = ~np.logical_and.reduce(self.null) if columns else np.zeros(batch.num_rows, bool)


class _Fold:
    """The fold over rows in order, from batch to batch. ``state``: the series, the time of its last
    valid row (None: none, or without time), whether it had one, and its final values."""

    def __init__(self, limits: Sequence[float | None], max_gap: float | None, state=None):
        self.limits, self.max_gap = limits, max_gap
        self.series, self.last, self.begun, self.final = state or (None, None, False, [float("nan")] * len(limits))

    def gaps(self, rows: _Rows) -> tuple[np.ndarray, np.ndarray]:
        """(first row of its series in reach, reset) for each row."""
        n = len(rows.valid)
        first = np.array([a != b for a, b in zip(rows.series, [self.series, *rows.series[:-1]])], bool)
        at = np.where(rows.valid & rows.timed, np.arange(n), -1)
        seen = np.concatenate(([-1], np.maximum.accumulate(at)[:-1]))  # the last valid row with a time before
        begin = np.maximum.accumulate(np.where(first, np.arange(n), -1))
        known = seen >= np.maximum(begin, 0)
        before = np.where(known, rows.times[np.maximum(seen, 0)], 0)
        if self.last is not None:
            carried = ~known & (begin < 0)
            known, before = known | carried, np.where(carried, self.last, before)
        reset = known & rows.timed & (np.abs(rows.times - before) > self.max_gap) if self.max_gap is not None else np.zeros(n, bool)
        return first, reset

    def run(self, rows: _Rows):
        """Arrays (final values, status, number limited, reset) of the rows."""
        n = len(rows.valid)
        if not n:
            return [v for v in rows.values], np.zeros(0, object), np.zeros(0, np.int32), np.zeros(0, bool)
        first, reset = self.gaps(rows)
        own = np.flatnonzero(rows.valid)
        # a series' first valid row
        number = np.cumsum(first)
        opens = np.diff(number[own], prepend=-1) != 0
        if len(own) and number[own[0]] == 0 and self.begun:
            opens[0] = False
        fresh = opens | reset[own]
        count, finals, ends = np.zeros(n, np.int32), [], []
        for v, limit, before in zip(rows.values, self.limits, self.final):
            out, hit = limited_values(v[own], fresh, limit, before)
            whole = v.copy()
            whole[own] = out
            count[own] += hit
            finals.append(whole)
            ends.append(float(out[-1]) if len(out) else before)
        status = np.full(n, NO_CENTER, object)
        status[own] = np.select([reset[own], opens, count[own] > 0], [RESET, FIRST, LIMITED], UNCHANGED)
        stay = not first.any()
        self.series = rows.series[-1]
        last_own = own[number[own] == number[-1]]
        if len(last_own):
            self.begun, self.final = True, ends
            timed = last_own[rows.timed[last_own]]
            self.last = int(rows.times[timed[-1]]) if len(timed) else self.last if stay else None
        elif not stay:
            self.begun, self.last, self.final = False, None, [float("nan")] * len(self.limits)
        return finals, status, count, reset


class _Summary:
    """What a range of rows does to the state before it: its first series' maps, and the state after it."""

    def __init__(self, limits: Sequence[float | None], max_gap: float | None):
        self.limits, self.max_gap, self.fold = limits, max_gap, _Fold(limits, max_gap)
        self.first = None
        self.open, self.opened = True, None  # only rows of the first series so far; its first valid row's time
        self.maps, self.any = [LimitMap() for _ in limits], False

    def add(self, rows: _Rows) -> None:
        if not len(rows.valid):
            return
        if self.first is None:
            self.first = rows.series[0]
        if self.open:
            _, reset = self.fold.gaps(rows)
            for i in np.flatnonzero(rows.valid).tolist():
                if rows.series[i] != self.first:
                    break
                if not self.any:
                    self.any, self.opened = True, int(rows.times[i]) if rows.timed[i] else None
                for m, v, limit in zip(self.maps, rows.values, self.limits):
                    if limit is None or reset[i] or v[i] != v[i]:
                        m.forget(float(v[i]))
                    else:
                        m.then(float(v[i]), limit)
            self.open = rows.series[-1] == self.first
        self.fold.run(rows)

    def after(self, state):
        """The state after these rows, for the state before them."""
        f = self.fold
        own = (f.series, f.last, f.begun, f.final)
        if state is None or state[0] != self.first or not self.open:
            return own
        _, last, begun, final = state
        if not self.any:
            return (f.series, last if f.last is None else f.last, begun, final)
        gap = last is not None and self.opened is not None and self.max_gap is not None and abs(self.opened - last) > self.max_gap
        at = last if f.last is None else f.last
        if not begun or gap:
            return (f.series, at, True, f.final)
        # without a value before, a value passes, as at the start of a series
        return (f.series, at, True, [alone if p != p else m(p) for m, p, alone in zip(self.maps, final, f.final)])


def _starts(limits: Sequence[float | None], max_gap: float | None):
    def scan(ranges: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for part, raw in ranges.sort_values("__part")[["__part", "__summary"]].itertuples(index=False):
            out.append((part, pickle.dumps(state)))
            state = pickle.loads(raw).after(state)
        return pd.DataFrame(out, columns=["__of", "__state"])

    return scan


def apply_continuity(df: DataFrame, time: str, columns: Sequence[str], config: Continuity, keys: Sequence[str] = (), after: Sequence[str] = ()) -> DataFrame:
    """Per row reset, ``final_<column>``, continuity_status and limited_count.

    A row without any value passes as it is. After a gap, or without a valid row before, the
    values pass. Otherwise a value that is further than its limit from the last final value moves
    by the limit only. Rows that share a time are in the order of the columns ``after``, then of their
    values; rows without a time come first and are no gap's end.

    The recurrence is on final values, so it is a fold over time; but its rows' maps compose. The
    rows are sorted in ranges of series, time and values. Each range gives the composition of its
    rows' maps; the states between ranges follow from these, a row per range; then each range is folded from its
    own state. So one series of any length is many tasks.
    """
    columns, keys = list(columns), list(keys)
    others = [c for c in df.columns if c not in (time, *columns, *keys)]
    rows = df.select(*keys, time, *[F.col(c).cast("double").alias(c) for c in columns], *others)
    limits = [config.rate_limits.get(c) if config.enable_rate_limit else None for c in columns]
    max_gap = config.max_gap_minutes * 60e6 if config.reset_on_time_gap else None
    order = list(dict.fromkeys([*keys, time, *after, *columns]))
    kept = StructType([*[StructField(f.name, f.dataType) for f in rows.schema.fields], StructField("__part", IntegerType()), StructField("__at", LongType()), StructField("__summary", BinaryType())])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, part, at, batch = _Summary(limits, max_gap), TaskContext.get().partitionId(), 0, None
        extra = lambda parts, ats, summaries: [pa.array(parts, pa.int32()), pa.array(ats, pa.int64()), pa.array(summaries, pa.binary())]
        for batch in batches:
            summary.add(_Rows(batch, keys, time, columns))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra([part] * n, range(at, at + n), [None] * n)], names=kept.names)
            at += n
        if at:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in batch.schema], *extra([part], [-1], [pickle.dumps(summary)])], names=kept.names)

    ordered = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(summarise, kept), "continuity")
    starts = ordered.filter("__summary is not null").select("__part", "__summary").groupBy().applyInPandas(_starts(limits, max_gap), "__of int, __state binary")  # a row per range
    started = ordered.filter("__summary is null").drop("__summary").join(starts, F.col("__part") == F.col("__of")).drop("__of")
    names = [f"final_{c}" for c in columns]
    schema = StructType([*rows.schema.fields, StructField("reset", BooleanType()), *[StructField(n, DoubleType()) for n in names], StructField("continuity_status", StringType()), StructField("limited_count", IntegerType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, now = None, None
        for batch in batches:
            parts = batch["__part"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for lo, hi in zip(edges, edges[1:]):
                piece = batch.slice(lo, hi - lo)
                if hi > lo and parts[lo] != here:
                    here, now = parts[lo], _Fold(limits, max_gap, pickle.loads(piece["__state"][0].as_py()))
                if hi > lo:
                    read = _Rows(piece, keys, time, columns)
                    finals, status, count, reset = now.run(read)
                    added = [pa.array(f, pa.float64(), mask=null) for f, null in zip(finals, read.null)]
                    yield pa.RecordBatch.from_arrays([*piece.drop_columns(["__part", "__at", "__state"]).columns, pa.array(reset), *added, pa.array(status, pa.string()), pa.array(count, pa.int32())], names=schema.names)

    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return started.repartitionById(ranges, F.col("__part")).sortWithinPartitions("__part", "__at").mapInArrow(fold, schema)
