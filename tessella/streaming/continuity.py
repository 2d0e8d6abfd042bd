"""The rate limit on streams, with typed state per series, expiry, and late rows kept apart."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.config import Continuity
from tessella.operators.continuity import _Fold, _Rows

LATE = "late_row"
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ContinuityProcessor(StatefulProcessor):
    """State of a series: the time of its last valid row and its final values. A timer of event time
    removes a series that has been silent for ``expire_ms``."""

    def __init__(self, key: str, time: str, columns: Sequence[str], limits: Sequence[float | None], max_gap: float | None, expire_ms: int | None):
        self.key, self.time, self.columns, self.limits, self.max_gap, self.expire_ms = key, time, list(columns), list(limits), max_gap, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "last long, final array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([self.time, *self.columns], na_position="first", ignore_index=True)
        last, final = self.state.get() if self.state.exists() else (None, None)
        at = batch[self.time].to_numpy().astype("datetime64[us]").astype(np.int64)
        has = batch[self.columns].notna().any(axis=1).to_numpy()
        late = has & (at < last) if last is not None else np.zeros(len(batch), bool)
        own = batch[~late].reset_index(drop=True)
        begun = final is not None
        fold = _Fold(self.limits, self.max_gap, ((), last, begun, [float("nan") if v is None else v for v in final] if begun else [float("nan")] * len(self.columns)))
        table = pa.RecordBatch.from_arrays([pa.array(own[self.time].to_numpy().astype("datetime64[us]")), *[pa.array(own[c].to_numpy(float), from_pandas=True) for c in self.columns]], names=[self.time, *self.columns])
        finals, status, _, _ = fold.run(_Rows(table, [], self.time, self.columns))
        if fold.begun and (has & ~late).any():
            self.state.update((fold.last, [None if v != v else v for v in fold.final]))
            if self.expire_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(fold.last // 1000 + self.expire_ms)
        out = pd.concat([own, batch[late]], ignore_index=True)
        empty = np.full(int(late.sum()), np.nan)
        for c, v in zip(self.columns, finals):
            out[f"final_{c}"] = np.concatenate((v, empty))
        out["continuity_status"] = [*status, *[LATE] * len(empty)]
        out[self.key] = key[0]
        yield out[[self.key, self.time, *self.columns, *[f"final_{c}" for c in self.columns], "continuity_status"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())


def use_state_store(spark: SparkSession) -> None:
    """Sets the session's state store, which streams of this module need, to the one on disk."""
    spark.conf.set(_PROVIDER, _ROCKS)


def stream_continuity(stream: DataFrame, key: str, time: str, columns: Sequence[str], config: Continuity, lateness: str = "10 minutes", expire_minutes: float | None = None) -> DataFrame:
    """As ``apply_continuity`` for a stream of rows (key, time, columns): per row ``final_<column>``
    and continuity_status. Rows of a batch are taken in order of time; NaN counts as null.

    A row with values that is older than its series' last one can't change what has been returned: it comes
    out with status ``LATE`` and no final values. No row is dropped: the watermark only tells
    when a series has been silent for ``expire_minutes`` (none: never) and its state goes. That may not be
    less than the gap that resets, and needs resets, so that final values don't depend on it;
    the next row of such a series is a first one. The session needs ``use_state_store``.
    """
    columns = list(columns)
    if expire_minutes is not None and (not config.reset_on_time_gap or expire_minutes < config.max_gap_minutes):
        raise ValueError("state may only expire after a gap that resets")
    limits = [config.rate_limits.get(c) if config.enable_rate_limit else None for c in columns]
    kinds = dict(stream.dtypes)
    marked = stream.withColumn("__event", F.col(time).cast("timestamp")).withWatermark("__event", lateness)
    rows = marked.select(key, time, *[F.col(c).cast("double").alias(c) for c in columns])  # without the watermark's column, so that no row is dropped as late
    fields = [f"`{key}` {kinds[key]}", f"`{time}` {kinds[time]}", *[f"`{c}` double" for c in columns], *[f"`final_{c}` double" for c in columns], "continuity_status string"]
    processor = ContinuityProcessor(key, time, columns, limits, config.max_gap_minutes * 60e6 if config.reset_on_time_gap else None, None if expire_minutes is None else int(expire_minutes * 60_000))
    return rows.groupBy(key).transformWithStateInPandas(processor, ", ".join(fields), "append", "EventTime")


def write_parts(limited: DataFrame, path: str, late_path: str, checkpoint: str, **trigger):
    """Starts a query that writes rows and late rows to a folder each. A batch has a folder of its
    own, which it replaces when it runs again, so that a restart leaves neither gaps nor copies."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            late = F.col("continuity_status") == LATE
            batch.filter(~late).write.mode("overwrite").parquet(f"{path}/batch={number}")
            batch.filter(late).write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        finally:
            batch.unpersist()

    return limited.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
