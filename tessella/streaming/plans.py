"""Live plans: a stream of query rows against the store, with the rate limit's state carried on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.config import Continuity
from tessella.operators.blocks import same
from tessella.operators.continuity import apply_continuity
from tessella.plans.engine import PlanningEngine
from tessella.sources.tables import release, settled
from tessella.streaming.continuity import LATE

#: Batches whose states are kept; only the one before the current batch is ever read.
STATES_KEPT = 8


def limited_after(rows: DataFrame, state: DataFrame | None, time: str, columns: Sequence[str], config: Continuity, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with their final values, the state after them). ``state``: of each series the time and
    final values of its last valid row, which is what the rows after it need to know. Rows with
    values and an older time are late: they get no final values and the status ``LATE``."""
    keys, columns = list(keys), list(columns)
    rows = rows.withColumns({c: F.col(c).cast("double") for c in columns})
    parts, late = rows.withColumn("__new", F.lit(1)), None
    if state is not None:
        seen = state.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(time).alias("__seen"))
        dated = rows.join(seen, same(keys, "__k_"), "left") if keys else rows.crossJoin(F.broadcast(seen))  # one row without keys
        behind = F.coalesce((F.col(time) < F.col("__seen")) & F.coalesce(*columns).isNotNull(), F.lit(False))
        parts = dated.filter(~behind).select(*rows.columns, F.lit(1).alias("__new"))
        late = dated.filter(behind).select(*rows.columns)
        parts = parts.unionByName(state.select(*keys, time, *columns, F.lit(0).alias("__new")), allowMissingColumns=True)
    done = apply_continuity(parts, time, columns, config, keys, after=["__new"])
    final = [F.struct(F.col(time).alias("t"), "__new", *columns, *[f"final_{c}" for c in columns])]
    valid = done.filter(F.coalesce(*columns).isNotNull() & F.col(time).isNotNull())
    last = valid.groupBy(*keys).agg(F.max(*final).alias("l")).filter("l is not null").select(*keys, F.col("l.t").alias(time), *[F.col(f"l.final_{c}").alias(c) for c in columns])
    out = done.filter("__new = 1").drop("__new")
    if late is not None:
        out = out.unionByName(late.withColumn("continuity_status", F.lit(LATE)), allowMissingColumns=True)
    return out, last


class LivePlans:
    """Plans for each batch of a stream of query rows (what ``PlanningEngine.queries_of`` takes), with
    continuity from batch to batch.

    A batch meets the store as a batch query does, by the engine's index, which is built once; rows of a series that share a time
    have one plan, of the best samples of all of them, which the limits see once. It writes its plans, its late
    rows and the state after it to folders of its own, which it replaces when it runs again: after a
    crash at any point the restarted query gives the same tables. A series that has been silent
    for ``expire_minutes`` before the newest row leaves the state.
    """

    def __init__(self, engine: PlanningEngine, path: str, time: str, keys: Sequence[str] = (), expire_minutes: float | None = None):
        how = engine.config.continuity
        if expire_minutes is not None and (not how.reset_on_time_gap or expire_minutes < how.max_gap_minutes):
            raise ValueError("state may only expire after a gap that resets")
        self.engine, self.path, self.time, self.keys, self.expire_minutes = engine, path.rstrip("/"), time, list(keys), expire_minutes
        self.columns = [f"plan_{c}" for c in engine.config.features.plan_center_cols]
        self.limits = Continuity(how.enable_rate_limit, {f"plan_{c}": v for c, v in how.rate_limits.items()}, how.reset_on_time_gap, how.max_gap_minutes)

    def _exists(self, path: str) -> bool:
        spark = self.engine.spark
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)

    def _state(self, number: int) -> DataFrame | None:
        path = f"{self.path}/state/batch={number}"
        return self.engine.spark.read.parquet(path) if number >= 0 and self._exists(path) else None

    def run_batch(self, batch: DataFrame, number: int) -> None:
        key = F.struct(*self.keys, self.time)
        plans = self.engine.plan(self.engine.queries_of(batch, key))
        one = [c for c in plans.columns if c != "qid"]  # rows that share series and time are one plan, which each of them gets
        plans = plans.groupBy("qid").agg(F.min(F.struct(*one)).alias("one"), F.count(F.lit(1)).cast("int").alias("__rows")).select("qid", "one.*", "__rows")
        batch_plans = settled(plans, "batch-plans")  # rows in time and late ones are read from here
        plans = batch_plans.withColumns({c: F.col("qid")[c] for c in [*self.keys, self.time]}).drop("qid")
        out, last = limited_after(plans, self._state(number - 1), self.time, self.columns, self.limits, self.keys)
        out = out.withColumn("__row", F.explode(F.array_repeat(F.lit(0), F.col("__rows")))).drop("__row", "__rows")
        done = f"{self.path}/all/batch={number}"
        out.write.mode("overwrite").parquet(done)  # once: plans and late rows are read from here
        if self.expire_minutes is not None:
            last = last.crossJoin(F.broadcast(last.agg(F.max(self.time).alias("__now")))).filter(F.col(self.time) >= F.col("__now") - F.expr(f"interval {round(self.expire_minutes * 60)} seconds")).drop("__now")  # one row
        last.write.mode("overwrite").parquet(f"{self.path}/state/batch={number}")
        release(batch_plans)
        old = self.engine.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/batch={number - STATES_KEPT}")
        old.getFileSystem(self.engine.spark._jsc.hadoopConfiguration()).delete(old, True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.run_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def plans(self) -> DataFrame:
        """All plans so far, with the number of their batch; without late rows."""
        return self.engine.spark.read.parquet(f"{self.path}/all").filter(F.col("continuity_status") != LATE)

    def late(self) -> DataFrame:
        """Rows that came after a newer one of their series."""
        return self.engine.spark.read.parquet(f"{self.path}/all").filter(F.col("continuity_status") == LATE)
