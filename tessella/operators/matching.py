"""Point queries: load gate, similarity, top-k and plan centre, for all queries in one plan."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessella.config import Gate, Matching
from tessella.functions.columns import zero_filled
from tessella.functions.similarity import cauchy, squared_distance, whitening
from tessella.functions.stats import running_sums
from tessella.operators.leaves import NONE, region_search
from tessella.operators.ranges import range_totals
from tessella.sources.tables import release, settled

#: Status texts of results.
MATCHED, NEAREST_LOAD, NO_GATE_HIT, LOW_SIMILARITY = "matched", "nearest_load", "no_gate_hit", "low_similarity_fallback"

#: Points of a region, about; fewest of them, where there are cores for more regions; queries that meet a
#: region's points at once; most cells along an axis.
REGION, FEW, CROWD, MOST_CELLS = 65_536, 4_096, 65_536, 64


def gate_condition(query_load: Column, load: Column, gate: Gate) -> Column:
    """Whether a sample's load is near enough; relative deviations are of the sample's load."""
    if not gate.enable:
        return F.lit(True)
    if gate.mode == "absolute":
        return F.abs(query_load - load) <= gate.abs_threshold
    if gate.mode == "relative":
        return F.abs(query_load - load) / F.greatest(F.abs(load), F.lit(1e-9)) <= gate.rel_threshold
    raise ValueError(f"unknown gate mode {gate.mode!r}")


def _has_zones(gate: Gate) -> bool:
    """A gate that is off, or a relative one of 1 or more, has no buckets."""
    return gate.enable and (gate.mode == "absolute" or gate.rel_threshold < 0.999999)


def _zone_width(gate: Gate) -> float | None:
    """The least width of a bucket, of logarithms if the gate is relative; None without buckets."""
    if not _has_zones(gate):
        return None
    return max(gate.abs_threshold, 1e-12) if gate.mode == "absolute" else -math.log1p(-min(gate.rel_threshold, 0.999999))


def _zones(load: Column, gate: Gate, width: float | None = None) -> tuple[Column, Column]:
    """(side, bucket) such that a query and a sample that pass the gate have sides that are equal
    or 0 and buckets at most 1 apart. Buckets may be wider than the gate asks for."""
    width = width or _zone_width(gate)
    if gate.enable and gate.mode == "absolute":
        return F.lit(0), F.floor(load / width)
    if width is None:
        return F.lit(0), F.lit(0).cast("long")
    size = F.greatest(F.abs(load), F.lit(1e-9))
    return F.when(F.abs(load) <= 2e-9, 0).otherwise(F.signum(load).cast("int")), F.floor(F.log(size) / width)


def _placed(store: DataFrame, gate: Gate, load: str = "load", width: float | None = None) -> DataFrame:
    """Adds the side and the bucket (__side, __bucket) of each sample's load."""
    side, bucket = _zones(F.col(load), gate, width)
    return store.withColumn("__side", side).withColumn("__bucket", bucket)


def _spread(queries: DataFrame, gate: Gate, query_load: str = "q_load", width: float | None = None) -> DataFrame:
    """Each query under the sides and buckets whose samples may pass."""
    side, bucket = _zones(F.col(query_load), gate, width)
    if not _has_zones(gate):
        return queries.withColumn("__side", side).withColumn("__bucket", bucket)
    sides = F.array(side)
    if gate.mode == "relative":
        sides = F.when(side == 0, F.array(F.lit(0), F.lit(1), F.lit(-1))).otherwise(F.array(side, F.lit(0)))
    return queries.withColumn("__side", F.explode(sides)).withColumn("__bucket", F.explode(F.sequence(bucket - 1, bucket + 1)))


def gate_join(queries: DataFrame, store: DataFrame, gate: Gate, query_load: str = "q_load", load: str = "load", extra: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """All pairs that pass the load gate, by an equi-join on load buckets: each query goes to its
    own bucket and the two next to it. Null and NaN loads pass nothing. ``extra`` names columns
    of either side that must be equal too. A gate that is off, or a relative one of 1 or more, has
    no buckets: a stated set of queries then meets all rows, by ``extra`` where there is one."""
    queries = queries.filter(F.col(query_load).isNotNull() & ~F.isnan(query_load))
    store = store.filter(F.col(load).isNotNull() & ~F.isnan(load))
    condition = gate_condition(F.col(query_load), F.col(load), gate)
    for a, b in extra:
        condition &= F.col(a) == F.col(b)
    if not _has_zones(gate):
        return queries.join(store, condition)
    placed = _placed(store, gate, load).withColumnsRenamed({"__side": "__s", "__bucket": "__b"})
    spread = _spread(queries, gate, query_load)
    return spread.join(placed, (F.col("__side") == F.col("__s")) & (F.col("__bucket") == F.col("__b")) & condition).drop("__side", "__bucket", "__s", "__b")


def gate_totals(queries: DataFrame, store: DataFrame, gate: Gate, totals: dict) -> DataFrame:
    """qid and totals (see ``range_totals``) over the samples inside the gate of each query. What passes
    is a range of loads; the condition itself decides at its ends. Loads next to 0, whose relative
    gate is another, and gates without buckets go by pairs."""
    loads = queries.filter(F.col("q_load").isNotNull() & ~F.isnan("q_load")).select("q_load").distinct()
    by_pairs = F.lit(not _has_zones(gate))
    if gate.mode == "absolute":
        low, high = F.col("q_load") - gate.abs_threshold, F.col("q_load") + gate.abs_threshold
    else:
        by_pairs = by_pairs | (F.abs("q_load") < 1e-6)
        ends = [F.col("q_load") / (1 + gate.rel_threshold), F.col("q_load") / max(1 - gate.rel_threshold, 1e-6)]
        low, high = F.least(*ends), F.greatest(*ends)
    slack = F.greatest(F.abs("q_load"), F.abs(low), F.abs(high)) * 4e-16
    asked = loads.filter(~by_pairs).select("q_load", (low - slack).alias("__low"), (high + slack).alias("__high"))
    held = store.filter(F.col("load").isNotNull() & ~F.isnan("load"))
    found = range_totals(asked, "__low", "__high", held, "load", totals, gate_condition(F.col("q_load"), F.col("__v"), gate)).drop("__low", "__high")
    pairs = gate_join(loads.filter(by_pairs), held, gate).groupBy("q_load").agg(*[merge(F.col(c) if isinstance(c, str) else F.lit(c)).alias(n) for n, (c, merge) in totals.items()])
    found = found.unionByName(pairs).withColumnRenamed("q_load", "__load")
    return queries.join(found, F.col("q_load") == F.col("__load")).select("qid", *totals)


def scored(pairs: DataFrame, features: Sequence[str], metric: np.ndarray, matching: Matching, eff_score: str | None = "eff_score") -> DataFrame:
    """Adds s (similarity), e and d (blended) to pairs that hold ``q_<feature>`` and ``<feature>``."""
    s = cauchy(squared_distance([F.col(f"q_{c}") for c in features], [F.col(c) for c in features], metric))
    return blended(pairs.withColumn("s", s), matching, eff_score)


def blended(pairs: DataFrame, matching: Matching, eff_score: str | None = "eff_score") -> DataFrame:
    """Adds e and d to pairs that hold s."""
    e = F.col(eff_score) if eff_score else F.lit(None).cast("double")
    blend = F.lit(matching.d_weight_s) * F.col("s")
    if matching.d_weight_e:
        blend = blend + F.lit(matching.d_weight_e) * F.col("e")
    return pairs.withColumn("e", e).withColumn("d", blend)


def top_k(pairs: DataFrame, k: int, query: str | Sequence[str] = "qid", score: str = "d", tie: str = "pos") -> DataFrame:
    """The ``k`` best rows of each query with their rank from 1; null scores last, ties by ``tie``."""
    order = Window.partitionBy(*([query] if isinstance(query, str) else query)).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _first_rows(df: DataFrame, same: Sequence[str], k: int, order: Column) -> DataFrame:
    """At most ``k`` rows of each group, the first by ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*same).orderBy(order))).filter(F.col("__n") <= k).drop("__n")


class _Cells:
    """Cells of a whitened space, the same for all presets: edges along each axis (quantiles of the
    points, more of them where it is wider), so chosen that a cell in a load bucket has about
    ``REGION`` points, or fewer where cores would have none."""

    def __init__(self, points: DataFrame, features: Sequence[str], metrics: dict, gate: Gate):
        self.features, self.gate = features, gate
        whole = sum(metrics.values(), np.zeros((len(features), len(features))))
        self.base = whitening(whole)
        # each preset's distance is at least that of the gaps along these axes, by weights
        out = np.linalg.pinv(self.base)
        self.weights: dict = {}
        for name, metric in metrics.items():
            own = out.T @ ((metric + metric.T) / 2) @ out if len(metrics) > 1 else np.eye(len(self.base))
            scale = np.sqrt(np.where(np.diag(own) > 1e-9, np.diag(own), 0.0))
            inverse = np.divide(1, scale, out=np.zeros_like(scale), where=scale > 0)
            own = (inverse[:, None] * own * inverse[None, :])[scale > 0][:, scale > 0]
            least = max(0.0, float(np.linalg.eigvalsh(own)[0])) if len(own) else 0.0
            self.weights[name] = [float(least * v * v) * (1 - 1e-9) for v in scale]
        self.axes = range(len(self.base))
        steps = [i / MOST_CELLS for i in range(1, MOST_CELLS)]
        size = F.log(F.greatest(F.abs("load"), F.lit(1e-9))) if gate.enable and gate.mode == "relative" else F.col("load")
        figures = [F.count(F.lit(1)).alias("n"), F.min(size).alias("l0"), F.max(size).alias("l1")]
        figures += [f for i, v in enumerate(self.along("")) for f in (F.stddev_pop(v).alias(f"s{i}"), F.percentile_approx(v, steps, 1000).alias(f"x{i}"))]
        found = points.agg(*figures).first()  # some numbers of each axis
        cores = points.sparkSession.sparkContext.defaultParallelism
        self.n = found["n"]
        wanted = max(self.n / REGION, min(4.0 * cores, self.n / FEW))
        # buckets are wider than the gate where there would be too many
        self.width, buckets = _zone_width(gate), 1.0
        if self.width is not None and self.n:
            reach = found["l1"] - found["l0"]
            if math.isfinite(reach) and reach > 0:
                self.width = max(self.width, reach / max(1.0, self.n / FEW))
                buckets = max(1.0, reach / self.width)
        wanted = max(1.0, wanted / buckets)
        spread = [found[f"s{i}"] or 0.0 for i in self.axes]
        low, high = 1e-12, max([1.0, *spread]) * 2
        for _ in range(60):  # the width of a cell, by halving
            middle = math.sqrt(low * high)
            low, high = (middle, high) if math.prod(max(1.0, s / middle) for s in spread) > wanted else (low, middle)
        pick = lambda q, c: sorted({q[i * MOST_CELLS // c - 1] for i in range(1, c)}) if q else []
        self.edges = [pick(found[f"x{i}"], min(MOST_CELLS, max(1, round(s / high)))) for i, s in enumerate(spread)]

    def along(self, prefix: str) -> list[Column]:
        """A row's coordinates."""
        return [sum((F.lit(float(x)) * F.col(f"{prefix}{c}") for x, c in zip(w, self.features) if x), F.lit(0.0)) for w in self.base]

    def cell(self, v: Column, i: int) -> Column:
        return sum(((v >= F.lit(float(e))).cast("int") for e in self.edges[i]), F.lit(0))


class PointIndex:
    """Samples of a store, placed for queries (see ``best_pairs``); once built, it answers any number
    of batches of queries.

    1. Samples with equal values are one point, of which only the ``k`` smallest positions can be
       among the best.
    2. Points lie in regions of about ``REGION``: cells of a whitened space within load buckets, the
       larger ones dealt. Each region's bounds are a row.
    """

    def __init__(self, store: DataFrame, features: Sequence[str], metric: np.ndarray | dict[str, np.ndarray], gate: Gate, matching: Matching, k: int | None = None):
        self.k, self.several = k or matching.top_k, isinstance(metric, dict)
        self.features, self.gate, self.matching = list(features), gate, matching
        self.metrics = metric if self.several else {"": metric}
        filled = [zero_filled(F.col(c)).alias(c) for c in self.features]
        held = store.filter(F.col("load").isNotNull() & ~F.isnan("load")).select("pos", "load", F.col("eff_score").cast("double").alias("eff_score"), *filled)
        values = ["load", "eff_score", *self.features]
        points = settled(_first_rows(held, values, self.k, F.col("pos")).groupBy(*values).agg(F.sort_array(F.collect_list("pos")).alias("__pos")), "points")  # at most k positions
        self.cells = _Cells(points, self.features, self.metrics, gate)
        self.at = ["__side", "__bucket", *[f"__cell{i}" for i in self.cells.axes]]
        own = self.cells.along("")
        placed = _placed(points, gate, width=self.cells.width).withColumns({f"__cell{i}": self.cells.cell(v, i) for i, v in enumerate(own)}).withColumns({f"__x{i}": v for i, v in enumerate(own)})
        ends = [f for i in self.cells.axes for f in (F.min(f"__x{i}").alias(f"__low{i}"), F.max(f"__x{i}").alias(f"__high{i}"))]
        ends += [F.min("load").alias("__l0"), F.max("load").alias("__l1"), F.min("eff_score").alias("__e0"), F.max("eff_score").alias("__e1")]
        regions = placed.groupBy(*self.at).agg(F.ceil(F.count(F.lit(1)) / (2 * REGION)).alias("__deals"), *ends)
        self.regions = settled(regions.withColumn("__region", F.monotonically_increasing_id()), "regions")  # a row per region
        named = self.regions.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(self.at)], "__region", "__deals")
        same = F.lit(True)
        for i, c in enumerate(self.at):
            same &= F.col(c) == F.col(f"__r{i}")
        deal = F.pmod(F.xxhash64(*values), F.col("__deals")).cast("int").alias("__deal")
        self.points = settled(placed.join(F.broadcast(named), same).select("__region", deal, *values, "__pos"), "placed")
        release(points)
        self.parts = max(4 * store.sparkSession.sparkContext.defaultParallelism, self.cells.n // 250_000)

    def _near(self, asked: DataFrame) -> DataFrame:
        """Each query with the regions of its buckets that its gate may reach, and __most, which no score there is above."""
        w_s, w_e = float(self.matching.d_weight_s), float(self.matching.d_weight_e or 0.0)
        regions = self.regions.withColumnsRenamed({"__side": "__s", "__bucket": "__b"})
        spread = _spread(asked, self.gate, width=self.cells.width).join(F.broadcast(regions), (F.col("__side") == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
        if self.gate.enable and self.gate.mode == "absolute":
            spread = spread.filter(F.greatest(F.col("__l0") - F.col("q_load"), F.col("q_load") - F.col("__l1")) <= self.gate.abs_threshold)
        apart = F.lit(0.0)
        for i, v in enumerate(self.cells.along("q_")):
            gap = F.greatest(F.col(f"__low{i}") - v, v - F.col(f"__high{i}"), F.lit(0.0))
            weight = F.element_at(F.array(*[F.lit(w[i]) for w in self.cells.weights.values()]), F.col("__preset") + 1) if self.several else F.lit(self.cells.weights[""][i])
            apart = apart + weight * gap * gap
        adds = F.coalesce(F.greatest(F.lit(w_e) * F.col("__e0"), F.lit(w_e) * F.col("__e1")), F.lit(NONE)) if w_e else F.lit(0.0)
        return spread.withColumn("__most", (F.lit(w_s) * cauchy(apart) if w_s > 0 else F.lit(0.0)) + adds)

    def _search(self, asked: DataFrame, name: str) -> DataFrame:
        """The best points of queries (__region, __deals, __id, __preset, q_load, ``q_<feature>``, __bar) in their regions."""
        crowds = asked.groupBy("__region").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("__crowds")).withColumnRenamed("__region", "__of")
        crowds = settled(crowds, "crowds")  # a row per region
        keys = ["__region", "__deal", "__crowd"]
        left = asked.join(F.broadcast(crowds), F.col("__region") == F.col("__of")).withColumns({"__deal": F.explode(F.sequence(F.lit(0), F.col("__deals").cast("int") - 1)), "__crowd": F.pmod(F.xxhash64("__id"), F.col("__crowds")).cast("int")})
        left = left.select(*keys, "__id", "__preset", "q_load", *[f"q_{c}" for c in self.features], "__bar")
        right = self.points.join(F.broadcast(crowds), F.col("__region") == F.col("__of")).withColumn("__crowd", F.explode(F.sequence(F.lit(0), F.col("__crowds") - 1))).drop("__of", "__crowds")
        run = region_search(self.features, self.cells.base, [whitening(m) for m in self.metrics.values()], self.gate, self.matching, self.k)
        out = StructType([StructField("__id", LongType()), StructField("s", DoubleType()), *[self.points.schema[c] for c in ("load", "eff_score", *self.features, "__pos")]])
        grouped = lambda df: df.repartition(self.parts, *keys).groupBy(*keys)
        found = settled(grouped(left).cogroup(grouped(right)).applyInArrow(run, out), name)
        release(crowds)
        return found

    def best(self, queries: DataFrame) -> DataFrame:
        """The best pairs of queries, see ``best_pairs``."""
        keys = ["qid", "preset"] if self.several else ["qid"]
        features, k = self.features, self.k
        asked = queries.filter(F.col("q_load").isNotNull() & ~F.isnan("q_load")).select(*keys, "q_load", *[zero_filled(F.col(f"q_{c}")).alias(f"q_{c}") for c in features])
        number = F.lit(0)
        if self.several:
            asked = asked.filter(F.col("preset").isin(list(self.metrics)))
            number = F.coalesce(*[F.when(F.col("preset") == name, i) for i, name in enumerate(self.metrics)])
        alike = [*keys[1:], "q_load", *[f"q_{c}" for c in features]]
        distinct = settled(asked.select(*alike).distinct().withColumn("__id", F.monotonically_increasing_id()), "asked")
        unique = distinct.withColumn("__preset", number).drop("preset")

        # the region where the best is likely: its k-th best is a bar
        own = F.struct("__most", -F.abs(F.col("q_load") - (F.col("__l0") + F.col("__l1")) / 2), F.col("__region"))
        wanted = ["__preset", "q_load", *[f"q_{c}" for c in features]]
        first = self._near(unique).groupBy("__id", *wanted).agg(F.max_by(F.struct("__region", "__deals"), own).alias("r"))
        first = settled(first.select("__id", *wanted, "r.__region", "r.__deals", F.lit(None).cast("double").alias("__bar")), "first")
        found = self._search(first, "leaders")
        scores = blended(found, self.matching).filter("d IS NOT NULL AND NOT isnan(d)").groupBy("__id").agg(F.sort_array(F.flatten(F.collect_list(F.array_repeat("d", F.size("__pos")))), asc=False).alias("d"))  # at most k points of a region's deals
        bars = scores.select(F.col("__id").alias("__of"), F.get("d", k - 1).alias("bar")).select("__of", (F.col("bar") - F.abs("bar") * 1e-9 - 1e-12).alias("bar"))

        # the other regions that may reach it
        barred = first.drop("__bar", "__deals").withColumnRenamed("__region", "__first").join(bars, F.col("__id") == F.col("__of"), "left").withColumnRenamed("bar", "__bar").drop("__of")
        more = self._near(barred).filter((F.col("__region") != F.col("__first")) & (F.col("__bar").isNull() | (F.col("__most") >= F.col("__bar"))))
        more = settled(more.select("__id", *wanted, "__region", "__deals", "__bar"), "spread")
        pairs = found.unionByName(self._search(more, "others"))
        release(first, more)
        pairs = blended(pairs.withColumnRenamed("__pos", "__all").withColumn("pos", F.explode("__all")).drop("__all"), self.matching)
        best = top_k(pairs, k, "__id").drop("rank")

        same = F.lit(True)
        for c in alike:
            same &= F.col(c) == F.col(f"__k_{c}")
        members = asked.join(distinct.select(F.col("__id").alias("__of"), *[F.col(c).alias(f"__k_{c}") for c in alike]), same).drop(*[f"__k_{c}" for c in alike])
        return top_k(members.join(best, F.col("__of") == F.col("__id")).drop("__of", "__id"), k, keys)


def best_pairs(queries: DataFrame, store: DataFrame, features: Sequence[str], metric: np.ndarray | dict[str, np.ndarray], gate: Gate, matching: Matching, k: int | None = None) -> DataFrame:
    """The ``k`` best samples inside the gate of each query, ranked: qid, q_load, ``q_<feature>``,
    pos, load, the features, eff_score, s, e, d and rank. With a dict of metrics the queries have
    a column preset, which names theirs. Rows that share a qid are one query: their pairs are
    ranked together.

    The store is placed in regions by ``PointIndex``. Queries with equal values are asked once. Each meets
    the region first in which the best score is possible; the k-th best there is a bar that the k
    best of all reach too. Then it meets the other regions whose bounds leave a score of at least its
    bar. A region's queries and points are a task's, which visits leaves of points best first (``Leaves``).
    So what is shuffled are the points, twice, and a row per query and region; pairs never are.
    """
    index = PointIndex(store, features, metric, gate, matching, k)
    best = index.best(queries)
    release(index.points)
    return best


def nearest_by_load(queries: DataFrame, store: DataFrame, k: int, query_load: str = "q_load", load: str = "load", near_rows: int = 512) -> DataFrame:
    """The ``k`` samples of each query with the smallest load distance, then pos.

    Samples are counted by load, of equal loads the ``k`` smallest positions; queries with equal
    loads are asked once. Runs of loads with about ``near_rows`` samples together are a block. The
    blocks' loads and counts, as running sums, give each query the blocks that hold its k nearest
    from below and from above, ties included; of those it ranks only the samples between them.
    """
    held = _first_rows(store.filter(F.col(load).isNotNull() & ~F.isnan(load)), [load], k, F.col("pos"))
    asked = queries.filter(F.col(query_load).isNotNull() & ~F.isnan(query_load))
    loads = held.groupBy(F.col(load).alias("__load")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running_sums(loads, "__load", "__n").withColumn("__block", F.expr(f"__before div {near_rows}"))
    blocks = ranked.groupBy("__block").agg(F.min("__before").alias("first"), F.max(F.col("__before") + F.col("__n")).alias("end"))
    placed = held.join(ranked.select(F.col("__load").alias("__l"), "__block", F.col("__before").alias("__from"), (F.col("__before") + F.col("__n")).alias("__to")), F.col(load) == F.col("__l")).drop("__l")

    # where each query's load stands among the samples: an as-of lookup, by a union sorted within ranges of loads
    distinct = settled(asked.select(F.col(query_load).alias("__asked")).distinct(), "loads")
    spots = distinct.select(F.col("__asked").alias("__load"), F.lit(0).cast("long").alias("__n"))
    spots = running_sums(spots.unionByName(loads).groupBy("__load").agg(F.sum("__n").alias("__n")), "__load", "__n").select(F.col("__load").alias("at"), F.col("__before").alias("below"), (F.col("__before") + F.col("__n")).alias("to"))
    wide = distinct.join(spots, F.col("__asked") == F.col("at")).withColumn("low", F.col("below") - k).withColumn("high", F.col("to") + k)
    # block numbers grow with the running sums; a load with more samples than a block skips numbers
    numbers = F.explode(F.sequence(F.expr(f"greatest(low, 0) div {near_rows}"), F.expr(f"high div {near_rows}"))).alias("__want")
    starts = blocks.select(F.explode(F.sequence(F.expr(f"first div {near_rows}"), F.expr(f"(end - 1) div {near_rows}"))).alias("__cell"), F.col("__block").alias("__b"))
    met = wide.select("__asked", "low", "high", numbers).join(starts, F.col("__want") == F.col("__cell")).drop("__want", "__cell").distinct()
    pairs = met.join(placed, (F.col("__b") == F.col("__block")) & (F.col("__from") < F.col("high")) & (F.col("__to") > F.col("low"))).drop("__b", "__block", "__from", "__to", "low", "high")
    near = lambda asks, by: Window.partitionBy(by).orderBy(F.abs(F.col(asks) - F.col(load)), "pos")
    few = pairs.withColumn("__rank", F.row_number().over(near("__asked", "__asked"))).filter(F.col("__rank") <= k).drop("__rank")
    found = asked.join(few, F.col(query_load) == F.col("__asked")).drop("__asked")
    return found.withColumn("rank", F.row_number().over(near(query_load, "qid"))).filter(F.col("rank") <= k)


def plan_center(ranked: DataFrame, columns: Sequence[str], matching: Matching) -> DataFrame:
    """One row per query: counts, scores and ``raw_plan_<column>`` of its ranked samples. Mode 1 is
    the best sample; mode 2 the mean, weighted by scores of 0.001 at least."""
    weight = F.greatest(F.col("d"), F.lit(0.001))
    if matching.plan_center_mode == 1:
        center = {c: F.max(F.when(F.col("rank") == 1, F.col(c))) for c in columns}
    elif matching.plan_center_mode == 2 and matching.topk_avg_method == "weighted":
        center = {c: F.sum(F.col(c) * weight) / F.sum(F.when(F.col(c).isNotNull(), weight)) for c in columns}
    elif matching.plan_center_mode == 2 and matching.topk_avg_method == "mean":
        center = {c: F.avg(c) for c in columns}
    else:
        raise ValueError("unknown plan centre mode or averaging method")
    best = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    in_order = F.array_sort(F.collect_list(F.struct("rank", "pos")))
    return ranked.groupBy("qid").agg(
        F.count(F.lit(1)).alias("topk_count"), best("pos").alias("best_pos"),
        F.concat_ws(",", F.transform(in_order, lambda x: x["pos"].cast("string"))).alias("topk_pos"),
        best("s").alias("s_best"), F.avg("s").alias("s_topk_mean"), best("d").alias("d_best"), F.avg("d").alias("d_topk_mean"),
        best("e").alias("eff_score_best"), F.avg("eff").alias("eff_topk_mean"), F.first("source").alias("source"),
        *[value.alias(f"raw_plan_{c}") for c, value in center.items()],
    )


def plan_points(queries: DataFrame, store: DataFrame, features: Sequence[str], metric: np.ndarray, gate: Gate, matching: Matching, center: Sequence[str], index: PointIndex | None = None) -> DataFrame:
    """A plan for each query row (qid, q_load, ``q_<feature>``, ``q_<center column>``). ``index`` is the
    store placed by the same features, metric, gate and matching, where it is asked more than once.

    The store has pos, load, the features and centre columns, eff and eff_score. Queries without
    a sample inside the gate take the samples nearest by load with similarity 0, if allowed, and
    otherwise have no plan. If the mean similarity of a plan is below the threshold, the plan is
    the query's own values.
    """
    more = list(dict.fromkeys(c for c in ["eff", *center] if c not in ("load", "pos")))
    ranked = index.best(queries) if index else best_pairs(queries, store, features, metric, gate, matching)
    ranked = ranked.drop(*features).join(store.select(F.col("pos").alias("__pos"), *more), F.col("pos") == F.col("__pos")).drop("__pos")
    ranked = ranked.withColumn("source", F.lit(MATCHED))
    if matching.allow_fallback_nearest_load:
        missed = queries.join(ranked.select("qid").distinct(), "qid", "left_anti")
        near = nearest_by_load(missed, store, matching.top_k).withColumn("s", F.lit(0.0)).withColumn("e", F.col("eff_score")).withColumn("d", F.lit(matching.d_weight_e) * F.col("eff_score"))
        near = near.drop("rank").withColumn("source", F.lit(NEAREST_LOAD))
        ranked = ranked.unionByName(top_k(near, matching.top_k), allowMissingColumns=True)
    plans = queries.join(plan_center(ranked, center, matching), "qid", "left")
    low = F.col("s_topk_mean") < matching.low_sim_fallback_threshold if matching.enable_low_sim_fallback else F.lit(False)
    plans = plans.withColumn("low_sim_fallback", F.coalesce(low, F.lit(False)))
    status = F.coalesce("source", F.lit(NO_GATE_HIT))
    plans = plans.withColumn("match_status", F.concat(status, F.when(F.col("low_sim_fallback"), F.lit(";" + LOW_SIMILARITY)).otherwise(F.lit(""))))
    plans = plans.withColumn("center_source", F.when(F.col("low_sim_fallback"), F.lit("actual")).when(F.col("source").isNotNull(), F.lit("samples")))
    own = {c: (F.col(f"q_{c}") if f"q_{c}" in queries.columns else F.col("q_load")) for c in center}
    return plans.withColumns({f"plan_{c}": F.when(F.col("low_sim_fallback"), own[c]).otherwise(F.col(f"raw_plan_{c}")) for c in center}).withColumn("topk_count", F.coalesce("topk_count", F.lit(0).cast("long"))).drop("source")


def match_details(ranked: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per query and rank, with the query's and the sample's values side by side."""
    return ranked.select("qid", "rank", "pos", "s", "d", "e", F.col("q_load").alias("query_load"), F.col("load").alias("match_load"), *[c for f in features for c in (F.col(f"q_{f}").alias(f"query_{f}"), F.col(f).alias(f"match_{f}"))])
