"""Sequence queries: sliding windows, prefilters, banded dynamic time warping, all queries at once."""

from __future__ import annotations

from collections.abc import Sequence as Names

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.config import Sequence
from tessella.operators.blocks import numbered, same, with_running_total, with_windows

SEQUENCE_MATCHED, TOO_FEW_ROWS, NO_WINDOW = "sequence_matched", "failed:too_few_rows", "failed:no_window"


def vector_of(features: Names[str]) -> Column:
    """A row's features as an array; null and NaN are 0."""
    return F.array(*[F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(0.0)) for c in features])


def ahead_of(features: Names[str], length: int, window) -> Column:
    """The feature arrays of a row and the ``length`` - 1 rows after it; null where there are fewer."""
    vectors = F.collect_list(vector_of(features)).over(window.orderBy("rn").rowsBetween(0, length - 1))
    return F.when(F.size(vectors) == length, vectors)


def sliding(df: DataFrame, features: Names[str], length: int, name: str, keys: Names[str] = ()) -> DataFrame:
    """Adds the windows of ``ahead_of`` to numbered rows."""
    return with_windows(df, keys, 0, length - 1, lambda w: {name: ahead_of(features, length, w)})


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def diagonal_similarity(query: Column, window: Column) -> Column:
    """Mean over time of 1 / (1 + d^2) of sequences of equal length in a whitened space."""
    each = F.zip_with(query, window, lambda a, b: 1 / (1 + F.pow(euclidean(a, b), F.lit(2.0))))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(each)


def warped(rows: int, columns: int, band: int) -> Column:
    """Path of least cost through the matrix of distances in the column __dist, as a struct: cost, similarity (mean of
    1 / (1 + d^2) over the path), length. Ties prefer the diagonal, then the step in the query.

    A cell carries its path's cost, sum and length, so the path needs no second pass.
    """
    width = max(band, abs(rows - columns)) if band > 0 else max(rows, columns)
    cell = "struct<c: double, s: double, n: int>"
    none = "named_struct('c', cast('Infinity' as double), 's', 0D, 'n', 0)"
    own = "get(get(dist, i), j)"
    choose = f"""case when i = 0 and j = 0 then named_struct('c', 0D, 's', 0D, 'n', 0)
      when coalesce(get(above, j - 1).c, double('Infinity')) <= coalesce(get(above, j).c, double('Infinity')) and coalesce(get(above, j - 1).c, double('Infinity')) <= coalesce(get(line, j - 1).c, double('Infinity')) then coalesce(get(above, j - 1), {none})
      when coalesce(get(above, j).c, double('Infinity')) <= coalesce(get(line, j - 1).c, double('Infinity')) then coalesce(get(above, j), {none})
      else coalesce(get(line, j - 1), {none}) end"""
    extend = f"transform(array({choose}), p -> named_struct('c', p.c + {own}, 's', p.s + 1 / (1 + {own} * {own}), 'n', p.n + 1))"
    line = f"aggregate(sequence(0, {columns - 1}), cast(array() as array<{cell}>), (line, j) -> concat(line, cast(case when abs(i - j) > {width} then array({none}) else {extend} end as array<{cell}>)))"
    fold = f"aggregate(sequence(0, {rows - 1}), cast(array() as array<{cell}>), (above, i) -> {line}, a -> element_at(a, {columns}))"
    end = F.expr(fold.replace("dist", "__dist"))
    return F.struct(end["c"].alias("cost"), (end["s"] / end["n"]).alias("similarity"), end["n"].alias("length"))


def with_alignment(pairs: DataFrame, query: str, candidate: str, rows: int, columns: int, band: int) -> DataFrame:
    """Adds cost, similarity and length of the alignment of two columns of sequences."""
    matrix = F.transform(F.col(query), lambda a: F.transform(F.col(candidate), lambda b: euclidean(a, b)))
    return pairs.withColumn("__dist", matrix).withColumn("__path", warped(rows, columns, band)).withColumns({"path_cost": F.col("__path.cost"), "similarity": F.col("__path.similarity"), "path_length": F.col("__path.length")}).drop("__dist", "__path")


def load_runs(df: DataFrame, low: Column, load: str = "load", keys: Names[str] = (), min_length: int = 1) -> DataFrame:
    """Maximal runs of consecutive numbered rows with ``low``: keys, first_rn, last_rn, length, mean_load.
    A run's rows know it by the number of runs that have begun so far."""
    inside = F.coalesce(low, F.lit(False))
    marked = with_windows(df.withColumn("__low", inside), keys, 1, 0, lambda w: {"__before": F.lag("__low").over(w.orderBy("rn"))})
    begins = (F.col("__low") & ~F.coalesce("__before", F.lit(False))).cast("long")
    runs = with_running_total(marked, keys, begins, "__run").filter("__low")
    runs = runs.groupBy(*keys, "__run").agg(F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"), F.count(F.lit(1)).alias("length"), F.avg(load).alias("mean_load"))
    return runs.filter(F.col("length") >= min_length).drop("__run")


def candidates(grid: DataFrame, features: Names[str], config: Sequence, queries: Column, time: str = "ts", load: str = "load", keys: Names[str] = ()) -> DataFrame:
    """Rows (keys, qid, q_ts, query, start, candidate) that the prefilters leave, for each row of a
    numbered grid that ``queries`` marks as the end of a query sequence; series by ``keys``.

    The reference of a query is the rows of the ``ref_days`` before its end, without the query's
    own ``query_len`` rows. Windows must keep to the query's mean load, and start every
    ``prefilter_step`` rows from where their run of such loads begins. Of those the diagonal similarity must reach
    its threshold; if none does, the runs' first windows are taken. If there is no run, or
    every reference row is one, a window starts every ``slide_step`` rows of the reference.
    """
    keys = list(keys)
    q, m = config.query_len, config.candidate_len

    def windows(w):
        back, ahead = w.orderBy("rn").rowsBetween(-(q - 1), 0), w.orderBy("rn").rowsBetween(0, q - 1)
        return {
            "short": ahead_of(features, q, w), "long": ahead_of(features, m, w), "mean_load": F.avg(load).over(back), "first_rn": F.min("rn").over(back), "query": F.collect_list(vector_of(features)).over(back),
            "low": F.min(load).over(ahead), "high": F.max(load).over(ahead), "loads": F.count(load).over(ahead),
        }

    grid = with_windows(grid, keys, q - 1, max(q, m) - 1, windows)
    ends = grid.filter(queries & (F.size("query") == q)).select(*[F.col(k).alias(f"__q_{k}") for k in keys], F.col("rn").alias("qid"), F.col(time).alias("q_ts"), "query", F.col("mean_load").alias("q_load"), F.col("first_rn").alias("q_first"))
    spread = ends.withColumn("day", F.explode(F.sequence(F.to_date("q_ts") - F.lit(int(config.ref_days) + 1), F.to_date("q_ts"))))
    rows = grid.select(*keys, "rn", time, load, "short", "long", "low", "high", "loads", F.to_date(time).alias("r_day"))
    micros = int(config.ref_days * 86_400e6)
    inside = (F.col("day") == F.col("r_day")) & same(keys, "__q_") & (F.col("rn") < F.col("q_first")) & (F.unix_micros(F.col(time).cast("timestamp")) >= F.unix_micros(F.col("q_ts").cast("timestamp")) - micros)
    pairs = spread.join(rows, inside).drop(*[f"__q_{k}" for k in keys])
    per = Window.partitionBy(*keys, "qid")  # a query's reference: the rows of ``ref_days``
    near = lambda x: F.coalesce(F.abs(x - F.col("q_load")) <= config.load_threshold, F.lit(False))
    sofar = per.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumns({"ref_first": F.min("rn").over(per), "ref_rows": F.count(F.lit(1)).over(per), "all_near": F.min(near(F.col(load)).cast("int")).over(per), "last_far": F.max(F.when(~near(F.col(load)), F.col("rn"))).over(sofar)})
    fits = F.col("rn") + q <= F.col("q_first")
    pairs = pairs.withColumn("into_run", F.col("rn") - F.coalesce(F.col("last_far") + 1, F.col("ref_first")))
    pairs = pairs.withColumn("in_run", fits & (F.col("loads") == q) & near(F.col("low")) & near(F.col("high")) & (F.col("into_run") % config.prefilter_step == 0))
    pairs = pairs.withColumn("passes", F.col("in_run") & (diagonal_similarity(F.col("query"), F.col("short")) >= config.sim_threshold))
    pairs = pairs.withColumns({"any_run": F.max(F.col("in_run").cast("int")).over(per), "any_pass": F.max(F.col("passes").cast("int")).over(per)})
    stepped = (F.col("rn") - F.col("ref_first")) % config.slide_step == 0
    take = stepped if not config.prefilter else (
        F.when((F.col("any_run") == 0) | (F.col("all_near") == 1), stepped).when(F.col("any_pass") == 1, F.col("passes")).otherwise(F.col("in_run") & (F.col("into_run") == 0))
    )
    enough = F.col("ref_rows") >= m
    return pairs.filter(enough & take & (F.col("rn") + m <= F.col("q_first"))).select(*keys, "qid", "q_ts", "query", F.col("rn").alias("start"), F.col("long").alias("candidate"))


def query_sequences(grid: DataFrame, features: Names[str], center: Names[str], config: Sequence, queries: Column, time: str = "ts", load: str = "load", keys: Names[str] = ()) -> DataFrame:
    """Top-k windows of each query: keys, qid, rank, start, similarity, path_cost, path_length,
    n_candidates, end_ts and the centre columns of the window's last row."""
    keys = list(keys)
    aligned = with_alignment(candidates(grid, features, config, queries, time, load, keys), "query", "candidate", config.query_len, config.candidate_len, config.band)
    if config.candidate_len < config.min_coverage:
        aligned = aligned.withColumn("similarity", F.lit(0.0))
    per = Window.partitionBy(*keys, "qid")
    aligned = aligned.drop("query", "candidate").withColumn("n_candidates", F.count(F.lit(1)).over(per))
    ranked = aligned.withColumn("rank", F.row_number().over(per.orderBy(F.desc("similarity"), "start"))).filter(F.col("rank") <= config.top_k)
    last = grid.select(*[F.col(k).alias(f"__l_{k}") for k in keys], (F.col("rn") - (config.candidate_len - 1)).alias("__start"), F.col(time).alias("end_ts"), *center)
    return ranked.join(last, (F.col("start") == F.col("__start")) & same(keys, "__l_")).drop("__start", *[f"__l_{k}" for k in keys])


def planned_sequences(grid: DataFrame, features: Names[str], center: Names[str], config: Sequence, queries: Column, time: str = "ts", load: str = "load", keys: Names[str] = ()) -> DataFrame:
    """A row for each query of each series, those without a plan too: keys, qid, q_ts, the columns of
    ``sequence_centers`` and match_status, which tells why a query failed: fewer rows up to it in
    ``ref_days`` than a query and a window have together, or no window that fits."""
    keys = list(keys)
    done = sequence_centers(query_sequences(grid, features, center, config, queries, time, load, keys), center, keys).withColumnsRenamed({"qid": "__qid", **{k: f"__d_{k}" for k in keys}})
    asked = grid.filter(queries).select(*keys, F.col("rn").alias("qid"), F.col(time).alias("q_ts"))
    spread = asked.withColumn("__day", F.explode(F.sequence(F.to_date("q_ts") - F.lit(int(config.ref_days) + 1), F.to_date("q_ts")))).withColumnsRenamed({k: f"__q_{k}" for k in keys})
    micros = lambda t: F.unix_micros(F.col(t).cast("timestamp"))
    rows = grid.select(*keys, "rn", time, F.to_date(time).alias("__of"))
    inside = (F.col("__day") == F.col("__of")) & same(keys, "__q_") & (F.col("rn") <= F.col("qid")) & (micros(time) >= micros("q_ts") - int(config.ref_days * 86_400e6))
    counted = spread.join(rows, inside).groupBy(*[F.col(f"__q_{k}").alias(f"__c_{k}") for k in keys], F.col("qid").alias("__c")).agg(F.count(F.lit(1)).alias("__rows"))
    out = asked.join(counted, (F.col("qid") == F.col("__c")) & same(keys, "__c_"), "left").drop("__c", *[f"__c_{k}" for k in keys])
    out = out.join(done, (F.col("qid") == F.col("__qid")) & same(keys, "__d_"), "left").drop("__qid", *[f"__d_{k}" for k in keys])
    few = F.coalesce("__rows", F.lit(0)) < config.query_len + config.candidate_len
    status = F.when(F.col("topk_count").isNotNull(), SEQUENCE_MATCHED).when(few, TOO_FEW_ROWS).otherwise(NO_WINDOW)
    return out.withColumn("match_status", status).withColumn("topk_count", F.coalesce("topk_count", F.lit(0).cast("long"))).drop("__rows")


def sequence_centers(ranked: DataFrame, center: Names[str], keys: Names[str] = ()) -> DataFrame:
    """One row per query of a series: scores and centres weighted by similarities of 0.001 at least."""
    w = F.greatest(F.col("similarity"), F.lit(0.001))
    best = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    return ranked.groupBy(*keys, "qid").agg(
        F.count(F.lit(1)).alias("topk_count"), best("similarity").alias("s_best"), F.avg("similarity").alias("s_topk_mean"), best("path_cost").alias("path_cost"), best("path_length").alias("path_length"), F.max("n_candidates").alias("n_candidates"),
        (F.abs(F.unix_micros(best("end_ts").cast("timestamp")) - F.unix_micros(F.max("q_ts").cast("timestamp"))) / 86_400e6).alias("time_offset_days"),
        *[(F.sum(F.col(c) * w) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(f"plan_{c}") for c in center],
    )
