"""The library's queries over the shared tables, and the same in SQL.

Searches take as queries every row whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.config import Config, Continuity, Features, Gate, Matching, Sequence
from tessella.functions import columns as C
from tessella.functions import stats as S
from tessella.functions.similarity import cauchy, squared_distance
from tessella.operators import boosting
from tessella.operators import continuity as K
from tessella.operators import matching as M
from tessella.operators import models
from tessella.operators import residuals as R
from tessella.operators import sampling as P
from tessella.operators import sequences as D
from tessella.operators.ranges import range_totals
from tessella.operators.vectors import BLOCK, nearest_vectors
from tessella.plans import report
from tessella.plans.engine import PlanningEngine
from tessella.sources.tables import hourly_grid, order_store, release, scratch_path, settled, table

FEATURES = ["f1", "f2", "f3", "f4", "f5"]
METRIC = np.diag([2e-4, 5e-9, 800.0, 1000.0, 0.1])
METRIC[0, 4] = METRIC[4, 0] = -2e-3
GATE = Gate(abs_threshold=15_000.0)
PRESETS = {"balanced": [1.0] * 5, "size": [4.0, 4.0, 0.25, 0.25, 4.0], "rates": [0.25, 0.25, 4.0, 4.0, 0.25]}
KINDS = ["click", "error", "purchase", "signup", "view"]
SCALES = {"click": 0.02, "error": 0.02, "purchase": 0.03, "signup": 0.01, "view": 0.02}
SEQUENCE = Sequence(ref_days=3.0, load_threshold=15.0, sim_threshold=0.35)
LIMIT = 3.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


V = """v AS (SELECT o_orderkey AS pos, o_totalprice AS load, o_orderdate AS date, f1, f2, f3, f4, f5, eff FROM orders JOIN (
  SELECT l_orderkey, sum(l_quantity) AS f1, avg(l_extendedprice) AS f2, avg(l_discount) AS f3, avg(l_tax) AS f4, CAST(count(*) AS DOUBLE) AS f5,
         sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice) AS eff FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""
E = """e AS (SELECT *, (rank() OVER (ORDER BY eff) + (count(*) OVER (PARTITION BY eff) - 1) / 2.0::DOUBLE) / count(*) OVER () AS eff_score FROM v)"""


def d2_sql(metric: np.ndarray, a: str = "q", b: str = "x") -> str:
    terms = [f"{float(metric[i, j]) * (1 if i == j else 2)!r}::DOUBLE * ({a}.{FEATURES[i]} - {b}.{FEATURES[i]}) * ({a}.{FEATURES[j]} - {b}.{FEATURES[j]})" for i in range(5) for j in range(i, 5) if metric[i, j]]
    return "greatest(" + " + ".join(terms) + ", 0)"


def hits_sql(a: float = 1.0, b: float = 0.0, metric: np.ndarray = METRIC, gate: str = "abs(q.load - x.load) <= 15000", name: str = "") -> str:
    """Scored and ranked pairs."""
    score = f"{a!r}::DOUBLE * s + {b!r}::DOUBLE * eff_score"
    return f"""p{name} AS (SELECT q.pos AS qid, q.load AS q_load, q.f1 AS q_f1, q.f2 AS q_f2, x.*, 1 / (1 + {d2_sql(metric)}) AS s FROM e q JOIN e x ON q.pos % 20 = 0 AND {gate}),
r{name} AS (SELECT *, {score} AS d, row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, pos) AS rank FROM p{name} QUALIFY rank <= 5)"""


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return settled(order_store(spark, folder), "samples")


def points(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(queries, store) of the orders' samples; the store is built once."""
    found = samples(spark, folder)
    store = settled(S.with_percentile_rank(found, "eff", "eff_score"), "store")
    release(found)
    queries = store.filter("pos % 20 = 0").select(F.col("pos").alias("qid"), F.col("load").alias("q_load"), *[F.col(c).alias(f"q_{c}") for c in FEATURES])
    return queries, store


def ranked(spark: SparkSession, folder: str, matching: Matching = Matching(), metric: np.ndarray = METRIC, more: tuple[str, ...] = ()) -> DataFrame:
    queries, store = points(spark, folder)
    best = M.best_pairs(queries, store, FEATURES, metric, GATE, matching)
    return best.join(store.select("pos", *more), "pos") if more else best


# --- scans, projections, filters -----------------------------------------------------------------


@query("SELECT o_orderkey AS order_id, o_totalprice AS load, o_orderdate AS date, 0.0::DOUBLE AS heat_value FROM orders")
def scan_project_alias(spark, folder):
    """Renames by alias, drops an alias whose standard name is there, fills a missing feature."""
    df = table(spark, folder, "orders").withColumn("price_alias", F.lit(-1.0))
    df = C.renamed(df, {"o_orderkey": "order_id", "o_totalprice": "load", "price_alias": "load", "o_orderdate": "date"})
    return df.select("order_id", "load", "date", *C.features(df, ["heat_value"], lenient=True))


@query("SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'")
def time_range_filter(spark, folder):
    df = C.in_range(table(spark, folder, "events"), "ts", "2024-01-05", "2024-01-12")
    return df.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) - INTERVAL 1 MONTH FROM orders) AND o_orderdate < TIMESTAMP '1998-01-01'")
def cutoff_last_month(spark, folder):
    orders = table(spark, folder, "orders")
    return C.before_cutoff(C.without_last_month(orders, "o_orderdate", orders, "o_orderdate"), "o_orderdate", "1998-01-01").select("o_orderkey", "o_orderdate")


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM events)")
def last_days_filter(spark, folder):
    return C.last_days(table(spark, folder, "events"), "ts", 10).select("event_id", "ts")


@query("SELECT l_orderkey, l_linenumber, try_cast(l_returnflag AS DOUBLE) AS flag_number, try_cast(CAST(l_quantity AS VARCHAR) AS DOUBLE) AS quantity FROM lineitem")
def numeric_coercion(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag_number"), F.col("l_quantity").cast("string").alias("quantity"))
    return C.numeric(df, ["flag_number", "quantity"])


# --- gate, ranks, bins, statistics ---------------------------------------------------------------


HITS = {"n_hits": (1, F.sum), "first_pos": ("pos", F.min), "last_pos": ("pos", F.max)}


@query(f"WITH {V} SELECT q.pos AS qid, count(*) AS n_hits, min(x.pos) AS first_pos, max(x.pos) AS last_pos FROM v q JOIN v x ON q.pos % 20 = 0 AND abs(q.load - x.load) <= 15000 GROUP BY q.pos")
def load_gate_join(spark, folder):
    queries, store = points(spark, folder)
    return M.gate_totals(queries, store.select("pos", "load"), GATE, HITS)


@query(f"WITH {V} SELECT q.pos AS qid, count(*) AS n_hits, min(x.pos) AS first_pos, max(x.pos) AS last_pos FROM v q JOIN v x ON q.pos % 20 = 0 AND abs(q.load - x.load) / greatest(abs(x.load), 1e-9) <= 0.05 GROUP BY q.pos")
def load_gate_relative(spark, folder):
    queries, store = points(spark, folder)
    gate = Gate(mode="relative", rel_threshold=0.05)
    return M.gate_totals(queries, store.select("pos", "load"), gate, HITS)


@query(f"WITH {V}, {E} SELECT pos, round(eff_score, 9) AS eff_score FROM e")
def pct_rank_eff(spark, folder):
    return rounded(S.with_percentile_rank(samples(spark, folder), "eff", "eff_score").select("pos", "eff_score"), 9)


def bin_sql(c: str, edges: str) -> str:
    return f"CAST(CASE WHEN {c} IS NOT NULL THEN greatest(len(list_filter({edges}, lambda b: b < {c})) - 1, 0) END AS INTEGER)"


def edges_sql(c: str, n: int) -> str:
    return f"list_sort(list_distinct(quantile_cont({c}, [{', '.join(repr(i / n) for i in range(n + 1))}])))"


@query(f"WITH g AS (SELECT {edges_sql('l_extendedprice', 15)} AS g FROM lineitem) SELECT l_orderkey, l_linenumber, {bin_sql('l_extendedprice', 'g')} AS price_bin FROM lineitem, g")
def qcut_bins(spark, folder):
    df = S.with_quantile_bins(table(spark, folder, "lineitem"), {"l_extendedprice": 15})
    return df.select("l_orderkey", "l_linenumber", F.col("l_extendedprice_bin").alias("price_bin"))


BINNED = f"g AS (SELECT {edges_sql('l_extendedprice', 15)} AS g FROM lineitem), b AS (SELECT *, {bin_sql('l_extendedprice', 'g')} AS load_bin FROM lineitem, g), t AS (SELECT load_bin, count(*) AS n, quantile_cont(l_quantity, 0.02) AS q_low, quantile_cont(l_quantity, 0.98) AS q_high, quantile_cont(l_discount, 0.02) AS d_low, quantile_cont(l_discount, 0.98) AS d_high, quantile_cont(l_tax, 0.02) AS t_low, quantile_cont(l_tax, 0.98) AS t_high FROM b GROUP BY load_bin)"


@query(f"WITH {BINNED} SELECT load_bin, n, round(q_low, 6) AS q_low, round(q_high, 6) AS q_high, round(d_low, 6) AS d_low, round(d_high, 6) AS d_high, round(t_low, 6) AS t_low, round(t_high, 6) AS t_high FROM t")
def bin_quantile_table(spark, folder):
    binned = S.with_quantile_bins(table(spark, folder, "lineitem"), {"l_extendedprice": 15}).withColumnRenamed("l_extendedprice_bin", "load_bin")
    names = {f"{c}_{s}": f"{n}_{s}" for c, n in (("l_quantity", "q"), ("l_discount", "d"), ("l_tax", "t")) for s in ("low", "high")}
    return rounded(P.bin_quantiles(binned, ["l_quantity", "l_discount", "l_tax"]).withColumnsRenamed(names))


@query(f"WITH {BINNED}, k AS (SELECT b.*, CAST((l_quantity < q_low OR l_quantity > q_high) AS INTEGER) + CAST((l_discount < d_low OR l_discount > d_high) AS INTEGER) + CAST((l_tax < t_low OR l_tax > t_high) AS INTEGER) AS bad_count FROM b JOIN t USING (load_bin)) SELECT l_orderkey, l_linenumber, load_bin, CAST(bad_count AS INTEGER) AS bad_count FROM k WHERE bad_count <= 0")
def outlier_filter(spark, folder):
    return P.outliers_removed(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], most_bad=0).select("l_orderkey", "l_linenumber", "load_bin", "bad_count")


STATS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem" for c in STATS))
def robust_stats(spark, folder):
    return rounded(S.robust_stats(table(spark, folder, "lineitem"), STATS))


@query("WITH q AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS a, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - a[2]) / (a[3] - a[1]), 6) AS l_quantity, round((l_extendedprice - b[2]) / (b[3] - b[1]), 6) AS l_extendedprice FROM lineitem, q")
def robust_normalize(spark, folder):
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return rounded(S.robust_normalized(df, ["l_quantity", "l_extendedprice"]))


@query(f"WITH {V}, c AS (SELECT {', '.join(f'covar_samp({FEATURES[i]}, {FEATURES[j]}) AS c{i}{j}' for i in range(5) for j in range(i, 5))} FROM v) " + " UNION ALL ".join(f"SELECT '{FEATURES[i]}' AS a, '{FEATURES[j]}' AS b, round(c{i}{j}{' + 1e-6 * (c00 + c11 + c22 + c33 + c44) / 5' if i == j else ''}, 4) + 0.0 AS cov FROM c" for i in range(5) for j in range(i, 5)))
def covariance_ridge(spark, folder):
    cov = S.covariance(order_store(spark, folder), FEATURES)
    rows = [(FEATURES[i], FEATURES[j], float(cov[i, j])) for i in range(5) for j in range(i, 5)]
    return rounded(spark.createDataFrame(rows, "a string, b string, cov double"), 4)


# --- point plans ---------------------------------------------------------------------------------


@query(f"WITH {V}, {E}, {hits_sql()} SELECT qid, CAST(rank AS INTEGER) AS rank, pos, round(s, 6) AS s FROM r")
def mahalanobis_topk(spark, folder):
    return rounded(ranked(spark, folder).select("qid", "rank", "pos", "s"))


@query(f"""WITH {V}, c AS (SELECT covar_samp(f1, f1) AS a0, covar_samp(f1, f2) AS b, covar_samp(f2, f2) AS d0 FROM v), k AS (SELECT a0 + 1e-6 * (a0 + d0) / 2 AS a, b, d0 + 1e-6 * (a0 + d0) / 2 AS d FROM c),
m AS (SELECT 0.6 * d / (a * d - b * b) AS m11, -sqrt(0.6 * 0.4) * b / (a * d - b * b) AS m12, 0.4 * a / (a * d - b * b) AS m22 FROM k),
p AS (SELECT q.pos AS qid, x.pos, 1 / (1 + greatest(m11 * (q.f1 - x.f1) * (q.f1 - x.f1) + 2 * m12 * (q.f1 - x.f1) * (q.f2 - x.f2) + m22 * (q.f2 - x.f2) * (q.f2 - x.f2), 0)) AS s FROM v q JOIN v x ON q.pos % 20 = 0 AND abs(q.load - x.load) <= 15000, m)
SELECT qid, pos, round(s, 6) AS s, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS INTEGER) AS rank FROM p QUALIFY rank <= 3""")
def mahalanobis_2d_full(spark, folder):
    queries, store = points(spark, folder)
    metric = S.weighted_inverse(S.covariance(store, FEATURES[:2]), [0.6, 0.4])
    return rounded(M.best_pairs(queries, store, FEATURES[:2], metric, GATE, Matching(), 3).select("qid", "pos", "s", "rank"))


def center_sql(f1: str, f2: str) -> str:
    return f"WITH {V}, {E}, {hits_sql(0.8, 0.2)} SELECT qid, count(*) AS topk_count, round(avg(s), 6) AS s_topk_mean, round(avg(d), 6) AS d_topk_mean, round(avg(eff), 6) AS eff_topk_mean, round({f1}, 4) AS raw_plan_f1, round({f2}, 4) AS raw_plan_f2 FROM r GROUP BY qid"


def centers(spark, folder, **how) -> DataFrame:
    matching = Matching(d_weight_s=0.8, d_weight_e=0.2, **how)
    rows = M.plan_center(ranked(spark, folder, matching, more=("eff",)).withColumn("source", F.lit(M.MATCHED)), ["f1", "f2"], matching)
    digits = {"s_topk_mean": 6, "d_topk_mean": 6, "eff_topk_mean": 6, "raw_plan_f1": 4, "raw_plan_f2": 4}
    return rows.select("qid", "topk_count", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query(center_sql("max(CASE WHEN rank = 1 THEN f1 END)", "max(CASE WHEN rank = 1 THEN f2 END)"))
def plan_center_best(spark, folder):
    return centers(spark, folder, plan_center_mode=1)


@query(center_sql("avg(f1)", "avg(f2)"))
def plan_center_mean(spark, folder):
    return centers(spark, folder, plan_center_mode=2, topk_avg_method="mean")


@query(center_sql("sum(f1 * greatest(d, 0.001)) / sum(greatest(d, 0.001))", "sum(f2 * greatest(d, 0.001)) / sum(greatest(d, 0.001))"))
def plan_center_weighted(spark, folder):
    return centers(spark, folder, plan_center_mode=2, topk_avg_method="weighted")


@query(f"""WITH {V}, {E}, {hits_sql()}, a AS (SELECT qid, max(q_f1) AS q_f1, avg(s) AS m, sum(f1 * greatest(d, 0.001)) / sum(greatest(d, 0.001)) AS c FROM r GROUP BY qid)
SELECT qid, round(m, 6) AS s_topk_mean, m < 0.75 AS low_sim_fallback, CASE WHEN m < 0.75 THEN 'matched;low_similarity_fallback' ELSE 'matched' END AS match_status, round(CASE WHEN m < 0.75 THEN q_f1 ELSE c END, 4) AS plan_f1 FROM a""")
def low_sim_fallback(spark, folder):
    queries, store = points(spark, folder)
    plans = M.plan_points(queries, store, FEATURES, METRIC, GATE, Matching(), ["f1"])
    return plans.select("qid", F.round("s_topk_mean", 6).alias("s_topk_mean"), "low_sim_fallback", "match_status", F.round("plan_f1", 4).alias("plan_f1"))


NEAREST = f"""WITH {V}, {E}, q AS (SELECT pos AS qid, load + 1000000 AS q_load, f1 AS q_f1 FROM v WHERE pos % 20 = 0),
n AS (SELECT qid, q_load, x.*, row_number() OVER (PARTITION BY qid ORDER BY abs(q_load - x.load), x.pos) AS rank FROM q, (SELECT * FROM e ORDER BY load DESC, pos LIMIT 1000) x QUALIFY rank <= 5)"""


@query(NEAREST + " SELECT qid, count(*) AS topk_count, 'nearest_load' AS match_status, round(avg(eff_score), 6) AS d_topk_mean, round(avg(f1), 4) AS plan_f1 FROM n GROUP BY qid")
def nearest_load_fallback(spark, folder):
    """Loads far above all samples: the gate finds nothing, the samples nearest by load answer."""
    queries, store = points(spark, folder)
    queries = queries.withColumn("q_load", F.col("q_load") + 1_000_000)
    how = Matching(d_weight_e=1.0, topk_avg_method="mean", allow_fallback_nearest_load=True, enable_low_sim_fallback=False)
    plans = M.plan_points(queries, store, FEATURES, METRIC, GATE, how, ["f1"])
    return plans.select("qid", "topk_count", "match_status", F.round("d_topk_mean", 6).alias("d_topk_mean"), F.round("plan_f1", 4).alias("plan_f1"))


@query(f"WITH {V}, {E}, {hits_sql(0.5, 0.5)} SELECT qid, CAST(rank AS INTEGER) AS rank, pos, round(s, 6) AS s, round(eff_score, 6) AS e, round(d, 6) AS d FROM r")
def score_blend(spark, folder):
    return rounded(ranked(spark, folder, Matching(d_weight_s=0.5, d_weight_e=0.5)).select("qid", "rank", "pos", "s", "e", "d"))


@query(f"""WITH {V}, {E}, {hits_sql()} SELECT qid, CAST(rank AS INTEGER) AS rank, pos, round(s, 6) AS s, q_load AS query_load, load AS match_load, round(q_f1, 6) AS query_f1, round(f1, 6) AS match_f1, round(q_f2, 6) AS query_f2, round(f2, 6) AS match_f2 FROM r""")
def detail_rows(spark, folder):
    return rounded(M.match_details(ranked(spark, folder), ["f1", "f2"]).drop("d", "e"))


@query(f"WITH {V}, {E}, {hits_sql()} SELECT qid, max(CASE WHEN rank = 1 THEN pos END) AS best_pos, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY rank) AS topk_pos, count(*) AS topk_count FROM r GROUP BY qid")
def flatten_result(spark, folder):
    queries, store = points(spark, folder)
    return M.plan_points(queries, store, FEATURES, METRIC, GATE, Matching(), ["f1"]).select("qid", "best_pos", "topk_pos", "topk_count")


def weighted(w: list[float]) -> np.ndarray:
    root = np.sqrt(np.array(w))
    return root[:, None] * METRIC * root[None, :]


@query(f"WITH {V}, {E}, " + ", ".join(hits_sql(metric=weighted(w), name=f"_{n}") for n, w in PRESETS.items()) + " " + " UNION ALL ".join(f"SELECT '{n}' AS preset, qid, round(avg(s), 6) AS s_topk_mean, min(pos) AS least_pos FROM r_{n} GROUP BY qid" for n in PRESETS))
def preset_sweep(spark, folder):
    """Three weightings of the same metric in one plan: each query is asked once per preset."""
    queries, store = points(spark, folder)
    asked = queries.withColumn("preset", F.explode(F.array(*[F.lit(n) for n in PRESETS])))
    best = M.best_pairs(asked, store, FEATURES, {n: weighted(w) for n, w in PRESETS.items()}, GATE, Matching(), 5)
    return best.groupBy("preset", "qid").agg(F.round(F.avg("s"), 6).alias("s_topk_mean"), F.min("pos").alias("least_pos"))


@query(f"""WITH {V}, {E}, {hits_sql()}, a AS (SELECT qid, CASE WHEN avg(s) < 0.75 THEN 'matched;low_similarity_fallback' ELSE 'matched' END AS match_status FROM r GROUP BY qid)
SELECT match_status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM a GROUP BY match_status""")
def status_histogram(spark, folder):
    queries, store = points(spark, folder)
    return rounded(report.status_histogram(M.plan_points(queries, store, FEATURES, METRIC, GATE, Matching(), ["f1"]), "match_status"))


@query("""WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS qid, b.vec_id AS pos, round((list_cosine_similarity(a.v, b.v) + 1) / 2, 6) AS sim, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) AS INTEGER) AS rank
FROM n a JOIN n b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 5""")
def cosine_topk(spark, folder):
    """A stated set of queries against all vectors, block by block: each pair of blocks ranks its own."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    # a few blocks for each core at least, where there are few vectors
    block = max(1000, min(BLOCK, -(-vectors.count() // spark.sparkContext.defaultParallelism)))
    return rounded(nearest_vectors(vectors.filter("id % 20 = 0"), vectors, 5, block))


# --- residual models, reports, splits ------------------------------------------------------------

@query(f"WITH {V}, m AS (SELECT regr_intercept(f2, f1) AS a, regr_slope(f2, f1) AS b FROM v) SELECT pos, round(a + b * f1, 4) AS pred_f2, round(f2 - a - b * f1, 4) AS resid_f2 FROM v, m")
def residual_ols(spark, folder):
    return rounded(R.with_residuals(samples(spark, folder), ["f1"], ["f2"]).select("pos", "pred_f2", "resid_f2"), 4)


STRATA = f"""{V}, g AS (SELECT {edges_sql('load', 4)} AS g1, {edges_sql('f5', 3)} AS g2 FROM v), s AS (SELECT v.*, CAST({bin_sql('load', 'g1')} AS VARCHAR) || '|' || CAST({bin_sql('f5', 'g2')} AS VARCHAR) AS strata FROM v, g),
o AS (SELECT *, count(*) OVER (PARTITION BY strata) AS n, row_number() OVER (PARTITION BY strata ORDER BY md5(CAST(pos AS VARCHAR) || '|42'), pos) AS place FROM s),
f AS (SELECT *, CAST(CASE WHEN n <= 1 THEN -1 ELSE (place - 1) % 5 END AS INTEGER) AS fold FROM o)"""
SPLIT = """z AS (SELECT *, CAST(greatest(1, round_even(n * 0.70::DOUBLE, 0)) AS INTEGER) AS t0, CAST(greatest(1, round_even(n * 0.15::DOUBLE, 0)) AS INTEGER) AS v0 FROM f),
y AS (SELECT *, CASE WHEN n <= 3 THEN 1 WHEN n - t0 - v0 <= 0 THEN greatest(1, n - v0 - 1) ELSE t0 END AS t, CASE WHEN n <= 2 THEN 0 WHEN n = 3 THEN 1 ELSE v0 END AS u FROM z),
x AS (SELECT *, CASE WHEN place <= t THEN 'train' WHEN place <= t + u THEN 'valid' ELSE 'test' END AS split FROM y)"""


def stratified(spark, folder) -> DataFrame:
    return P.with_strata(samples(spark, folder), {"load": 4, "f5": 3})


@query(f"WITH {STRATA} SELECT pos, strata FROM s")
def strata_label(spark, folder):
    return stratified(spark, folder).select("pos", "strata")


@query(f"WITH {STRATA}, {SPLIT} SELECT pos, split FROM x")
def strata_split(spark, folder):
    return P.with_split(stratified(spark, folder), "pos").select("pos", "split")


@query(f"WITH {STRATA}, {SPLIT} SELECT strata, count(*) AS n, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid, count(*) FILTER (split = 'test') AS test FROM x GROUP BY strata")
def split_report(spark, folder):
    return P.split_report(P.with_split(stratified(spark, folder), "pos"))


@query(f"WITH {STRATA} SELECT pos, fold FROM f")
def oof_folds(spark, folder):
    return P.with_folds(stratified(spark, folder), "pos").select("pos", "fold")


OOF = f"""WITH {STRATA}, k AS (SELECT unnest([0, 1, 2, 3, 4]) AS k), m AS (SELECT k, regr_intercept(f2, f1) AS a, regr_slope(f2, f1) AS b FROM f JOIN k ON f.fold <> k GROUP BY k),
w AS (SELECT pos, split_part(strata, '|', 1) AS part, f1, f2, a + b * f1 AS pred FROM f JOIN m ON f.fold = m.k)"""


@query(OOF + " SELECT pos, round(pred, 4) AS pred_f2, round(f2 - pred, 4) AS resid_f2 FROM w")
def oof_residual_ols(spark, folder):
    folded = P.with_folds(stratified(spark, folder), "pos")
    return rounded(R.with_fold_residuals(folded, ["f1"], "f2", 5).select("pos", "pred_f2", "resid_f2"), 4)


@query(OOF + " SELECT part, count(*) AS n, round(1 - sum((f2 - pred) * (f2 - pred)) / (count(*) * var_pop(f2)), 6) AS r2, round(avg(abs(f2 - pred)), 4) AS mae, round(sqrt(avg((f2 - pred) * (f2 - pred))), 4) AS rmse, round(avg(abs(f2 - pred) / greatest(abs(f2), 1e-8)), 6) AS mape FROM w GROUP BY part")
def regression_metrics(spark, folder):
    folded = R.with_fold_residuals(P.with_folds(stratified(spark, folder), "pos"), ["f1"], "f2", 5).withColumn("part", F.split_part("strata", F.lit("|"), F.lit(1)))
    m = S.regression_metrics(folded, "f2", "pred_f2", ["part"])
    return m.select("part", "n", F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("mape", 6).alias("mape"))


@query(OOF + ", r AS (SELECT f2 - pred AS r FROM w) SELECT round(avg(r), 4) AS mean, round(quantile_cont(r, 0.5), 4) AS median, round(stddev_pop(r), 4) AS std, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 4) AS iqr, round(avg(abs(r)), 4) AS mean_abs, round(quantile_cont(abs(r), 0.9), 4) AS p90_abs FROM r")
def residual_report(spark, folder):
    folded = P.with_folds(stratified(spark, folder), "pos")
    return rounded(S.residual_report(R.with_fold_residuals(folded, ["f1"], "f2", 5), "resid_f2"), 4)


@query()
def residual_gbt(spark, folder):
    """200 boosted trees of depth 6 with l2 instead of a linear model; metrics of each split."""
    split = settled(P.with_split(stratified(spark, folder), "pos"), "split")
    fitted = boosting.fit_boosted(split.filter("split = 'train'"), ["f1", "f5", "load"], "f2")
    return rounded(S.regression_metrics(boosting.with_boosted_residuals(split, fitted, "f2"), "f2", "pred_f2", ["split"]))


# --- models at query time, positions, windows ------------------------------------------------------

WEIGHTS = {"f1": 2.0, "f2": 0.5, "f5": 1.0}
WEIGHTED = f"WITH {V}, q AS (SELECT " + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS q{c}" for c in WEIGHTS) + " FROM v), w AS (SELECT pos, " + ", ".join(f"round(CAST(CAST((coalesce({c}, q{c}[2]) - q{c}[2]) * (sqrt({w!r}::DOUBLE) / (q{c}[3] - q{c}[1])) AS FLOAT) AS DOUBLE), 4) + 0.0 AS {c}" for c, w in WEIGHTS.items()) + " FROM v, q)"


def robust(df: DataFrame) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (r["median"], r["iqr"]) for r in S.robust_stats(df, list(WEIGHTS)).collect()}  # a row per feature


@query(WEIGHTED + " SELECT * FROM w")
def weighted_matrix(spark, folder):
    store = samples(spark, folder)
    out = models.weighted_matrix(store, robust(store), WEIGHTS)
    return out.select("pos", *[(F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in WEIGHTS])


@query(WEIGHTED + " SELECT pos, CAST(list_sum(list_transform([f1, f2, f5], lambda x: x * x)) > 1 AS INTEGER) AS far FROM w WHERE pos % 20 = 0 AND abs(f1 * f1 + f2 * f2 + f5 * f5 - 1) > 0.001")
def weighted_vector(spark, folder):
    """Whether a query's weighted vector is longer than 1 (not those within rounding of it)."""
    store = samples(spark, folder)
    out = models.weighted_vector(store.filter("pos % 20 = 0"), robust(store), WEIGHTS)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.round(x.cast("double"), 4) * F.round(x.cast("double"), 4))
    return out.select("pos", square.alias("square")).filter(F.abs(F.col("square") - 1) > 0.001).select("pos", (F.col("square") > 1).cast("int").alias("far"))


@query(f"WITH {V}, m AS (SELECT regr_intercept(f2, f1) AS a, regr_slope(f2, f1) AS b FROM v WHERE pos % 20 <> 0) SELECT pos, round(a + b * f1, 4) AS pred_f2, round(f2 - a - b * f1, 4) AS resid_f2 FROM v, m WHERE pos % 20 = 0")
def query_residuals(spark, folder):
    """Residuals of queries by a model that was fitted on the other rows, saved and loaded."""
    store = samples(spark, folder)
    path = scratch_path(spark, "models")
    models.save_models(spark, path, {"f2": models.fit_linear(store.filter("pos % 20 <> 0"), ["f1"], "f2")})
    queries = models.with_models(store.filter("pos % 20 = 0"), models.load_models(spark, path, ["f2"]))
    return rounded(queries.select("pos", "pred_f2", "resid_f2"), 4)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events")
def stable_positions(spark, folder):
    return P.with_position(table(spark, folder, "events").select("ts", "event_id"), ["ts", "event_id"], "place").select("event_id", "place")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events WHERE event_type = 'click') WHERE place % 7 = 0")
def step_sample(spark, folder):
    return P.stepped(table(spark, folder, "events").select("ts", "event_id", "event_type"), "ts", 7, F.col("event_type") == "click").select("event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events) WHERE place = 123")
def row_by_index(spark, folder):
    return P.row_at(table(spark, folder, "events").select("ts", "event_id"), "ts", 123).select("event_id")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch, count(*) AS n, min(event_id) AS first_id FROM events WHERE CAST(ts AS DATE) IN (DATE '2024-01-03', DATE '2024-01-07', DATE '2024-01-09') GROUP BY 1")
def date_batches(spark, folder):
    rows = P.date_batches(table(spark, folder, "events"), "ts", ["2024-01-03", "2024-01-07", "2024-01-09"])
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), w AS (SELECT day, count(*) OVER r AS filled, sum(n) OVER r AS n_rows, max(day) OVER () AS last FROM d WINDOW r AS (ORDER BY day RANGE BETWEEN CURRENT ROW AND INTERVAL 2 DAY FOLLOWING)),
c AS (SELECT *, md5(CAST(day AS VARCHAR) || '|42') AS h FROM w WHERE day + INTERVAL 2 DAY <= last), t AS (SELECT * FROM c ORDER BY h LIMIT 20),
x AS (SELECT day FROM (SELECT day, 0 AS p, h AS o FROM t WHERE filled = 3 UNION ALL SELECT day, 1, CAST(999999999 - n_rows AS VARCHAR) FROM c) ORDER BY p, o, day LIMIT 1)
SELECT event_id FROM events, x WHERE CAST(ts AS DATE) >= day AND CAST(ts AS DATE) < day + INTERVAL 3 DAY""")
def random_window(spark, folder):
    return P.random_window(table(spark, folder, "events"), "ts", 3).select("event_id")


@query(f"""WITH {V}, {E}, {hits_sql()}, t AS (SELECT r.qid, r.rank, abs(epoch_us(q.date) - (epoch_us(r.date) + 1800000000)) / 86400e6::DOUBLE AS days FROM r JOIN v q ON q.pos = r.qid)
SELECT qid, round(max(CASE WHEN rank = 1 THEN days END), 6) AS top1_days, round(avg(days), 6) AS topk_mean_days FROM t GROUP BY qid""")
def topk_time_distance(spark, folder):
    """Each sample's window is the hour from its order's time."""
    best = ranked(spark, folder, more=("date",))
    asked = samples(spark, folder).select(F.col("pos").alias("qid"), F.col("date").alias("q_date"))
    text = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    window = F.concat(text("date"), F.lit("~"), text(F.col("date") + F.expr("interval 1 hour")))
    return rounded(report.time_distances(best.join(asked, "qid").withColumn("window", window), "q_date", "window"))


# --- time series ---------------------------------------------------------------------------------

H = "h AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS load, " + ", ".join(f"avg(CASE WHEN event_type = '{k}' THEN value END) AS {k}" for k in KINDS) + " FROM events GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM h)"


def scaled_grid(spark, folder) -> DataFrame:
    """The hourly grid, numbered, with the types' means scaled as a diagonal metric would."""
    return D.numbered(hourly_grid(spark, folder), "ts").withColumns({k: F.col(k) * w for k, w in SCALES.items()})


@query("""WITH o AS (SELECT event_id, ts, user_id, lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) AS prev_ts FROM events)
SELECT event_id, prev_ts, coalesce(abs(epoch_us(ts) - epoch_us(prev_ts)) > 2700000000, false) AS reset FROM o""")
def gap_reset(spark, folder):
    df = table(spark, folder, "events").withColumn("series", F.col("user_id") % 10)
    return K.with_gap_reset(df, "ts", F.lit(True), 45.0, ["series"]).select("event_id", "prev_ts", "reset")


@query(f"""WITH RECURSIVE {H}, r AS (
SELECT rn, ts, load, click, load AS final_load, click AS final_click FROM n WHERE rn = 1 UNION ALL
SELECT n.rn, n.ts, n.load, n.click, CASE WHEN abs(n.load - r.final_load) > {LIMIT} THEN r.final_load + sign(n.load - r.final_load) * {LIMIT} ELSE n.load END,
       CASE WHEN abs(n.click - r.final_click) > {LIMIT} THEN r.final_click + sign(n.click - r.final_click) * {LIMIT} ELSE n.click END FROM n JOIN r ON n.rn = r.rn + 1)
SELECT ts, round(final_load, 6) AS final_load, round(final_click, 6) AS final_click FROM r""")
def rate_limit(spark, folder):
    """One series without resets; a limited column without a value starts anew."""
    how = Continuity(enable_rate_limit=True, rate_limits={"load": LIMIT, "click": LIMIT}, reset_on_time_gap=False)
    return rounded(K.apply_continuity(hourly_grid(spark, folder).select("ts", "load", "click"), "ts", ["load", "click"], how).select("ts", "final_load", "final_click"))


@query(f"""WITH RECURSIVE n AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS rn FROM events),
r AS (SELECT user_id, rn, ts, value, value AS final_value, 'first_valid_point' AS continuity_status FROM n WHERE rn = 1 UNION ALL
SELECT n.user_id, n.rn, n.ts, n.value, CASE WHEN n.ts - r.ts <= INTERVAL 45 MINUTE AND abs(n.value - r.final_value) > {LIMIT} THEN r.final_value + sign(n.value - r.final_value) * {LIMIT} ELSE n.value END,
       CASE WHEN n.ts - r.ts > INTERVAL 45 MINUTE THEN 'time_gap_reset' WHEN abs(n.value - r.final_value) > {LIMIT} THEN 'limited' ELSE 'not_limited' END FROM n JOIN r ON n.user_id = r.user_id AND n.rn = r.rn + 1)
SELECT user_id, ts, round(value, 6) AS value, round(final_value, 6) AS final_value, continuity_status FROM r""")
def stream_continuity(spark, folder):
    """The rate limit on a stream of each user's events, written as Parquet with a checkpoint."""
    from tessella.streaming.continuity import stream_continuity as on_stream
    from tessella.streaming.continuity import use_state_store

    use_state_store(spark)
    source = f"{folder}/events.parquet"
    files = spark.read.parquet(source)
    stream = spark.readStream.schema(files.schema).parquet(source if files.inputFiles()[0].rsplit("/", 1)[0].endswith(".parquet") else f"{folder}/events*.parquet")
    how = Continuity(enable_rate_limit=True, rate_limits={"value": LIMIT}, max_gap_minutes=45.0)
    limited = on_stream(stream.select("user_id", "ts", "value"), "user_id", "ts", ["value"], how)
    out = scratch_path(spark, "stream")
    limited.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "stream-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.schema(limited.schema).parquet(out))


LIVE_GAP, LIVE_LIMIT = 1200, 4.0


@query(f"""WITH RECURSIVE {V}, c AS (SELECT covar_samp(f1, f1) AS a0, covar_samp(f1, f2) AS b, covar_samp(f2, f2) AS d0 FROM v), k AS (SELECT a0 + 1e-6 * (a0 + d0) / 2 AS a, b, d0 + 1e-6 * (a0 + d0) / 2 AS d FROM c),
m AS (SELECT 0.6 * d / (a * d - b * b) AS m11, -sqrt(0.6 * 0.4) * b / (a * d - b * b) AS m12, 0.4 * a / (a * d - b * b) AS m22 FROM k),
q AS (SELECT user_id % 10 AS series, ts, 5000 * value AS load, 2 * value AS f1, 40000 + 200 * value AS f2 FROM events WHERE event_id % 20 = 0),
p AS (SELECT q.series, q.ts, x.pos, x.f1, 1 / (1 + greatest(m11 * (q.f1 - x.f1) * (q.f1 - x.f1) + 2 * m12 * (q.f1 - x.f1) * (q.f2 - x.f2) + m22 * (q.f2 - x.f2) * (q.f2 - x.f2), 0)) AS s FROM q JOIN v x ON abs(q.load - x.load) <= 15000, m),
t AS (SELECT *, row_number() OVER (PARTITION BY series, ts ORDER BY s DESC, pos) AS rank FROM p QUALIFY rank <= 5),
g AS (SELECT series, ts, sum(f1 * greatest(s, 0.001)) / sum(greatest(s, 0.001)) AS plan FROM t GROUP BY series, ts), n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS rn FROM g),
r AS (SELECT series, rn, ts, plan, plan AS final, 'first_valid_point' AS status FROM n WHERE rn = 1 UNION ALL
SELECT n.series, n.rn, n.ts, n.plan, CASE WHEN n.ts - r.ts <= INTERVAL {LIVE_GAP} MINUTE AND abs(n.plan - r.final) > {LIVE_LIMIT} THEN r.final + sign(n.plan - r.final) * {LIVE_LIMIT} ELSE n.plan END,
  CASE WHEN n.ts - r.ts > INTERVAL {LIVE_GAP} MINUTE THEN 'time_gap_reset' WHEN abs(n.plan - r.final) > {LIVE_LIMIT} THEN 'limited' ELSE 'not_limited' END FROM n JOIN r ON n.series = r.series AND n.rn = r.rn + 1)
SELECT q.series, q.ts, round(r.plan, 4) AS plan_f1, round(r.final, 4) AS final_plan_f1, coalesce(r.status, 'no_valid_center') AS continuity_status FROM q LEFT JOIN r USING (series, ts)""")
def live_plans(spark, folder):
    """Every twentieth event is a query row of one of ten series. They come as a stream of five files, a
    file a batch, restarted after the second; each batch meets the store, and the limits go on."""
    from tessella.streaming.plans import LivePlans

    features = Features(raw=("f1", "f2"), weights={"f1": 0.6, "f2": 0.4}, plan_center_cols=("f1",))
    how = Continuity(enable_rate_limit=True, rate_limits={"f1": LIVE_LIMIT}, max_gap_minutes=LIVE_GAP)
    config = Config(features=features, gate=GATE, matching=Matching(enable_low_sim_fallback=False), continuity=how)
    live = LivePlans(PlanningEngine(spark, config, order_store(spark, folder)), scratch_path(spark, "live"), "ts", ["series"])
    value = F.col("value")
    rows = table(spark, folder, "events").filter("event_id % 20 = 0").select((F.col("user_id") % 10).alias("series"), "ts", (5000 * value).alias("load"), (2 * value).alias("f1"), (40000 + 200 * value).alias("f2"))
    part = F.floor(F.datediff("ts", F.lit("2024-01-01").cast("timestamp_ntz")) / 6)
    source, state = scratch_path(spark, "live-source"), scratch_path(spark, "live-state")
    for i, number in enumerate(sorted(r["part"] for r in rows.select(part.alias("part")).distinct().collect())):  # a number per six days
        rows.filter(part == number).coalesce(1).write.mode("append").parquet(source)
        if i in (1, 5):
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
            live.start(stream, state).awaitTermination()
    live.start(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source), state).awaitTermination()
    return rounded(live.plans().select("series", "ts", "plan_f1", "final_plan_f1", "continuity_status"), 4)


@query(f"WITH {H}, i AS (SELECT *, rn - row_number() OVER (ORDER BY rn) AS island FROM n WHERE abs(load - 50) <= 15) SELECT min(rn) AS first_rn, max(rn) AS last_rn, count(*) AS length, round(avg(load), 6) AS mean_load FROM i GROUP BY island HAVING count(*) >= 3")
def load_runs(spark, folder):
    grid = D.numbered(hourly_grid(spark, folder), "ts")
    return rounded(D.load_runs(grid, F.abs(F.col("load") - 50) <= 15, min_length=3).select(F.col("first_rn").cast("long").alias("first_rn"), F.col("last_rn").cast("long").alias("last_rn"), "length", "mean_load"))


def sequence_sql(config: Sequence = SEQUENCE, grid: str = H, key: str = "true", every: int = 20) -> str:
    """Candidates (c) of the queries of a numbered grid (n), of series by ``key``."""
    q, m, t = config.query_len, config.candidate_len, config.load_threshold
    vector = "[" + ", ".join(f"coalesce({k} * {w!r}::DOUBLE, 0)" for k, w in SCALES.items()) + "]"
    parts = [grid, f"""w AS (SELECT *, list({vector}) OVER (PARTITION BY {key} ORDER BY rn ROWS BETWEEN CURRENT ROW AND {q - 1} FOLLOWING) AS short, list({vector}) OVER (PARTITION BY {key} ORDER BY rn ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING) AS long,
 list({vector}) OVER b AS query, avg(load) OVER b AS mean_load, min(rn) OVER b AS first_rn, min(load) OVER a AS low, max(load) OVER a AS high, count(load) OVER a AS loads
 FROM n WINDOW b AS (PARTITION BY {key} ORDER BY rn ROWS BETWEEN {q - 1} PRECEDING AND CURRENT ROW), a AS (PARTITION BY {key} ORDER BY rn ROWS BETWEEN CURRENT ROW AND {q - 1} FOLLOWING))""",
    f"j AS (SELECT e.rn AS qid, e.ts AS q_ts, e.query, e.mean_load AS q_load, e.first_rn AS q_first, r.* EXCLUDE (query, mean_load, first_rn) FROM w e JOIN w r ON e.rn % {every} = 0 AND len(e.query) = {q} AND r.rn < e.first_rn AND r.ts >= e.ts - INTERVAL 3 DAY AND ({'true' if key == 'true' else f'e.{key} = r.{key}'}))",
    f"k AS (SELECT *, min(rn) OVER p AS ref_first, count(*) OVER p AS ref_rows, bool_and(abs(load - q_load) <= {t}) OVER p AS all_near, max(CASE WHEN abs(load - q_load) <= {t} THEN NULL ELSE rn END) OVER (PARTITION BY {key}, qid ORDER BY rn) AS last_far FROM j WINDOW p AS (PARTITION BY {key}, qid))",
    f"l AS (SELECT *, rn - coalesce(last_far + 1, ref_first) AS into_run FROM k), v AS (SELECT *, rn + {q} <= q_first AND loads = {q} AND abs(low - q_load) <= {t} AND abs(high - q_load) <= {t} AND into_run % {config.prefilter_step} = 0 AS in_run FROM l)",
    f"u AS (SELECT *, in_run AND into_run = 0 AS run_start, in_run AND (SELECT avg(1 / (1 + power(list_distance(query[i], short[i]), 2))) FROM range(1, {q} + 1) g(i)) >= {config.sim_threshold} AS passes FROM v)",
    f"o AS (SELECT *, bool_or(in_run) OVER (PARTITION BY {key}, qid) AS any_run, bool_or(passes) OVER (PARTITION BY {key}, qid) AS any_pass FROM u)",
    f"c AS (SELECT * EXCLUDE (rn, long), rn AS start, long AS candidate FROM o WHERE ref_rows >= {m} AND rn + {m} <= q_first AND CASE WHEN NOT any_run OR all_near THEN (rn - ref_first) % {config.slide_step} = 0 WHEN any_pass THEN passes ELSE run_start END)"]
    return ", ".join(parts)


def warp_sql(source: str = "c", more: str = "") -> str:
    """The alignment, cell after cell, each as a further step."""
    q, m, band = SEQUENCE.query_len, SEQUENCE.candidate_len, max(SEQUENCE.band, 1)
    steps, last = [], source
    cells = [(i, j) for i in range(q) for j in range(m) if abs(i - j) <= band]
    for i, j in cells:
        d = f"list_distance(query[{i + 1}], candidate[{j + 1}])"
        before = [b for b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if b in cells]
        if not before:
            c, s, n = "0", "0", "0"
        else:
            least = "least(" + ", ".join(f"c{a}_{b}" for a, b in before) + ")"
            pick = lambda x: "CASE " + " ".join(f"WHEN c{a}_{b} = {least} THEN {x}{a}_{b}" for a, b in before) + " END"
            c, s, n = least, pick("s"), pick("n")
        name = f"{source}{i}_{j}"
        steps.append(f"{name} AS (SELECT *, {c} + {d} AS c{i}_{j}, {s} + 1 / (1 + {d} * {d}) AS s{i}_{j}, {n} + 1 AS n{i}_{j} FROM {last})")
        last = name
    end = f"{q - 1}_{m - 1}"
    steps.append(f"al AS (SELECT qid, q_ts, start, {more}c{end} AS path_cost, s{end} / n{end} AS similarity, n{end} AS path_length FROM {last})")
    return ", ".join(steps)


@query(f"WITH {sequence_sql()} SELECT qid, count(*) AS n_candidates, min(start) AS first_start, max(start) AS last_start FROM c GROUP BY qid")
def window_prefilter(spark, folder):
    c = D.candidates(scaled_grid(spark, folder), KINDS, SEQUENCE, F.col("rn") % 20 == 0)
    return c.groupBy(F.col("qid").cast("long").alias("qid")).agg(F.count(F.lit(1)).alias("n_candidates"), F.min("start").cast("long").alias("first_start"), F.max("start").cast("long").alias("last_start"))


@query(f"WITH {sequence_sql()}, {warp_sql()} SELECT qid, start, round(path_cost, 6) AS path_cost, round(similarity, 6) AS similarity, CAST(path_length AS INTEGER) AS path_length FROM al")
def dtw_align(spark, folder):
    c = D.candidates(scaled_grid(spark, folder), KINDS, SEQUENCE, F.col("rn") % 20 == 0)
    aligned = D.with_alignment(c, "query", "candidate", SEQUENCE.query_len, SEQUENCE.candidate_len, SEQUENCE.band)
    return rounded(aligned.select(F.col("qid").cast("long").alias("qid"), F.col("start").cast("long").alias("start"), "path_cost", "similarity", "path_length"))


@query(f"""WITH {sequence_sql()}, {warp_sql()}, rk AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n_candidates, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, start) AS rank FROM al QUALIFY rank <= 5),
la AS (SELECT rk.*, n.load, n.ts AS end_ts FROM rk JOIN n ON n.rn = start + {SEQUENCE.candidate_len - 1})
SELECT qid, count(*) AS topk_count, round(avg(similarity), 6) AS s_topk_mean, round(max(CASE WHEN rank = 1 THEN path_cost END), 6) AS path_cost, max(n_candidates) AS n_candidates,
 round(abs(epoch_us(max(CASE WHEN rank = 1 THEN end_ts END)) - epoch_us(max(q_ts))) / 86400e6, 6) AS time_offset_days, round(sum(load * greatest(similarity, 0.001)) / sum(greatest(similarity, 0.001)), 6) AS plan_load FROM la GROUP BY qid""")
def dtw_topk(spark, folder):
    ranked_ = D.query_sequences(scaled_grid(spark, folder), KINDS, ["load"], SEQUENCE, F.col("rn") % 20 == 0)
    return rounded(D.sequence_centers(ranked_, ["load"]).select(F.col("qid").cast("long").alias("qid"), "topk_count", "s_topk_mean", "path_cost", "n_candidates", "time_offset_days", "plan_load"))


STEPPED = Sequence(ref_days=3.0, load_threshold=8.0, sim_threshold=0.35, prefilter_step=2, slide_step=3)


@query(f"WITH {sequence_sql(STEPPED)} SELECT qid, start FROM c")
def stepped_windows(spark, folder):
    """Windows every second row of a run of near loads, every third row where there is no run."""
    c = D.candidates(settled(scaled_grid(spark, folder), "grid"), KINDS, STEPPED, F.col("rn") % 20 == 0)
    return c.select(F.col("qid").cast("long").alias("qid"), F.col("start").cast("long").alias("start"))


KEYED = "h AS (SELECT user_id % 3 AS series, date_trunc('hour', ts) AS ts, avg(value) AS load, " + ", ".join(f"avg(CASE WHEN event_type = '{k}' THEN value END) AS {k}" for k in KINDS) + " FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS rn FROM h)"


@query(f"""WITH {sequence_sql(STEPPED, KEYED, "series", 9)}, {warp_sql(more="series, ")}, rk AS (SELECT *, count(*) OVER (PARTITION BY series, qid) AS n_candidates, row_number() OVER (PARTITION BY series, qid ORDER BY similarity DESC, start) AS rank FROM al QUALIFY rank <= 5),
la AS (SELECT rk.*, n.load FROM rk JOIN n ON n.rn = start + {STEPPED.candidate_len - 1} AND n.series = rk.series),
g AS (SELECT series, qid, count(*) AS topk_count, max(n_candidates) AS n_candidates, round(avg(similarity), 6) AS s_topk_mean, round(sum(load * greatest(similarity, 0.001)) / sum(greatest(similarity, 0.001)), 6) AS plan_load FROM la GROUP BY series, qid),
a AS (SELECT e.series, e.rn AS qid, (SELECT count(*) FROM n r WHERE r.series = e.series AND r.rn <= e.rn AND r.ts >= e.ts - INTERVAL 3 DAY) AS n_rows FROM n e WHERE e.rn % 9 = 0)
SELECT series, qid, coalesce(topk_count, 0) AS topk_count, n_candidates, s_topk_mean, plan_load, CASE WHEN topk_count IS NOT NULL THEN 'sequence_matched' WHEN n_rows < {STEPPED.query_len + STEPPED.candidate_len} THEN 'failed:too_few_rows' ELSE 'failed:no_window' END AS match_status FROM a LEFT JOIN g USING (series, qid)""")
def keyed_sequences(spark, folder):
    """Three series planned at once; a query that fails is a row that tells why."""
    found = [F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in KINDS]
    events = table(spark, folder, "events").select((F.col("user_id") % 3).alias("series"), F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"), "event_type", "value")
    grid = settled(D.numbered(events.groupBy("series", "ts").agg(F.avg("value").alias("load"), *found), "ts", ["series"]).withColumns({k: F.col(k) * w for k, w in SCALES.items()}), "grid")
    out = D.planned_sequences(grid, KINDS, ["load"], STEPPED, F.col("rn") % 9 == 0, keys=["series"])
    return rounded(out.select("series", F.col("qid").cast("long").alias("qid"), "topk_count", "n_candidates", "s_topk_mean", "plan_load", "match_status"))


@query("""WITH e AS (SELECT event_id, ts, value FROM events) SELECT q.event_id AS qid, count(*) AS n_rows, round(sum(r.value), 4) AS sum_value FROM e q JOIN e r ON q.event_id % 20 = 0 AND r.ts >= q.ts - INTERVAL 3 HOUR AND r.ts <= q.ts GROUP BY q.event_id""")
def trailing_range_join(spark, folder):
    """Rows of the three hours up to each query's time, by a tree of sums over the times."""
    events = table(spark, folder, "events").select("event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    asked = events.filter("event_id % 20 = 0 and at is not null").select(F.col("event_id").alias("qid"), (F.col("at") - 3 * 3_600_000_000).alias("low"), F.col("at").alias("high"))
    totals = {"n_rows": (1, F.sum), "sum_value": ("value", F.sum)}
    found = range_totals(asked.select("low", "high").distinct(), "low", "high", events, "at", totals)
    return rounded(asked.join(found, ["low", "high"]).groupBy("qid").agg(F.sum("n_rows").alias("n_rows"), F.sum("sum_value").alias("sum_value")), 4)


@query("SELECT o_orderkey, round(abs(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1995-06-17')) / 86400e6, 6) AS days FROM orders")
def time_distance(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.round(C.days_between(F.col("o_orderdate"), F.lit("1995-06-17").cast("timestamp_ntz")), 6).alias("days"))


@query("SELECT o_orderkey, epoch_us(o_orderdate) + 300000000 AS middle_us FROM orders")
def window_midpoint(spark, folder):
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("~"), F.date_format(F.col("o_orderdate") + F.expr("interval 10 minutes"), "yyyy-MM-dd HH:mm:ss"))
    return table(spark, folder, "orders").select("o_orderkey", F.unix_micros(C.window_midpoint(text)).alias("middle_us"))


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), c AS (SELECT day FROM d ORDER BY md5(CAST(day AS VARCHAR) || '|42') LIMIT 10),
r AS (SELECT event_id, day, row_number() OVER (PARTITION BY day ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id) AS rank FROM events JOIN c ON CAST(ts AS DATE) = day)
SELECT event_id, CAST(day AS VARCHAR) AS day, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def daily_sample(spark, folder):
    return P.daily_sample(table(spark, folder, "events"), "ts", "event_id", 10, 10).select("event_id", F.col("day").cast("string").alias("day"), "rank")


@query("""WITH c AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1), g AS (SELECT unnest(generate_series((SELECT min(hour) FROM c), (SELECT max(hour) FROM c), INTERVAL 1 HOUR)) AS hour),
r AS (SELECT hour, sum(coalesce(n, 0)) OVER a AS n_rows, count(*) OVER a AS k FROM g LEFT JOIN c USING (hour) WINDOW a AS (ORDER BY hour ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING))
SELECT hour AS start_ts, CAST(n_rows AS BIGINT) AS n_rows FROM r WHERE k = 48 ORDER BY n_rows DESC, hour LIMIT 1""")
def densest_window(spark, folder):
    return P.densest_window(table(spark, folder, "events"), "ts", 48)


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def distinct_dates(spark, folder):
    return table(spark, folder, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {H}, t AS (SELECT 'load' AS panel, load AS value FROM n UNION ALL SELECT 'types', unnest([click, view]) FROM n) SELECT panel, round(min(value) - 0.1 * (max(value) - min(value)), 6) AS axis_min, round(max(value) + 0.1 * (max(value) - min(value)), 6) AS axis_max FROM t GROUP BY panel")
def figure_axes(spark, folder):
    return rounded(report.axis_ranges(report.tidy(hourly_grid(spark, folder), "ts", {"load": ("load",), "types": ("click", "view")})))
