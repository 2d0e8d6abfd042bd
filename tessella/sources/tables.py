"""Sources and sinks: Parquet, CSV with byte-order mark, JSON artifacts, and the views that queries use."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.columns import numeric, renamed, require

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_standard(spark: SparkSession, path: str, columns: Sequence[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Only the wanted columns, after aliases, as doubles where they are numbers."""
    df = require(renamed(spark.read.parquet(path), aliases or {}), columns, path).select(*columns)
    return numeric(df, [c for c, kind in df.dtypes if kind in ("string", "int", "bigint", "float", "double")])


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; the first column's name carries the mark that spreadsheets look for."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def fingerprint(*parts) -> str:
    """A digest of settings and artifacts, by which a materialised view is known to be current."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_covariance(spark: SparkSession, path: str, cov_reg_inverse: np.ndarray, columns: Sequence[str], reg_lambda: float) -> None:
    """The inverse without weights (those are applied when it is read) and its column order."""
    rows = [(list(columns), [[float(x) for x in r] for r in cov_reg_inverse], float(reg_lambda), fingerprint(list(columns), np.asarray(cov_reg_inverse).tolist(), reg_lambda))]
    spark.createDataFrame(rows, "feature_cols array<string>, cov_reg_inverse array<array<double>>, reg_lambda double, fingerprint string").coalesce(1).write.mode("overwrite").json(path)


def read_covariance(spark: SparkSession, path: str, columns: Sequence[str]) -> np.ndarray:
    """Raises ValueError if the artifact is of other columns or another order."""
    row = spark.read.schema("feature_cols array<string>, cov_reg_inverse array<array<double>>, reg_lambda double, fingerprint string").json(path).first()
    if list(row["feature_cols"]) != list(columns):
        raise ValueError(f"the covariance is of {row['feature_cols']}, not of {list(columns)}")
    if row["fingerprint"] != fingerprint(list(columns), row["cov_reg_inverse"], row["reg_lambda"]):
        raise ValueError("the covariance doesn't match its fingerprint")
    return np.array(row["cov_reg_inverse"])


def cached_view(spark: SparkSession, path: str, key: str, build) -> DataFrame:
    """The table at ``path/key``; built first where it isn't there yet."""
    target = f"{path}/{key}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        write_parquet(build(), target)
    return spark.read.parquet(target)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessella-")
        sc.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The table written to a scratch path and read again: what reads it several times doesn't
    compute it several times. The write's own shuffle files go when it is done."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``settled`` that nothing will read again: what was made of them is settled."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def order_store(spark: SparkSession, folder: str) -> DataFrame:
    """A sample per order: pos, load, f1 to f5 and eff, of its line items."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("f1"), F.avg("l_extendedprice").alias("f2"), F.avg("l_discount").alias("f3"), F.avg("l_tax").alias("f4"), F.count(F.lit(1)).cast("double").alias("f5"),
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_extendedprice")).alias("eff"),
    )
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("load"), F.col("o_orderdate").alias("date"))
    return orders.join(lines, F.col("pos") == F.col("l_orderkey")).drop("l_orderkey")


def hourly_grid(spark: SparkSession, folder: str) -> DataFrame:
    """A row per hour with events: mean value by type (null without), and of all as load."""
    events = table(spark, folder, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"), "event_type", "value")
    kinds = ["click", "error", "purchase", "signup", "view"]
    found = [F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in kinds]
    return events.groupBy("ts").agg(F.avg("value").alias("load"), *found)
