"""Column handling: aliases, coercion, checks, time ranges."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which a time column is looked for, in this order.
TIME_NAMES = ("ts", "time", "timestamp", "datetime", "date", "date_time", "event_time", "record_time")


def first_of_duplicates(df: DataFrame) -> DataFrame:
    """Of columns that share a name the first stays."""
    unique = df.toDF(*[f"{c}__{i}" for i, c in enumerate(df.columns)])
    first = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    return unique.select(*[F.col(f"`{c}__{i}`").alias(c) for i, c in enumerate(df.columns) if first[c] == i])


def renamed(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Renames alias columns to their standard names; where the standard name is there already,
    the alias column goes."""
    for alias, name in aliases.items():
        if alias in df.columns and alias != name:
            df = df.drop(alias) if name in df.columns else df.withColumnRenamed(alias, name)
    return df


def copied(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Adds standard names as copies of their alias columns."""
    return df.withColumns({name: F.col(f"`{alias}`") for alias, name in aliases.items() if alias in df.columns and name not in df.columns})


def require(df: DataFrame, columns: Iterable[str], what: str = "the table") -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks the columns {missing}")
    return df


def finite(value: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Columns as doubles; what doesn't parse, NaN and infinities become null."""
    return df.withColumns({c: finite(F.col(f"`{c}`").try_cast("double")) for c in columns if c in df.columns})


def zero_filled(value: Column) -> Column:
    return F.coalesce(finite(value), F.lit(0.0))


def time_column(df: DataFrame, wanted: str | None = None) -> str:
    if wanted:
        require(df, [wanted])
        return wanted
    for name in TIME_NAMES:
        if name in df.columns:
            return name
    raise ValueError(f"no time column among {df.columns}")


def as_time(value: Column) -> Column:
    """A timestamp without zone; null if it doesn't parse."""
    return value.try_cast("timestamp_ntz")


def time_bound(value: str | datetime | None, is_end: bool) -> datetime | None:
    """A bound of a half-open range: an end that is only a date means all of that day."""
    if value is None:
        return None
    if isinstance(value, str):
        date_only = re.fullmatch(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", value.strip())
        parts = [int(p) for p in re.findall(r"\d+", value)]
        value = datetime(*parts[:6])
        if date_only and is_end:
            value += timedelta(days=1)
    return value


def in_range(df: DataFrame, column: str, start=None, end=None, required: bool = False) -> DataFrame:
    """Rows from ``start`` to before ``end``; rows without time go. An empty range is an error if
    ``required``."""
    low, high = time_bound(start, False), time_bound(end, True)
    keep = F.col(column).isNotNull()
    if low is not None:
        keep &= F.col(column) >= F.lit(low).cast("timestamp_ntz")
    if high is not None:
        keep &= F.col(column) < F.lit(high).cast("timestamp_ntz")
    if required and not df.filter(keep).head(1):
        raise ValueError(f"no rows from {low} to {high}")
    return df.filter(keep)


def before_cutoff(df: DataFrame, column: str, cutoff) -> DataFrame:
    """Rows before a cut-off; a missing column changes nothing."""
    return df.filter(as_time(F.col(column)) < F.lit(time_bound(cutoff, False)).cast("timestamp_ntz")) if column in df.columns else df


def without_last_month(df: DataFrame, column: str, reference: DataFrame, reference_column: str) -> DataFrame:
    """Rows before one calendar month before the newest time of ``reference``."""
    newest = reference.agg(F.max(as_time(F.col(reference_column))).alias("newest"))
    limit = newest.select((F.col("newest") - F.expr("interval 1 month")).alias("limit"))
    return df.crossJoin(F.broadcast(limit)).filter(as_time(F.col(column)) < F.col("limit")).drop("limit")  # one row


def last_days(df: DataFrame, column: str, days: int) -> DataFrame:
    limit = df.agg((F.max(column) - F.expr(f"interval {int(days)} days")).alias("limit"))
    return df.crossJoin(F.broadcast(limit)).filter(F.col(column) >= F.col("limit")).drop("limit")  # one row


def features(df: DataFrame, columns: Iterable[str], lenient: bool = False) -> list[Column]:
    """Feature columns; a missing one is an error, or 0 if ``lenient``."""
    if not lenient:
        require(df, columns)
    return [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns]


def window_midpoint(window: Column) -> Column:
    """Middle of ``start~end``; null if malformed."""
    start, end = (F.try_to_timestamp(F.trim(F.split_part(window, F.lit("~"), F.lit(i)))) for i in (1, 2))
    return F.timestamp_micros(F.expr("0") + F.floor((F.unix_micros(start) + F.unix_micros(end)) / 2).cast("long"))


def days_between(a: Column, b: Column) -> Column:
    """Absolute distance in days of two timestamps without zone."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.abs(micros(a) - micros(b)) / F.lit(86_400e6)
