"""Observation windows: building them, pairing them and assigning rows to them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fairlead.functions.timeline import MICROS, plus_micros
from fairlead.sources.registry import local_table

DAY = 86_400

WINDOW = T.StructType([
    T.StructField("window_id", T.StringType()),
    T.StructField("start_at", T.TimestampType()),
    T.StructField("end_at", T.TimestampType()),
])


def windows(spark: SparkSession, bounds: list[tuple[str, str, str]]) -> DataFrame:
    """A windows table from (window_id, ISO start, ISO end)."""
    stamp = lambda s: dt.datetime.fromisoformat(s.replace("Z", "+00:00")).replace(tzinfo=dt.timezone.utc)
    rows = [{"window_id": i, "start_at": stamp(s), "end_at": stamp(e)} for i, s, e in bounds]
    return local_table(spark, rows, WINDOW)


def in_window(start: Column, end: Column, at: str = "observed_at") -> Column:
    """Both ends belong to the window."""
    return F.col(at).between(start, end)


def default_window(obs: DataFrame) -> DataFrame:
    """The window that spans all observations; fails on an empty table."""
    span = obs.agg(F.min("observed_at").alias("start_at"), F.max("observed_at").alias("end_at"))
    checked = F.when(F.col("start_at").isNull(), F.raise_error(F.lit("no observations loaded"))).otherwise(
        F.col("start_at")
    )
    return span.select(F.lit("default").alias("window_id"), checked.alias("start_at"), "end_at")


def with_baseline(wins: DataFrame) -> DataFrame:
    """Each window twice: as current, and as the preceding window of equal span."""
    span = F.unix_micros("end_at") - F.unix_micros("start_at")
    checked = F.when(span <= 0, F.raise_error(F.lit("window must have positive span")).cast("bigint")).otherwise(span)
    role = F.explode(F.array(F.lit("current"), F.lit("baseline"))).alias("role")
    return wins.withColumn("_span", checked).select("*", role).select(
        "window_id",
        "role",
        F.when(F.col("role") == "current", F.col("start_at"))
        .otherwise(plus_micros(F.col("start_at"), -F.col("_span"))).alias("window_start"),
        F.when(F.col("role") == "current", F.col("end_at")).otherwise(F.col("start_at")).alias("window_end"),
        F.col("end_at").alias("computed_at"),
    )


def relative_windows(requests: DataFrame, available: DataFrame) -> DataFrame:
    """Resolve "last n hours" against a reference time, clamped to the available data.

    ``requests``: relative, reference_at (plus any key columns).  ``available`` is one
    window; more than one is an error.
    """
    hours = (
        F.when(F.col("relative") == "last_24_hours", 24).when(F.col("relative") == "last_3_days", 72).otherwise(6)
    )
    many = F.raise_error(F.lit("more than one available window")).cast("timestamp")
    bounds = available.agg(F.min("start_at").alias("_from"), F.max("end_at").alias("_to"), F.count("*").alias("_n")).select(
        F.when(F.col("_n") > 1, many).otherwise(F.col("_from")).alias("_from"), "_to"
    )
    end = F.least("reference_at", "_to")
    return (
        requests.join(F.broadcast(bounds))
        .withColumn("end_at", end)
        .withColumn("start_at", F.greatest("_from", plus_micros(end, -hours.cast("bigint") * 3600 * MICROS)))
        .drop("_from", "_to")
    )


def replay_cursors(bounds: DataFrame, step_seconds: int, lookback_seconds: int = 6 * 3600) -> DataFrame:
    """Look-back windows ending at each cursor; cursors step from start and stop at the end."""
    start, end = F.unix_micros("start_at"), F.unix_micros("end_at")
    steps = F.ceil((end - start) / F.lit(step_seconds * MICROS))
    cursor = F.least(start + F.col("_k") * F.lit(step_seconds * MICROS), end)
    return (
        bounds.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), steps)))
        .select(F.timestamp_micros(cursor).alias("cursor_at"))
        .select(
            F.unix_micros("cursor_at").cast("string").alias("window_id"),
            plus_micros(F.col("cursor_at"), -lookback_seconds * MICROS).alias("start_at"),
            F.col("cursor_at").alias("end_at"),
        )
    )


def prune_to_windows(rows: DataFrame, wins: DataFrame, start: str = "start_at", end: str = "end_at",
                     at: str = "observed_at") -> DataFrame:
    """Keep the rows between the first start and the last end of a small windows table.

    The two bounds become literals, so date partitions and row groups outside them
    are never read.  Rows outside every window cannot change a window's result.
    """
    first, last = wins.agg(F.min(F.unix_micros(start)), F.max(F.unix_micros(end))).first()
    if first is None:
        return rows.limit(0)
    low, high = F.timestamp_micros(F.lit(first)), F.timestamp_micros(F.lit(last))
    kept = rows.filter(F.col(at).between(low, high))
    if at == "observed_at" and "observed_date" in rows.columns:  # the partition column of observation tables
        kept = kept.filter(F.col("observed_date").between(F.to_date(low), F.to_date(high)))
    return kept


def assign_windows(
    rows: DataFrame,
    wins: DataFrame,
    start: str = "start_at",
    end: str = "end_at",
    at: str = "observed_at",
    bucket_seconds: int = DAY,
) -> DataFrame:
    """Range join of rows to the windows that contain them, as an equi-join on time buckets.

    A window is listed once per bucket it touches, a row sits in one bucket, so
    each (row, window) pair is produced exactly once and nothing is compared
    outside its bucket.
    """
    width = F.lit(bucket_seconds * MICROS)
    bucket = lambda c: F.floor(F.unix_micros(c) / width)
    listed = wins.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    return (
        rows.withColumn("_bucket", bucket(F.col(at)))
        .join(listed, "_bucket")
        .filter(F.col(at).between(F.col(start), F.col(end)))
        .drop("_bucket")
    )
