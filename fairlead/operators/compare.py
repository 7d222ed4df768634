"""Baseline comparison, threshold event rules and detector scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fairlead.functions.quality import comparison_label, comparison_rank
from fairlead.sources.registry import local_table

RULE = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("rule_direction", T.StringType()),
    T.StructField("relative_threshold", T.DoubleType()),
    T.StructField("absolute_threshold", T.DoubleType()),
])

# Event type, watched metric, direction, relative threshold, absolute threshold.
DEFAULT_RULES = [
    ("queue_buildup", "dwell_cohort_size", "increase", 0.25, 3.0),
    ("stoppage", "moving_fraction", "decrease", 0.2, 0.05),
    ("flow_surge", "entry_count", "increase", 0.3, 2.0),
    ("flow_drop", "entry_count", "decrease", 0.3, 2.0),
]


def default_rules(spark: SparkSession) -> DataFrame:
    names = [f.name for f in RULE.fields]
    return local_table(spark, [dict(zip(names, r)) for r in DEFAULT_RULES], RULE)


def paired(metrics: DataFrame) -> DataFrame:
    """Current and baseline of each metric side by side, by one aggregation instead of a self join.

    A pair whose sides disagree on type or unit is an error.
    """
    side = F.struct(
        "value", "sample_count", "state", "metric_id", "metric_type", "unit", "window_start", "window_end", "scope"
    )
    both = metrics.groupBy("profile_id", "window_id", "metric").agg(
        F.max(F.when(F.col("role") == "current", side)).alias("cur"),
        F.max(F.when(F.col("role") == "baseline", side)).alias("base"),
        F.max("computed_at").alias("computed_at"),
        F.max("mode").alias("mode"),
    ).filter("cur is not null and base is not null")
    mismatch = (F.col("cur.metric_type") != F.col("base.metric_type")) | (F.col("cur.unit") != F.col("base.unit"))
    guard = F.when(mismatch, F.raise_error(F.lit("comparison needs the same metric type and unit"))).otherwise(
        F.col("metric")
    )
    return both.withColumn("metric", guard)


def compared(pairs: DataFrame, min_sample: int = 1, stable: float = 0.05) -> DataFrame:
    """Changes, direction and quality of each pair."""
    cur, base = F.col("cur.value"), F.col("base.value")
    present = cur.isNotNull() & base.isNotNull()
    low = (F.col("cur.sample_count") < min_sample) | (F.col("base.sample_count") < min_sample)
    absolute = F.when(present, cur - base)
    relative = F.try_divide(absolute, F.when(base != 0, F.abs(base)))
    direction = (
        F.when(~present | low, "unknown")
        .when(relative.isNull() & (absolute > 0), "increase")
        .when(relative.isNull() & (absolute < 0), "decrease")
        .when(relative.isNull() | (F.abs(relative) < stable), "stable")
        .when(relative > 0, "increase")
        .otherwise("decrease")
    )
    worst = comparison_label(F.greatest(comparison_rank(F.col("cur.state")), comparison_rank(F.col("base.state"))))
    return pairs.select(
        "*",
        absolute.alias("absolute_change"),
        relative.alias("relative_change"),
        direction.alias("direction"),
        F.when(~present | low, "unknown").otherwise(worst).alias("state"),
        F.least("cur.sample_count", "base.sample_count").alias("sample_count"),
        low.alias("low_sample"),
        (present & relative.isNull()).alias("zero_baseline"),
    )


def baseline_comparisons(metrics: DataFrame, min_sample: int = 1, stable: float = 0.05) -> DataFrame:
    return compared(paired(metrics), min_sample, stable).select(
        "profile_id", "window_id", "metric", "computed_at",
        F.col("cur.value").alias("current_value"),
        F.col("base.value").alias("baseline_value"),
        "absolute_change", "relative_change", "direction", "state", "sample_count", "low_sample", "zero_baseline",
        F.col("cur.metric_id").alias("metric_id"),
        F.col("base.metric_id").alias("baseline_metric_id"),
    )


def detect_events(metrics: DataFrame, rules: DataFrame | None = None, min_sample: int = 3,
                  stable: float = 0.05) -> DataFrame:
    """Rules that fire; unknown comparisons never do.  Rules are an ordinary table."""
    if rules is None:
        rules = default_rules(metrics.sparkSession)
    changes = compared(paired(metrics.filter("mode = 'sea'")), min_sample, stable)
    size = F.abs(F.coalesce("absolute_change", F.lit(0.0)))
    share = F.abs("relative_change")  # no relative change (baseline zero) passes any relative threshold
    fired = (
        (F.col("state") != "unknown")
        & (F.col("direction") == F.col("rule_direction"))
        & (size >= F.col("absolute_threshold"))
        & (share.isNull() | (share >= F.col("relative_threshold")))
    )
    return (
        changes.join(rules, "metric")
        .filter(fired)
        .select(
            F.concat_ws("@", "event_type", "profile_id", F.unix_micros("cur.window_start").cast("string")).alias("event_id"),
            "event_type",
            F.col("profile_id").alias("scope"),
            "window_id",
            F.col("computed_at").alias("detected_at"),
            F.col("cur.window_start").alias("window_start"),
            F.col("cur.window_end").alias("window_end"),
            "metric",
            F.col("cur.metric_id").alias("metric_id"),
            F.col("base.metric_id").alias("baseline_metric_id"),
            F.col("cur.value").alias("current_value"),
            F.col("base.value").alias("baseline_value"),
            "absolute_change", "relative_change", "direction", "state",
            F.lit("event-detector-v1").alias("formula_version"),
        )
    )


def event_topk(events: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The strongest events per key by size of the relative change, ties by event id."""
    from fairlead.operators.ordering import bounded_topk

    ranked = events.withColumn("id", F.col("event_id")).withColumn(
        "priority", F.abs(F.coalesce("relative_change", F.lit(0.0)))
    )
    return bounded_topk(ranked, keys, n)
