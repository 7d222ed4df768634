"""Tables over all profiles: compare rows, coverage, totals, series, watches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlead.functions.timeline import MICROS, plus_micros
from fairlead.operators.facility import land_summary, readings_in_scope
from fairlead.operators.geo import profile_membership
from fairlead.operators.windows import assign_windows, prune_to_windows
from fairlead.schema import FREIGHT_TYPES, WATCH_METRICS


def coverage_states(profiles: DataFrame, fences: DataFrame) -> DataFrame:
    """Covered when all fences are, unknown when none is, else partial; with fence and limitation counts."""
    counts = fences.groupBy("profile_id").agg(
        F.count("*").alias("fence_count"), F.count_if(F.col("coverage_hint") == "covered").alias("covered_fences")
    )
    total, covered = F.coalesce("fence_count", F.lit(0)), F.coalesce("covered_fences", F.lit(0))
    return profiles.join(counts, "profile_id", "left").select(
        "profile_id", "name", "region", "mode",
        total.cast("bigint").alias("fence_count"),
        covered.cast("bigint").alias("covered_fences"),
        F.when(covered == total, "covered").when(covered == 0, "unknown").otherwise("partial").alias("coverage_state"),
        F.col("limitation_count").cast("bigint").alias("limitation_count"),
    )


def headline() -> Column:
    """The number a profile shows: freight vessels at sea, aircraft rows in the air, the commercial wait on land."""
    return (
        F.when(F.col("mode") == "sea", F.col("freight").cast("double"))
        .when(F.col("mode") == "air", F.nullif("in_fence_rows", F.lit(0).cast("bigint")).cast("double"))
        .when(F.col("mode") == "land", F.col("wait_minutes"))
    )


def compare_rows(
    wide: DataFrame, comparisons: DataFrame, events: DataFrame, coverage: DataFrame, waits: DataFrame | None = None,
) -> DataFrame:
    """One row per (profile, window): headline, events, coverage and anomaly priority.

    ``waits``: profile_id, window_id and wait_minutes of the land profiles, when ``wide`` was made without their readings.
    """
    per_event = events.groupBy(F.col("scope").alias("profile_id"), "window_id").agg(
        F.count("*").alias("event_count"), F.max(F.abs("relative_change")).alias("_event_change")
    )
    per_change = (
        comparisons.filter(F.col("metric").isin("vessel_count", "moving_fraction"))
        .groupBy("profile_id", "window_id").agg(F.max(F.abs("relative_change")).alias("_change"))
    )
    sea = F.col("mode") == "sea"
    current = wide.filter("role = 'current'")
    if waits is not None:
        current = current.drop("wait_minutes").join(waits, ["profile_id", "window_id"], "left")
    base = current.select("profile_id", "window_id", headline().alias("headline"))
    rows = (
        base.join(per_event, ["profile_id", "window_id"], "left")
        .join(per_change, ["profile_id", "window_id"], "left")
        .join(coverage, "profile_id")
    )
    zero = F.lit(0.0)
    # Land and air rows have no comparison of entity metrics.
    change = F.when(sea, F.coalesce("_change", zero)).otherwise(zero)
    return rows.select(
        "profile_id", "window_id", "name", "region", "mode", "headline",
        F.coalesce("event_count", F.lit(0)).cast("bigint").alias("event_count"),
        "coverage_state",
        F.greatest(zero, F.coalesce("_event_change", zero), change).alias("anomaly_priority"),
    )


def by_anomaly(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("anomaly_priority").desc(), F.col("profile_id").asc())


def network_totals(wide: DataFrame) -> DataFrame:
    """Sum of counts per window and mode; a missing count adds nothing, and without any the sum is unknown."""
    return wide.filter("role = 'current'").groupBy("window_id", "mode").agg(
        F.count("*").alias("profiles"),
        F.sum(F.when(F.col("mode") == "sea", F.col("freight"))).alias("vessels"),
        F.sum(F.when(F.col("mode") == "air", F.col("in_fence_rows"))).alias("aircraft_rows"),
        F.sum(F.when(F.col("mode") == "land", F.coalesce("readings", F.lit(0)))).alias("facility_readings"),
    )


def _freight_in_fence(members: DataFrame, keys: list[str], allowlist: list[str]) -> DataFrame:
    latest = F.max_by(F.struct("entity_type", "classification"), F.struct("observed_at", "observation_id"))
    per_entity = members.groupBy(*keys, "entity_id").agg(latest.alias("_l"))
    confirmed = F.col("_l.classification") == "confirmed"
    return per_entity.groupBy(*keys).agg(
        F.count_if(confirmed & F.col("_l.entity_type").isin(allowlist)).alias("vessels")
    )


def headline_series(
    obs: DataFrame, fences: DataFrame, profiles: DataFrame, bounds: DataFrame, buckets: int = 12,
    allowlist: list[str] = FREIGHT_TYPES, aircraft: DataFrame | None = None, readings: DataFrame | None = None,
    facility_prefix: str = "cbp:",
) -> DataFrame:
    """Headline in equal half-open buckets of every window, in one pass per mode; empty buckets stay.

    ``value``: freight vessels of a sea profile (0 in an empty bucket), aircraft rows of an
    air profile and the headline wait of a land profile (both unknown in an empty bucket).
    ``vessels`` is the count of the sea profiles.
    """
    us, start, end = F.unix_micros("observed_at"), F.unix_micros("start_at"), F.unix_micros("end_at")
    bucket = F.floor((us - start) * F.lit(buckets) / (end - start))
    keys = ["window_id", "profile_id", "bucket"]

    def fan(rows: DataFrame) -> DataFrame:
        return assign_windows(rows, bounds).filter(us < end).withColumn("bucket", bucket)

    of = lambda mode: profiles.filter(F.col("mode") == mode).select("profile_id")
    fences_of = lambda mode: fences.join(of(mode), "profile_id", "left_semi")
    sea = fan(profile_membership(prune_to_windows(obs, bounds), fences_of("sea")))
    values = _freight_in_fence(sea, keys, allowlist).select(*keys, F.col("vessels").cast("double").alias("found"))
    if aircraft is not None:
        air = fan(profile_membership(prune_to_windows(aircraft, bounds), fences_of("air")))
        values = values.unionByName(air.groupBy(*keys).agg(F.count("*").cast("double").alias("found")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("bucket")
    if readings is not None:
        scopes = bounds.select("window_id", every)
        own = readings.join(of("land"), "profile_id", "left_semi")
        newest, counts = readings_in_scope(
            own, scopes, ("window_id", "bucket"), lambda rows: prune_to_windows(rows, bounds), fan, facility_prefix
        )
        waits = land_summary(newest, counts, ("window_id", "bucket"))
        values = values.unionByName(waits.select(*keys, F.col("wait_minutes").alias("found")))
    # The asked grid: every window, profile and bucket has a row.
    grid = bounds.select("window_id").crossJoin(profiles.select("profile_id", "mode")).select("window_id", "profile_id", "mode", every)
    at_sea = F.col("mode") == "sea"
    return grid.join(values, keys, "left").select(
        "window_id", "profile_id", "mode", "bucket",
        F.when(at_sea, F.coalesce("found", F.lit(0.0))).otherwise(F.col("found")).alias("value"),
        F.when(at_sea, F.coalesce("found", F.lit(0.0)).cast("bigint")).alias("vessels"),
    )


def replay_counts(
    obs: DataFrame, fences: DataFrame, bounds: DataFrame, step_seconds: int, lookback_seconds: int,
    allowlist: list[str] = FREIGHT_TYPES,
) -> DataFrame:
    """Counts for every replay cursor of every window, all cursors in one job.

    Overlapping look-back windows share panes: rows are first reduced to the
    latest row per (profile, entity, pane), and only those are handed to the
    windows that cover the pane.  Instants that are pane borders get a pane of
    their own, because both window ends are inclusive.
    """
    if lookback_seconds % step_seconds:
        raise ValueError("the look-back must be a multiple of the step")
    step = step_seconds * MICROS
    reach = lookback_seconds // step_seconds
    us = F.unix_micros("observed_at")
    lookback = bounds.select(
        "window_id", plus_micros(F.col("start_at"), -lookback_seconds * MICROS).alias("start_at"), "end_at",
        F.unix_micros("start_at").alias("_s"), F.unix_micros("end_at").alias("_e"),
    )
    inside = assign_windows(profile_membership(prune_to_windows(obs, lookback), fences), lookback).withColumn("_off", us - F.col("_s"))
    whole = F.floor(F.col("_off") / F.lit(step))
    # Even panes are border instants, odd panes the open intervals between them.
    pane = 2 * whole + F.when(F.col("_off") % step == 0, 0).otherwise(1)
    latest = F.max(F.struct("observed_at", "observation_id", "entity_type", "classification"))
    panes = inside.withColumn("_pane", pane).groupBy("window_id", "profile_id", "_s", "_e", "entity_id", "_pane").agg(
        latest.alias("_l"), F.count("*").alias("_n")
    )
    # Regular cursors k cover panes 2(k - reach) .. 2k; the last cursor may be off the grid and is added below.
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("_pane") / 2))
    last = F.floor(F.col("_pane") / 2) + reach
    full = F.floor((F.col("_e") - F.col("_s")) / F.lit(step))
    regular = panes.withColumn("_last", F.least(last, full)).filter(first <= F.col("_last")).select(
        "*", F.explode(F.sequence(first, F.col("_last"))).alias("_k")
    ).select("window_id", "profile_id", "entity_id", "_l", "_n", (F.col("_s") + F.col("_k") * step).alias("cursor_us"))
    off_grid = (
        inside.filter(((F.col("_e") - F.col("_s")) % step != 0) & us.between(F.col("_e") - lookback_seconds * MICROS, F.col("_e")))
        .groupBy("window_id", "profile_id", "entity_id", "_e").agg(latest.alias("_l"), F.count("*").alias("_n"))
        .select("window_id", "profile_id", "entity_id", "_l", "_n", F.col("_e").alias("cursor_us"))
    )
    per_entity = regular.unionByName(off_grid).groupBy("window_id", "profile_id", "cursor_us", "entity_id").agg(
        F.max("_l").alias("_l"), F.sum("_n").alias("_n")
    )
    confirmed = F.col("_l.classification") == "confirmed"
    return per_entity.groupBy("window_id", "profile_id", "cursor_us").agg(
        F.sum("_n").alias("in_fence_rows"),
        F.count("*").alias("entities"),
        F.count_if(confirmed & F.col("_l.entity_type").isin(allowlist)).alias("vessels"),
    )


def watch_id() -> Column:
    return F.concat_ws(
        "|", "profile_id", "metric", "watch_direction", F.col("pct_threshold").cast("string"), "freshness_policy"
    )


def valid_watch() -> Column:
    """A watch row that may be stored; anything else is skipped."""
    return F.coalesce(
        (F.length("id") > 0)
        & F.col("profile_id").isNotNull()
        & F.col("metric").isin(WATCH_METRICS)
        & F.col("watch_direction").isin("increase", "decrease")
        & ~F.isnan("pct_threshold") & (F.col("pct_threshold") > 0) & (F.col("pct_threshold") < float("inf"))
        & F.col("freshness_policy").isin("require-fresh", "allow-stale")
        & F.col("created_at").isNotNull()
        & F.col("config_version").isNotNull(),
        F.lit(False),
    )


def upsert_watches(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Valid rows of both tables; of equal ids the last (by seq, incoming after existing) stays."""
    both = existing.withColumn("_gen", F.lit(0)).unionByName(incoming.withColumn("_gen", F.lit(1))).filter(valid_watch())
    last = Window.partitionBy("id").orderBy(F.col("_gen").desc(), F.col("seq").desc())
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_gen")


def remove_watches(watches: DataFrame, ids: DataFrame) -> DataFrame:
    return watches.join(ids.select("id"), "id", "left_anti")


def evaluate_watches(watches: DataFrame, metrics: DataFrame, comparisons: DataFrame) -> DataFrame:
    """fired / clear / unknown / unavailable for each watch and window.

    Only vessel_count and moving_fraction have comparisons; a zero baseline has no
    relative change and is unknown to a watch.
    """
    values = metrics.filter("role = 'current'").select("profile_id", "window_id", "metric", "mode", F.col("value").alias("observed_value"))
    changes = comparisons.filter(F.col("metric").isin("vessel_count", "moving_fraction")).select(
        "profile_id", "window_id", "metric", "relative_change", "direction", F.col("state").alias("comparison_state")
    )
    facts = values.join(changes, ["profile_id", "window_id", "metric"], "left").withColumn(
        "has_comparison", F.col("direction").isNotNull()
    )
    known = watches.join(facts, ["profile_id", "metric"], "left")
    pct = F.col("relative_change") * 100
    fresh_ok = (F.col("freshness_policy") == "allow-stale") | (F.col("comparison_state") == "fresh")
    unusable = (F.col("direction") == "unknown") | F.col("relative_change").isNull() | ~fresh_ok
    toward = F.when(F.col("watch_direction") == "increase", pct >= 0).otherwise(pct <= 0)
    status = (
        F.when(F.col("window_id").isNull(), "unavailable")
        .when(~F.col("has_comparison") & F.col("observed_value").isNull(), "unavailable")
        .when(~F.col("has_comparison") | unusable, "unknown")
        .when(toward & (F.abs(pct) >= F.col("pct_threshold")), "fired")
        .otherwise("clear")
    )
    return known.select(
        "id", "window_id", "profile_id", "metric", "observed_value",
        F.when(F.col("has_comparison"), F.when(unusable, F.col("relative_change")).otherwise(pct)).alias("relative_change_pct"),
        status.alias("status"),
    )
