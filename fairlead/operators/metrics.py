"""Window metrics: counts by classification, moving fraction, dwell, crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fairlead.functions.quality import metric_label, metric_rank
from fairlead.functions.timeline import iso_text
from fairlead.operators.geo import flag_inside, profile_membership, usable_fences
from fairlead.operators.windows import assign_windows, prune_to_windows
from fairlead.schema import FREIGHT_TYPES



def _latest(*fields: str) -> Column:
    return F.max_by(F.struct(*fields), F.struct("observed_at", "observation_id"))


def _state(unknown: Column, rank: Column) -> Column:
    """Worst state of the contributing rows; no contributing row counts as fresh."""
    return F.when(unknown, F.lit("unknown")).otherwise(metric_label(F.coalesce(rank, F.lit(0))))


def vessel_count(
    obs: DataFrame, fences: DataFrame, wins: DataFrame, allowlist: list[str] = FREIGHT_TYPES
) -> DataFrame:
    """Entities seen inside any of the fences, split by what their latest row in the window says.

    Inside counts from any row of the window, the type comes from the latest row.
    """
    flagged = flag_inside(prune_to_windows(obs, wins), fences).select(
        "entity_id", "observed_at", "observation_id", "inside", "entity_type", "classification", "source_state"
    )
    per_entity = (
        assign_windows(flagged, wins)
        .groupBy("window_id", "entity_id")
        .agg(
            F.bool_or("inside").alias("inside"),
            _latest("entity_type", "classification").alias("latest"),
            F.max(metric_rank(F.col("source_state"))).alias("rank"),
        )
        .filter("inside")
    )
    confirmed = F.col("latest.classification") == "confirmed"
    listed = F.col("latest.entity_type").isin(allowlist)
    counts = per_entity.groupBy("window_id").agg(
        F.count_if(confirmed & listed).alias("counted"),
        F.count_if(~confirmed).alias("unclassified"),
        F.count_if(confirmed & ~listed).alias("outside_allowlist"),
        F.max("rank").alias("rank"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        wins.select("window_id").join(counts, "window_id", "left")
        .select(
            "window_id",
            zero("counted").alias("counted"),
            zero("unclassified").alias("unclassified"),
            zero("outside_allowlist").alias("outside_allowlist"),
            _state(F.col("counted").isNull(), F.col("rank")).alias("state"),
        )
    )


def moving_fraction(
    rows: DataFrame, wins: DataFrame, keys: list[str], threshold_knots: float, allowed: DataFrame | None = None
) -> DataFrame:
    """Share of entities whose latest row in the window is faster than the threshold.

    An entity whose latest row has no speed is excluded and counted as missing,
    never as stopped.  ``allowed`` (entity_id) restricts the entities.
    """
    if threshold_knots < 0:
        raise ValueError("threshold_knots must not be negative")
    rows = prune_to_windows(rows, wins)
    scoped = rows if allowed is None else rows.join(allowed.select("entity_id").distinct(), "entity_id", "left_semi")
    per_entity = (
        assign_windows(scoped, wins)
        .groupBy(*keys, "window_id", "entity_id")
        .agg(
            _latest("speed_knots").alias("latest"),
            F.max(metric_rank(F.col("source_state"))).alias("rank"),
        )
    )
    speed = F.col("latest.speed_knots")
    summed = per_entity.groupBy(*keys, "window_id").agg(
        F.count_if(speed.isNotNull()).alias("eligible"),
        F.count_if(speed > threshold_knots).alias("moving"),
        F.count_if(speed.isNull()).alias("missing_speed"),
        F.max("rank").alias("rank"),
    )
    return summed.select(
        *keys, "window_id", "eligible", "moving", "missing_speed",
        F.try_divide(F.col("moving"), F.col("eligible")).alias("moving_fraction"),
        _state(F.col("eligible") == 0, F.col("rank")).alias("state"),
    )


def aircraft_count(obs: DataFrame, fences: DataFrame, wins: DataFrame) -> DataFrame:
    """Rows (not aircraft) inside the fences of each profile; none means unknown, not zero."""
    inside = profile_membership(prune_to_windows(obs, wins), fences).select("profile_id", "observed_at", "entity_type")
    counts = assign_windows(inside, wins).groupBy("profile_id", "window_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("entity_type") == "aircraft").alias("freight_rows"),
        F.count_if(F.col("entity_type") == "unknown").alias("unclassified_rows"),
    )
    grid = usable_fences(fences).select("profile_id").distinct().crossJoin(wins.select("window_id"))
    return grid.join(counts, ["profile_id", "window_id"], "left").select(
        "profile_id",
        "window_id",
        F.nullif(F.coalesce("n", F.lit(0)), F.lit(0)).alias("value"),
        F.coalesce("n", F.lit(0)).alias("sample_count"),
        F.coalesce("freight_rows", F.lit(0)).alias("freight_rows"),
        F.coalesce("unclassified_rows", F.lit(0)).alias("unclassified_rows"),
        F.when(F.col("n").isNull(), F.lit("unknown")).otherwise(F.lit("fresh")).alias("state"),
    )


def worst_states(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Worst source state per key on the metric scale and on the track scale."""
    from fairlead.functions.quality import track_label, track_rank

    return rows.groupBy(*keys).agg(
        metric_label(F.max(metric_rank(F.col("source_state")))).alias("metric_state"),
        track_label(F.max(track_rank(F.col("source_state")))).alias("track_state"),
        F.count("*").alias("rows"),
    )


def metric_id(name: Column, scope: Column, computed_at: Column) -> Column:
    return F.concat_ws("@", name, scope, iso_text(computed_at))


def long_metrics(wide: DataFrame) -> DataFrame:
    """Uniform metric rows: one per (profile, window, role, metric)."""
    geofence = F.concat(F.lit("geofence:"), F.col("fence_label"))
    primary = F.concat(F.lit("geofence:"), F.col("primary_label"))
    scope = F.col("profile_id")
    own = F.when(F.col("role") == "baseline", F.lit("membership-predicate")).otherwise(scope)
    none = F.lit(None).cast("double")
    no_data = F.col("mode") != "sea"
    # An air profile whose aircraft were read has a count of rows; none at all stays unknown.
    flown = (F.col("mode") == "air") & F.col("in_fence_rows").isNotNull()

    dwell_note = F.format_string(
        "first-to-last in-scope observation; at least %d observations; gap at most %ds; an estimate",
        F.col("min_observations"), F.col("max_gap_seconds"),
    )
    crossing_note = F.format_string(
        "crossings between consecutive observations; %d uncertain excluded (gap above %ds)",
        F.col("uncertain"), F.col("max_gap_seconds"),
    )

    def row(name, kind, value, unit, sample, state, where, version, note):
        counted = flown if name == "vessel_count" else F.lit(False)
        return F.struct(
            F.lit(name).alias("metric"),
            F.when(no_data, F.lit(name)).otherwise(F.lit(kind)).alias("metric_type"),
            F.when(no_data, F.concat_ws(".", scope, F.lit(name)))
            .otherwise(metric_id(F.lit(name), where, F.col("computed_at"))).alias("metric_id"),
            F.when(no_data, scope).otherwise(where).alias("scope"),
            F.when(counted, F.nullif("in_fence_rows", F.lit(0).cast("bigint")).cast("double")).when(no_data, none)
            .otherwise(value.cast("double")).alias("value"),
            F.when(no_data & (F.lit(name) != "moving_fraction"), F.lit("count")).otherwise(F.lit(unit)).alias("unit"),
            F.when(counted, F.col("in_fence_rows")).when(no_data, F.lit(0).cast("bigint")).otherwise(sample.cast("bigint"))
            .alias("sample_count"),
            F.when(no_data & ~counted, F.lit("unknown")).otherwise(F.col(state)).alias("state"),
            F.when(counted, F.lit("aircraft-count-v1-adsb")).when(no_data, F.lit("not-applicable-no-data"))
            .otherwise(F.lit(version)).alias("formula_version"),
            F.when(counted, F.lit("aircraft rows in the reviewed fence")).when(no_data, F.lit("entity metrics do not apply"))
            .otherwise(note).alias("coverage_note"),
        )

    count_note = F.format_string(
        "observed in %s; %d unclassified and %d outside the allowlist not counted",
        F.col("fence_label"), F.col("unclassified"), F.col("other"),
    )
    moving_note = F.format_string(
        "%d eligible; %d excluded without a speed", F.col("eligible"), F.col("missing_speed")
    )
    rows = F.array(
        row("vessel_count", "vessel_count", F.col("freight"), "entities", F.col("freight"), "count_state",
            geofence, "vessel-count-v1", count_note),
        row("moving_fraction", "moving_fraction", F.col("moving_fraction"), "fraction", F.col("eligible"),
            "moving_state", scope, "moving-fraction-v1", moving_note),
        row("dwell_cohort_size", "dwell_estimate", F.col("dwell_cohort"), "entities", F.col("dwell_cohort"),
            "dwell_state", own, "dwell-estimate-v1", dwell_note),
        row("dwell_median_seconds", "dwell_estimate", F.col("median_dwell_seconds"), "seconds", F.col("dwell_cohort"),
            "dwell_state", own, "dwell-estimate-v1", dwell_note),
        row("entry_count", "entry_count", F.col("entries"), "crossings", F.col("entries"), "entry_state",
            primary, "entry-exit-v1", crossing_note),
        row("exit_count", "exit_count", F.col("exits"), "crossings", F.col("exits"), "exit_state",
            primary, "entry-exit-v1", crossing_note),
    )
    base = ["profile_id", "mode", "window_id", "role", "window_start", "window_end", "computed_at"]
    return wide.select(*base, F.inline(rows))
