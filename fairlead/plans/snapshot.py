"""The snapshot job: every profile, every window and its baseline in one pass.

rows in fences -> neighbours and segments per entity -> visits per window
-> entities per window (written once) -> metrics -> comparisons -> events.

The wide sort happens once, before rows fan out to overlapping windows; all
later steps are aggregations that combine map-side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from fairlead.functions.median import exact_median
from fairlead.functions.quality import metric_label, metric_rank
from fairlead.functions.timeline import MICROS
from fairlead.operators.compare import baseline_comparisons, detect_events
from fairlead.operators.health import provenance
from fairlead.operators.geo import (
    CELL_DEGREES, _join_cells, _profile_cells, _reach, primary_fences, profile_membership, usable_fences,
)
from fairlead.operators.facility import headline_waits, land_summary, readings_in_scope
from fairlead.operators.metrics import aircraft_count, long_metrics
from fairlead.operators.sequence import CHUNK_SECONDS, longest_first, of_segments, segment_rows, with_previous
from fairlead.operators.windows import assign_windows, prune_to_windows, with_baseline
from fairlead.schema import FREIGHT_TYPES
from fairlead.session import stage

_KEYS = ["profile_id", "window_id", "role"]


@dataclass(frozen=True)
class SnapshotSettings:
    """Defaults are the fixed snapshot parameters."""

    speed_threshold_knots: float = 0.5
    min_observations: int = 2
    max_gap_seconds: int = 3600
    allowlist: tuple[str, ...] = tuple(FREIGHT_TYPES)
    crossing_input: str = "in_fence"  # or "all": count arrivals from open water too
    chunk_seconds: int = CHUNK_SECONDS


def rows_in_fences(obs: DataFrame, fences: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    return profile_membership(obs, fences).select(
        *carry,
        "profile_id", "entity_id", "observed_at", "observation_id",
        F.col("inside_primary").alias("inside"),
        "speed_knots", "entity_type", "classification",
        metric_rank(F.col("source_state")).alias("rank"),
    )


def entity_windows(rows: DataFrame, wins: DataFrame, settings: SnapshotSettings) -> DataFrame:
    """One row per (profile, window, role, entity) with everything the metrics need."""
    us = F.col("_us")
    gap_limit = settings.max_gap_seconds * MICROS
    entity = ["profile_id", "entity_id"]
    # The bucket of a row as a number: what is kept of the latest row has a fixed width, so every aggregate hashes.
    bucket = F.when(F.col("classification").isNull() | (F.col("classification") != "confirmed"), 0).when(
        F.col("entity_type").isin(list(settings.allowlist)), 1
    ).otherwise(2)
    slim = rows.select(*entity, "observed_at", "observation_id", "inside", "rank", "speed_knots", bucket.alias("bucket"))
    linked, borders = segment_rows(
        slim, entity, ["observed_at", "inside", "rank"], settings.max_gap_seconds, settings.chunk_seconds
    )
    in_win = F.col("prev.observed_at") >= F.col("window_start")
    gap = us - F.col("prev._us")
    flips = in_win & (F.col("prev.inside") != F.col("inside"))
    counted = flips & (gap <= gap_limit)
    fanned = assign_windows(linked, with_baseline(wins), "window_start", "window_end")
    latest = [F.max_by("bucket", "_pos").alias("bucket"), F.max_by("speed_knots", "_pos").alias("speed_knots"), F.max("_pos").alias("_pos")]
    pieces = fanned.groupBy(*_KEYS, "entity_id", "_chunk", "_own_start").agg(
        F.count("*").alias("n"),
        F.min(us).alias("first_us"),
        F.max(us).alias("last_us"),
        F.max("rank").alias("rank"),
        *latest,
        F.count_if(counted & F.col("inside")).alias("entries"),
        F.count_if(counted & ~F.col("inside")).alias("exits"),
        F.count_if(flips & (gap > gap_limit)).alias("uncertain"),
        F.max(F.when(counted, F.greatest("rank", "prev.rank"))).alias("crossing_rank"),
    )
    crossed = [
        F.sum("entries").alias("entries"), F.sum("exits").alias("exits"), F.sum("uncertain").alias("uncertain"),
        F.max("crossing_rank").alias("crossing_rank"),
    ]
    per_visit = of_segments(pieces, borders, entity).groupBy(*_KEYS, "entity_id", "segment_start_us").agg(
        F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.max("rank").alias("rank"),
        *latest, *crossed,
    ).withColumn("_order", longest_first(F.col("n"), F.col("segment_start_us")))
    per_entity = per_visit.groupBy(*_KEYS, "entity_id").agg(
        F.sum("n").alias("row_count"), F.max("rank").alias("rank"), *latest[:2], *crossed,
        F.max("n").alias("visit_n"), F.max_by(F.col("last_us") - F.col("first_us"), F.col("_order")).alias("visit_us"),
        F.max_by("rank", "_order").alias("visit_rank"),
    )
    dwells = F.col("visit_n") >= settings.min_observations
    return per_entity.select(
        *_KEYS, "entity_id", "row_count", "rank",
        F.when(F.col("bucket") == 0, "unclassified").when(F.col("bucket") == 1, "freight").otherwise("other").alias("bucket"),
        "speed_knots",
        F.when(dwells, F.col("visit_us")).alias("dwell_us"),
        F.when(dwells, F.col("visit_rank")).alias("dwell_rank"),
        "entries", "exits", "uncertain", "crossing_rank",
    )


def crossings_from_all_rows(obs: DataFrame, fences: DataFrame, wins: DataFrame, settings: SnapshotSettings) -> DataFrame:
    """Crossings of each profile's primary fence counted over every observation.

    A row carries the profiles whose primary fence it lies in; only the profiles
    that differ from the predecessor's are unfolded, so nothing is multiplied.
    """
    from fairlead.functions.polygon import inside_ring

    reviewed = usable_fences(fences)
    primary = reviewed.join(primary_fences(reviewed).select("profile_id", "fence_id"), ["profile_id", "fence_id"], "left_semi")
    cells = _profile_cells(primary, CELL_DEGREES, ["profile_id"]).groupBy("_cy", "_cx").agg(
        F.collect_list(F.struct("profile_id", F.col("_fences")[0]["edges"].alias("edges"))).alias("_p")
    )
    lat, lon = F.col("latitude"), F.col("longitude")
    hit = F.filter(F.coalesce("_p", F.array()), lambda p: inside_ring(lat, lon, p["edges"]))
    located = _join_cells(
        obs.select("entity_id", "observed_at", "observation_id", "latitude", "longitude",
                   metric_rank(F.col("source_state")).alias("rank")),
        cells, _reach(primary, CELL_DEGREES), CELL_DEGREES, "left", 32,
    ).withColumn("inside", F.transform(hit, lambda p: p["profile_id"]))
    moved = with_previous(
        located.select("entity_id", "observed_at", "observation_id", "rank", "inside"),
        ["entity_id"], ["observed_at", "rank", "inside"], settings.chunk_seconds,
    ).filter("prev is not null")
    changes = F.concat(
        F.transform(F.array_except("inside", "prev.inside"),
                    lambda p: F.struct(p.alias("profile_id"), F.lit(True).alias("entered"))),
        F.transform(F.array_except("prev.inside", "inside"),
                    lambda p: F.struct(p.alias("profile_id"), F.lit(False).alias("entered"))),
    )
    crossed = moved.select("*", F.inline(changes))
    gap = F.unix_micros("observed_at") - F.unix_micros("prev.observed_at")
    near = gap <= settings.max_gap_seconds * MICROS
    fanned = assign_windows(crossed, with_baseline(wins), "window_start", "window_end").filter(
        F.col("prev.observed_at") >= F.col("window_start")
    )
    return fanned.groupBy(*_KEYS, "entity_id").agg(
        F.count_if(near & F.col("entered")).alias("entries"),
        F.count_if(near & ~F.col("entered")).alias("exits"),
        F.count_if(~near).alias("uncertain"),
        F.max(F.when(near, F.greatest("rank", "prev.rank"))).alias("crossing_rank"),
    )


def fence_labels(fences: DataFrame) -> DataFrame:
    """Scope labels per profile: all fences in registry order, and the primary one."""
    label = F.concat_ws("@", "fence_id", "geometry_version")
    reviewed = usable_fences(fences)
    every = reviewed.groupBy("profile_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", label.alias("label")))), lambda s: s["label"]),
            "+",
        ).alias("fence_label")
    )
    first = primary_fences(reviewed).select("profile_id", label.alias("primary_label"))
    return every.join(first, "profile_id")


_AIR = ["air_rows", "air_freight", "air_unclassified"]
_LAND = ["facilities", "readings", "wait_minutes"]


def air_rows(aircraft: DataFrame, profiles: DataFrame, fences: DataFrame, wins: DataFrame) -> DataFrame:
    """Aircraft rows in the fences of each air profile and window."""
    own = fences.join(profiles.filter("mode = 'air'").select("profile_id"), "profile_id", "left_semi")
    return aircraft_count(aircraft, own, wins).select(
        "profile_id", "window_id", F.col("sample_count").alias("air_rows"), F.col("freight_rows").alias("air_freight"),
        F.col("unclassified_rows").alias("air_unclassified"),
    )


def land_readings(readings: DataFrame, profiles: DataFrame, wins: DataFrame, id_prefix: str) -> tuple[DataFrame, DataFrame]:
    """Newest reading of each facility of the land profiles as of each window, and their summary."""
    own = readings.join(profiles.filter("mode = 'land'").select("profile_id"), "profile_id", "left_semi")
    newest, counts = readings_in_scope(
        own, wins, ("window_id",), lambda rows: prune_to_windows(rows, wins), lambda rows: assign_windows(rows, wins), id_prefix
    )
    newest = stage(newest, "facility-windows")
    return newest, land_summary(newest, counts, ("window_id",))


def land_waits(readings: DataFrame, profiles: DataFrame, wins: DataFrame, id_prefix: str) -> DataFrame:
    """The headline wait of each land profile and window that has readings."""
    own = readings.join(profiles.filter("mode = 'land'").select("profile_id"), "profile_id", "left_semi")
    return headline_waits(
        own, wins, ("window_id",), lambda rows: prune_to_windows(rows, wins), lambda rows: assign_windows(rows, wins), id_prefix
    )


def wide_metrics(
    entities: DataFrame, profiles: DataFrame, fences: DataFrame, wins: DataFrame, settings: SnapshotSettings,
    air: DataFrame | None = None, land: DataFrame | None = None,
) -> DataFrame:
    """One row per (profile, window, role), profiles and windows without data included.

    ``air`` and ``land`` are the current windows of the other modes; their preceding window
    is not compared, so its row stays unknown.
    """
    freight = F.col("bucket") == "freight"
    speed = F.col("speed_knots")
    moves = speed > settings.speed_threshold_knots
    some = F.col("freight") > 0

    summed = entities.groupBy(*_KEYS).agg(
        F.sum("row_count").alias("in_fence_rows"),
        F.count_if(freight).alias("freight"),
        F.count_if(F.col("bucket") == "unclassified").alias("unclassified"),
        F.count_if(F.col("bucket") == "other").alias("other"),
        F.max("rank").alias("rank_all"),
        F.max(F.when(freight, F.col("rank"))).alias("rank_freight"),
        *[
            agg.alias(f"{name}_{suffix}")
            for suffix, member in (("all", F.lit(True)), ("freight", freight))
            for name, agg in (
                ("eligible", F.count_if(member & speed.isNotNull())),
                ("moving", F.count_if(member & moves)),
                ("missing", F.count_if(member & speed.isNull() & (F.col("row_count") > 0))),
                ("entries", F.sum(F.when(member, F.col("entries")).otherwise(0))),
                ("exits", F.sum(F.when(member, F.col("exits")).otherwise(0))),
                ("uncertain", F.sum(F.when(member, F.col("uncertain")).otherwise(0))),
                ("crossing_rank", F.max(F.when(member, F.col("crossing_rank")))),
            )
        ],
        F.count("dwell_us").alias("dwell_cohort"),
        F.max("dwell_rank").alias("dwell_rank"),
    )
    median = exact_median(entities.filter("dwell_us is not null"), _KEYS, "dwell_us", MICROS, "median_us")

    grid = profiles.select("profile_id", "mode").crossJoin(with_baseline(wins))
    joined = (
        grid.join(fence_labels(fences), "profile_id", "left")
        .join(summed, _KEYS, "left")
        .join(median, _KEYS, "left")
    )
    for part, names in ((air, _AIR), (land, _LAND)):
        if part is None:
            joined = joined.select("*", *[F.lit(None).cast("double" if n == "wait_minutes" else "bigint").alias(n) for n in names])
        else:
            joined = joined.join(part.withColumn("role", F.lit("current")), _KEYS, "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint")
    # The freight cohort restricts moving and crossings only when it has members.
    pick = lambda name: F.when(some, F.col(f"{name}_freight")).otherwise(F.col(f"{name}_all"))
    chosen = joined.select(
        "*",
        *[F.coalesce(pick(n), F.lit(0)).cast("bigint").alias(n) for n in ("eligible", "moving", "entries", "exits", "uncertain")],
        F.coalesce(pick("missing"), F.lit(0)).cast("bigint").alias("missing_speed"),
        pick("rank").alias("moving_rank"),
        pick("crossing_rank").alias("crossing_rank"),
    )
    state = lambda unknown, rank: F.when(unknown, F.lit("unknown")).otherwise(
        metric_label(F.coalesce(rank, F.lit(0)))
    )
    quiet = (F.col("entries") == 0) & (F.col("exits") == 0) & (F.col("uncertain") == 0)
    wide = chosen.select(
        "profile_id", "mode", "window_id", "role", "window_start", "window_end", "computed_at",
        "fence_label", "primary_label",
        zero("in_fence_rows").alias("in_fence_rows"),
        zero("freight").alias("freight"),
        zero("unclassified").alias("unclassified"),
        zero("other").alias("other"),
        "eligible", "moving", "missing_speed",
        F.try_divide(F.col("moving"), F.col("eligible")).alias("moving_fraction"),
        zero("dwell_cohort").alias("dwell_cohort"),
        (F.col("median_us") / F.lit(float(MICROS))).alias("median_dwell_seconds"),
        "entries", "exits", "uncertain",
        state(F.col("in_fence_rows").isNull(), F.col("rank_all")).alias("count_state"),
        state(F.col("eligible") == 0, F.col("moving_rank")).alias("moving_state"),
        state(F.coalesce(F.col("dwell_cohort"), F.lit(0)) == 0, F.col("dwell_rank")).alias("dwell_state"),
        # One direction alone is unknown only when nothing at all was counted.
        state(quiet, F.col("crossing_rank")).alias("entry_state"),
        state(quiet, F.col("crossing_rank")).alias("exit_state"),
        F.lit(settings.min_observations).alias("min_observations"),
        F.lit(settings.max_gap_seconds).alias("max_gap_seconds"),
        *_AIR, *_LAND,
    )
    # Vessel metrics of other modes are unknown, not zero; aircraft are rows, not entities.
    sea, flown = F.col("mode") == "sea", F.col("air_rows")
    counts = ["in_fence_rows", "freight", "unclassified", "other", "eligible", "moving", "missing_speed", "dwell_cohort", "entries", "exits", "uncertain"]
    states = ["count_state", "moving_state", "dwell_state", "entry_state", "exit_state"]
    of_air = {
        "in_fence_rows": flown, "freight": F.col("air_freight"), "unclassified": F.col("air_unclassified"),
        "other": F.when(flown.isNotNull(), F.lit(0).cast("bigint")),
    }
    return wide.withColumns({
        **{c: F.when(sea, F.col(c)).otherwise(of_air.get(c, F.lit(None))) for c in counts},
        **{c: F.when(sea, F.col(c)).otherwise("unknown") for c in states},
        "count_state": F.when(sea, F.col("count_state")).when(flown > 0, "fresh").otherwise("unknown"),
    }).drop(*_AIR)


@dataclass(frozen=True)
class Snapshot:
    """All parts of a snapshot run, keyed by (profile, window)."""

    entities: DataFrame
    wide: DataFrame
    metrics: DataFrame
    comparisons: DataFrame
    events: DataFrame
    facilities: DataFrame | None = None  # newest reading per facility of the land profiles


def snapshot(
    obs: DataFrame,
    profiles: DataFrame,
    fences: DataFrame,
    wins: DataFrame,
    settings: SnapshotSettings = SnapshotSettings(),
    rules: DataFrame | None = None,
    aircraft: DataFrame | None = None,
    readings: DataFrame | None = None,
    facility_prefix: str = "cbp:",
) -> Snapshot:
    """Run the snapshot for all profiles and windows.

    ``obs`` serve the sea profiles, ``aircraft`` (observations) the air profiles and
    ``readings`` (facility readings with profile_id and is_live) the land profiles; a mode
    whose table is absent has unknown metrics.
    """
    sea = fences.join(profiles.filter("mode = 'sea'").select("profile_id"), "profile_id", "left_semi")
    obs = prune_to_windows(obs, with_baseline(wins), "window_start", "window_end")
    entities = entity_windows(rows_in_fences(obs, sea), wins, settings)
    if settings.crossing_input == "all":
        wide_crossings = crossings_from_all_rows(obs, sea, wins, settings)
        entities = entities.drop("entries", "exits", "uncertain", "crossing_rank").join(
            wide_crossings, [*_KEYS, "entity_id"], "left"
        )
    entities = stage(entities, "entity-windows")
    # Profiles x windows rows: small, and read by every later part.
    air = None if aircraft is None else air_rows(aircraft, profiles, fences, wins)
    facilities, land = (None, None) if readings is None else land_readings(readings, profiles, wins, facility_prefix)
    wide = stage(wide_metrics(entities, profiles, fences, wins, settings, air, land), "wide-metrics")
    metrics = long_metrics(wide)
    return Snapshot(
        entities=entities,
        wide=wide,
        metrics=metrics,
        comparisons=baseline_comparisons(metrics),
        events=detect_events(metrics, rules),
        facilities=facilities,
    )


def metric_inputs(rows: DataFrame, entities: DataFrame, wins: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Lineage of vessel_count and moving_fraction as rows: which observation fed which metric.

    ``carry``: further columns of the rows to hand on, so that nothing has to be looked up again.
    """
    some = entities.groupBy(*_KEYS).agg((F.count_if(F.col("bucket") == "freight") > 0).alias("_some"))
    member = entities.select(*_KEYS, "entity_id", "bucket").join(some, _KEYS)
    member = member.select(
        *_KEYS, "entity_id",
        F.explode(
            F.when(~F.col("_some") | (F.col("bucket") == "freight"), F.array(F.lit("vessel_count"), F.lit("moving_fraction")))
            .otherwise(F.array(F.lit("vessel_count")))
        ).alias("metric"),
    )
    fanned = assign_windows(
        rows.select("profile_id", "entity_id", "observed_at", "observation_id", *carry),
        with_baseline(wins), "window_start", "window_end",
    )
    return fanned.join(member, [*_KEYS, "entity_id"]).select(*_KEYS, "metric", "observation_id", "observed_at", *carry)


def metric_provenance(obs: DataFrame, fences: DataFrame, wins: DataFrame, settings: SnapshotSettings = SnapshotSettings()) -> DataFrame:
    """Provenance of the inputs of each metric: one record per provider and endpoint, conflicts apart.

    The source columns travel with the rows, so the lineage is grouped as it is made.
    """
    carry = ("provider_id", "endpoint_id", "license_id", "received_at")
    rows = rows_in_fences(prune_to_windows(obs, with_baseline(wins), "window_start", "window_end"), fences, carry)
    entities = stage(entity_windows(rows, wins, settings), "entity-windows")
    return provenance(metric_inputs(rows, entities, wins, carry), [*_KEYS, "metric"])
