"""Spatial operators: fence checks, membership by grid-cell join, extents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlead.functions.once import evaluate_once
from fairlead.functions.polygon import inside_ring, ring_edges, ring_max, ring_min
from fairlead.session import stage

CELL_DEGREES = 0.1
# Fence cells up to this size are broadcast; the scan filter has at most so many boxes.
BROADCAST_BYTES, FILTER_BOXES = 32 << 20, 32
KM_PER_DEGREE = 111.32


def fence_violation() -> Column:
    """First reason why a fence row may not be used; null for a usable fence."""
    bad_lat = F.exists("ring", lambda v: v["lat"].isNull() | F.isnan(v["lat"]) | ~v["lat"].between(-90, 90))
    bad_lon = F.exists("ring", lambda v: v["lon"].isNull() | F.isnan(v["lon"]) | ~v["lon"].between(-180, 180))
    blank = lambda name: F.coalesce(F.length(F.trim(name)), F.lit(0)) == 0
    empty = lambda name: F.coalesce(F.length(name), F.lit(0)) == 0
    return (
        F.when(F.col("geometry_status").isNull() | (F.col("geometry_status") != "reviewed"), F.lit("geometry_status.not_reviewed"))
        .when(blank("review_owner"), F.lit("review_owner.blank"))
        .when(F.col("effective_date").try_cast("timestamp").isNull(), F.lit("effective_date.not_date"))
        .when(empty("inclusion_rule") | empty("rationale"), F.lit("rationale.incomplete"))
        .when(F.coalesce(F.size("ring"), F.lit(0)) < 4, F.lit("ring.too_short"))
        .when(bad_lat, F.lit("ring.latitude_range"))
        .when(bad_lon, F.lit("ring.longitude_range"))
    )


def fence_validation(fences: DataFrame) -> DataFrame:
    return fences.withColumn("violation", fence_violation()).withColumn("usable", F.col("violation").isNull())


def usable_fences(fences: DataFrame) -> DataFrame:
    return fences.filter(fence_violation().isNull())


def fence_bboxes(fences: DataFrame, padding: float = 0.05) -> DataFrame:
    """One padded bounding box per fence, for source-side filters."""
    pad = abs(padding)
    return fences.select(
        "profile_id",
        "fence_id",
        (ring_min(F.col("ring"), "lat") - pad).alias("min_lat"),
        (ring_min(F.col("ring"), "lon") - pad).alias("min_lon"),
        (ring_max(F.col("ring"), "lat") + pad).alias("max_lat"),
        (ring_max(F.col("ring"), "lon") + pad).alias("max_lon"),
    )


def bbox_filter(boxes: list[tuple[float, float, float, float]]) -> Column:
    """Filter on latitude/longitude that parquet can push down, one OR term per box."""
    if not boxes:
        raise ValueError("a bounding-box filter needs at least one fence")
    combined = None
    for min_lat, min_lon, max_lat, max_lon in boxes:
        term = F.col("latitude").between(min_lat, max_lat) & F.col("longitude").between(min_lon, max_lon)
        combined = term if combined is None else combined | term
    return combined


def _cell(value: Column, cell: float) -> Column:
    return F.floor(value / F.lit(cell))


def _fence_cells(fences: DataFrame, cell: float, pad: float = 0.0) -> DataFrame:
    """Every grid cell a fence's bounding box touches, with the fence attached."""
    low = lambda axis: _cell(ring_min(F.col("ring"), axis) - pad, cell)
    high = lambda axis: _cell(ring_max(F.col("ring"), axis) + pad, cell)
    return (
        fences.select(
            "profile_id", "position", "fence_id", "geometry_version", "purpose",
            ring_edges(F.col("ring")).alias("edges"),
            (ring_min(F.col("ring"), "lat") - pad).alias("min_lat"),
            (ring_max(F.col("ring"), "lat") + pad).alias("max_lat"),
            (ring_min(F.col("ring"), "lon") - pad).alias("min_lon"),
            (ring_max(F.col("ring"), "lon") + pad).alias("max_lon"),
            F.explode(F.sequence(low("lat"), high("lat"))).alias("_cy"),
            low("lon").alias("_x0"), high("lon").alias("_x1"),
        )
        .withColumn("_cx", F.explode(F.sequence("_x0", "_x1")))
        .drop("_x0", "_x1")
    )


@dataclass(frozen=True)
class Reach:
    """What a fence table covers: whether its cells are small enough to broadcast, and boxes around all fences."""

    broadcast: bool
    boxes: list[tuple[float, float, float, float]]


def _reach(fences: DataFrame, cell: float, pad: float = 0.0) -> Reach:
    """Measured on the fence table; at most one row per ten-degree tile of the globe is collected.

    The size counts every cell with the edges of its fence, about 40 bytes each.
    """
    low = lambda axis: ring_min(F.col("ring"), axis) - pad
    high = lambda axis: ring_max(F.col("ring"), axis) + pad
    cells = lambda axis: F.floor(high(axis) / cell) - F.floor(low(axis) / cell) + 1
    tiles = (
        fences.select(
            F.floor(low("lat") / 10).alias("_ty"), F.floor(low("lon") / 10).alias("_tx"), low("lat").alias("a"), low("lon").alias("b"),
            high("lat").alias("c"), high("lon").alias("d"), (cells("lat") * cells("lon") * (F.size("ring") * 40 + 100)).alias("size"),
        )
        .groupBy("_ty", "_tx").agg(F.min("a"), F.min("b"), F.max("c"), F.max("d"), F.sum("size")).collect()
    )
    boxes = [tuple(t)[2:6] for t in tiles]
    if len(boxes) > FILTER_BOXES:
        boxes = [(min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))]
    return Reach(sum(t[6] for t in tiles) <= BROADCAST_BYTES, boxes)


def _join_cells(obs: DataFrame, cells: DataFrame, reach: Reach, cell: float, how: str, salts: int) -> DataFrame:
    """Equi-join observations to fence cells.

    An inner join reads only positions near some fence: the boxes reach the scan.  Cells
    measured to be small are broadcast; otherwise: shuffle join on the cell with both
    sides salted, so that a port holding a third of all positions is spread over
    ``salts`` tasks.
    """
    near = obs.filter(bbox_filter(reach.boxes)) if how == "inner" and reach.boxes else obs
    located = near.withColumn("_cy", _cell(F.col("latitude"), cell)).withColumn("_cx", _cell(F.col("longitude"), cell))
    if reach.broadcast:
        return located.join(F.broadcast(cells), ["_cy", "_cx"], how).drop("_cy", "_cx")
    located = located.withColumn("_salt", F.pmod(F.xxhash64("observation_id"), F.lit(salts)))
    copies = cells.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    return located.join(copies.hint("shuffle_hash"), ["_cy", "_cx", "_salt"], how).drop("_cy", "_cx", "_salt")


def _in_box() -> Column:
    return F.col("latitude").between(F.col("min_lat"), F.col("max_lat")) & F.col("longitude").between(
        F.col("min_lon"), F.col("max_lon")
    )


def fence_membership(obs: DataFrame, fences: DataFrame, cell: float = CELL_DEGREES, salts: int = 32) -> DataFrame:
    """One row per (observation, fence) the position lies in."""
    reviewed = usable_fences(fences)
    joined = _join_cells(obs, _fence_cells(reviewed, cell), _reach(reviewed, cell), cell, "inner", salts)
    inside = inside_ring(F.col("latitude"), F.col("longitude"), F.col("edges"))
    return joined.filter(_in_box() & inside).drop("edges", "min_lat", "max_lat", "min_lon", "max_lon")


def fence_totals(obs: DataFrame, fences: DataFrame, cell: float = CELL_DEGREES, salts: int = 32) -> DataFrame:
    """Rows, entities and newest instant inside each fence that holds any.

    Positions meet every outline once: fences drawn alike, however many, have the same rows
    in them and look the totals up.  The outline of a fence id are all rings given under it.
    """
    reviewed = usable_fences(fences)
    outlines = reviewed.groupBy("fence_id").agg(F.array_sort(F.collect_list("ring")).alias("_outline"))
    alike = outlines.join(outlines.groupBy("_outline").agg(F.min("fence_id").alias("_first")), "_outline").select("fence_id", "_first")
    drawn = reviewed.join(alike.select(F.col("_first").alias("fence_id")).distinct(), "fence_id", "left_semi")
    totals = fence_membership(obs, stage(drawn, "outlines"), cell, salts).groupBy(F.col("fence_id").alias("_first")).agg(
        F.count("*").alias("rows"), F.count_distinct("entity_id").alias("entities"), F.max("observed_at").alias("newest")
    )
    return alike.join(totals, "_first").drop("_first")


def bbox_candidates(obs: DataFrame, fences: DataFrame, padding: float = 0.05, cell: float = CELL_DEGREES,
                    salts: int = 32) -> DataFrame:
    """Number of positions inside each fence's padded bounding box; fences without any count zero."""
    reviewed = usable_fences(fences)
    reach = _reach(reviewed, cell, padding)
    joined = _join_cells(obs, _fence_cells(reviewed, cell, padding), reach, cell, "inner", salts)
    counts = joined.filter(_in_box()).groupBy("fence_id").agg(F.count("*").alias("candidates"))
    return (
        reviewed.select("fence_id")
        .join(counts, "fence_id", "left")
        .select("fence_id", F.coalesce("candidates", F.lit(0)).alias("candidates"))
    )


def primary_fences(fences: DataFrame, rule: str = "metrics") -> DataFrame:
    """The fence a profile is measured or framed by.

    ``metrics``: approach-flow first.  ``framing``: waiting-cohort, then
    approach-flow.  Otherwise the first registered fence.
    """
    wanted = {"metrics": ["approach-flow"], "framing": ["waiting-cohort", "approach-flow"]}[rule]
    rank = F.lit(len(wanted))
    for position, purpose in reversed(list(enumerate(wanted))):
        rank = F.when(F.col("purpose") == purpose, F.lit(position)).otherwise(rank)
    first = Window.partitionBy("profile_id").orderBy(rank, "position")
    return (
        fences.withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .select("profile_id", "fence_id", "geometry_version", "purpose")
    )


def _profile_cells(fences: DataFrame, cell: float, keys: list[str]) -> DataFrame:
    """Cells keyed by profile with all fences of that profile that touch the cell.

    One row per (profile, cell), so a position meets each profile once and the
    semi join needs no de-duplication afterwards.
    """
    reviewed = usable_fences(fences)
    # A fence may belong to several profiles and be primary in one of them.
    primary = primary_fences(reviewed).select("profile_id", "fence_id", F.lit(True).alias("is_primary"))
    marked = _fence_cells(reviewed, cell).join(primary, ["profile_id", "fence_id"], "left")
    return marked.groupBy(*keys, "_cy", "_cx").agg(
        F.collect_list(
            F.struct("edges", F.coalesce("is_primary", F.lit(False)).alias("is_primary"))
        ).alias("_fences")
    )


def profile_membership(obs: DataFrame, fences: DataFrame, cell: float = CELL_DEGREES, salts: int = 32) -> DataFrame:
    """Observations inside at least one fence of a profile, once per profile.

    ``inside_primary`` tells whether the position is also inside the fence the
    profile's crossings are measured against.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    reach = _reach(usable_fences(fences), cell)
    joined = _join_cells(obs, _profile_cells(fences, cell, ["profile_id"]), reach, cell, "inner", salts)
    kept = [c for c in joined.columns if c != "_fences"]
    hits = evaluate_once(joined, kept, {"_hits": F.filter("_fences", lambda f: inside_ring(lat, lon, f["edges"]))})
    return (
        hits.filter(F.size("_hits") > 0)
        .withColumn("inside_primary", F.exists("_hits", lambda f: f["is_primary"]))
        .drop("_hits")
    )


def flag_inside(obs: DataFrame, fences: DataFrame, cell: float = CELL_DEGREES, salts: int = 32) -> DataFrame:
    """Every observation with a boolean ``inside``: in at least one of the fences."""
    lat, lon = F.col("latitude"), F.col("longitude")
    reach = _reach(usable_fences(fences), cell)
    joined = _join_cells(obs, _profile_cells(fences, cell, []), reach, cell, "left", salts)
    hit = F.exists("_fences", lambda f: inside_ring(lat, lon, f["edges"]))
    return joined.withColumn("inside", F.coalesce(hit, F.lit(False))).drop("_fences")


def ring_centroids(fences: DataFrame) -> DataFrame:
    """Mean vertex of each ring, summed in vertex order."""
    total = lambda axis: F.aggregate("ring", F.lit(0.0), lambda acc, v: acc + v[axis])
    return fences.select(
        "fence_id",
        (total("lat") / F.size("ring")).alias("latitude"),
        (total("lon") / F.size("ring")).alias("longitude"),
    )


def fence_extents(fences: DataFrame) -> DataFrame:
    """Centre and span in kilometres of each fence's bounding box."""
    box = fence_bboxes(fences, 0.0)
    mid_lat = (F.col("min_lat") + F.col("max_lat")) / 2
    return box.select(
        "fence_id",
        mid_lat.alias("latitude"),
        ((F.col("min_lon") + F.col("max_lon")) / 2).alias("longitude"),
        (F.abs(F.col("max_lat") - F.col("min_lat")) * KM_PER_DEGREE).alias("span_lat_km"),
        (F.abs(F.col("max_lon") - F.col("min_lon")) * KM_PER_DEGREE * F.cos(F.radians(mid_lat))).alias("span_lon_km"),
    )


def points_extent(points: DataFrame) -> DataFrame:
    """Extent of a set of points, as one row."""
    box = points.agg(
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
    )
    mid_lat = (F.col("min_lat") + F.col("max_lat")) / 2
    return box.select(
        mid_lat.alias("latitude"),
        ((F.col("min_lon") + F.col("max_lon")) / 2).alias("longitude"),
        (F.abs(F.col("max_lat") - F.col("min_lat")) * KM_PER_DEGREE).alias("span_lat_km"),
        (F.abs(F.col("max_lon") - F.col("min_lon")) * KM_PER_DEGREE * F.cos(F.radians(mid_lat))).alias("span_lon_km"),
    )
