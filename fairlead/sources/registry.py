"""Built-in profiles and reviewed fences as small dimension tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fairlead import schema

REVIEWER = "geometry-review"
_POINT_RULE = "Point in polygon, even-odd rule, no margin"
_DISPLAY_RULE = "Display frame; facility readings are keyed by facility, not by membership"

# Profile id, name, region, mode, configuration version, number of stated limitations.
PROFILES = [
    ("long-beach-approach", "Los Angeles / Long Beach", "North America", "sea", "0.2.0", 5),
    ("singapore-malacca-approach", "Singapore / Malacca Approach", "Southeast Asia", "sea", "0.2.0", 5),
    ("suez-canal-approaches", "Suez Canal Approaches", "Middle East / North Africa", "sea", "0.2.0", 5),
    ("lax-cargo-air", "Los Angeles Cargo Air", "North America", "air", "0.3.0", 4),
    ("el-paso-border-crossings", "El Paso Border Crossings", "North America", "land", "0.3.0", 4),
]

# Reviewed fence rings as (latitude, longitude) vertices, per profile in registry order:
# fence id, purpose, geometry version, effective date, coverage hint, ring.
FENCES = {
    "long-beach-approach": [
        ("outer-anchorage", "waiting-cohort", "2026-09-09-v1", "2026-09-09", "covered",
         [(33.7182, -118.2052), (33.7181, -118.1768), (33.7181, -118.1331), (33.6731, -118.1008),
          (33.6382, -118.1167), (33.67, -118.19), (33.695, -118.225), (33.7072, -118.2387)]),
        ("approach-corridor", "approach-flow", "2026-09-09-v1", "2026-09-09", "covered",
         [(33.5917, -118.2333), (33.5917, -118.1917), (33.5917, -118.15), (33.4625, -118.0942),
          (33.3333, -118.0383), (33.325, -118.0758), (33.3167, -118.1125), (33.4542, -118.1729)]),
    ],
    "singapore-malacca-approach": [
        ("strait-traffic-corridor", "approach-flow", "2026-09-09-v1", "2026-09-09", "covered",
         [(1.26, 103.61), (1.25, 103.75), (1.265, 103.85), (1.3, 103.95), (1.27, 104.15), (1.24, 104.28),
          (1.13, 104.3), (1.09, 104.18), (1.13, 104.1), (1.15, 103.96), (1.11, 103.84), (1.17, 103.62)]),
        ("singapore-roadstead", "waiting-cohort", "2026-09-09-v1", "2026-09-09", "covered",
         [(1.264, 103.844), (1.237, 103.848), (1.213, 103.89), (1.279, 104.103), (1.3, 104.116),
          (1.35, 104.076), (1.368, 104.049), (1.301, 103.876), (1.286, 103.854)]),
    ],
    "suez-canal-approaches": [
        ("gulf-of-suez-approach", "approach-flow", "2026-09-09-v1", "2026-09-09", "unknown",
         [(29.93, 32.545), (29.93, 32.59), (29.89, 32.6), (29.74, 32.64), (29.59, 32.61), (29.59, 32.43),
          (29.65, 32.385), (29.73, 32.42), (29.82, 32.48), (29.87, 32.52)]),
        ("port-said-approach", "approach-flow", "2026-09-09-v1", "2026-09-09", "unknown",
         [(31.5, 32.29), (31.5, 32.48), (31.35, 32.48), (31.34, 32.4), (31.33, 32.34), (31.33, 32.27),
          (31.35, 32.26), (31.4, 32.26), (31.43, 32.28)]),
    ],
    "lax-cargo-air": [
        ("lax-cargo-approach", "approach-flow", "lax-v1-2026-09-10", "2026-09-10", "unknown",
         [(33.95, -118.65), (33.95, -118.25), (33.7, -118.25), (33.7, -118.65)]),
    ],
    "el-paso-border-crossings": [
        ("el-paso-crossings-area", "port-basin", "el-paso-v1-2026-09-10", "2026-09-10", "unknown",
         [(31.775, -106.47), (31.775, -106.43), (31.755, -106.43), (31.755, -106.47)]),
        ("ysleta-crossings-area", "port-basin", "el-paso-v1-2026-09-10", "2026-09-10", "unknown",
         [(31.682, -106.345), (31.682, -106.325), (31.663, -106.325), (31.663, -106.345)]),
    ],
}


def local_table(spark: SparkSession, rows: list[dict], struct) -> DataFrame:
    """A driver-side constant as a LocalRelation, so its size is known to the planner."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(struct, timezone="UTC") if _wants_timezone() else to_arrow_schema(struct)
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=arrow), schema=struct)


def _wants_timezone() -> bool:
    import inspect

    from pyspark.sql.pandas.types import to_arrow_schema

    return "timezone" in inspect.signature(to_arrow_schema).parameters


def profiles(spark: SparkSession) -> DataFrame:
    names = [f.name for f in schema.PROFILE.fields]
    return local_table(spark, [dict(zip(names, row)) for row in PROFILES], schema.PROFILE)


def fences(spark: SparkSession) -> DataFrame:
    rows = []
    for profile_id, entries in FENCES.items():
        for position, (fence_id, purpose, version, effective, hint, ring) in enumerate(entries):
            rows.append({
                "profile_id": profile_id,
                "position": position,
                "fence_id": fence_id,
                "purpose": purpose,
                "geometry_version": version,
                "geometry_status": "reviewed",
                "review_owner": REVIEWER,
                "effective_date": effective,
                "inclusion_rule": _DISPLAY_RULE if purpose == "port-basin" else _POINT_RULE,
                "rationale": f"Reviewed ring of {fence_id}",
                "ring": [{"lat": lat, "lon": lon} for lat, lon in ring],
                "coverage_hint": hint,
            })
    return local_table(spark, rows, schema.FENCE)
