"""Table schemas and closed value lists.

Fact tables are flat: one column per leaf field, so parquet prunes and pushes
down on each of them.  Times are TimestampType in UTC.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The accepted members of each closed enumeration.
MODES = ["sea", "air", "land", "rail"]
ENTITY_TYPES = ["cargo_vessel", "tanker", "bulk_carrier", "aircraft", "vehicle", "unknown"]
SOURCE_STATES = ["fresh", "stale", "degraded", "unavailable"]
POSITION_ACCURACIES = ["exact", "approximate", "unknown"]
CLASSIFICATIONS = ["confirmed", "inferred", "unknown"]
FREIGHT_TYPES = ["cargo_vessel", "tanker", "bulk_carrier"]
FACILITY_MODES = ["land", "rail", "air"]
LANE_GROUPS = ["commercial_vehicle", "passenger_vehicle", "pedestrian", "fast", "nexus_sentri", "ready"]
FACILITY_METRICS = ["wait_minutes", "lanes_open", "operational_status"]
WATCH_METRICS = [
    "vessel_count", "moving_fraction", "dwell_cohort_size",
    "dwell_median_seconds", "entry_count", "exit_count",
]
FRAME_TYPES = [
    "PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport",
    "ShipStaticData", "StaticDataReport",
]

# Quality scales, best to worst.  The three scales are different on purpose:
# metrics know no "unavailable", tracks do, comparisons end in "unknown".
METRIC_STATES = ["fresh", "stale", "degraded"]
TRACK_STATES = ["fresh", "stale", "degraded", "unavailable"]
COMPARISON_STATES = ["fresh", "stale", "degraded", "unknown"]

OBSERVATION = T.StructType([
    T.StructField("observation_id", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("altitude_meters", T.DoubleType()),
    T.StructField("speed_knots", T.DoubleType()),
    T.StructField("speed_kph", T.DoubleType()),
    T.StructField("heading_degrees", T.DoubleType()),
    T.StructField("observed_at", T.TimestampType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("provider_id", T.StringType()),
    T.StructField("endpoint_id", T.StringType()),
    T.StructField("record_ref", T.StringType()),
    T.StructField("license_id", T.StringType()),
    T.StructField("source_state", T.StringType()),
    T.StructField("position_accuracy", T.StringType()),
    T.StructField("classification", T.StringType()),
])

MEASUREMENT = T.StructType([
    T.StructField("lane_group", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("status_label", T.StringType()),
])

FACILITY_READING = T.StructType([
    T.StructField("metric_id", T.StringType()),
    T.StructField("facility_id", T.StringType()),
    T.StructField("facility_type", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("observed_at", T.TimestampType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("measurements", T.ArrayType(MEASUREMENT)),
    T.StructField("provider_update_label", T.StringType()),
    T.StructField("port_status", T.StringType()),
    T.StructField("construction_notice", T.StringType()),
    T.StructField("provider_id", T.StringType()),
    T.StructField("endpoint_id", T.StringType()),
    T.StructField("record_ref", T.StringType()),
    T.StructField("license_id", T.StringType()),
    T.StructField("source_state", T.StringType()),
])

VERTEX = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])

FENCE = T.StructType([
    T.StructField("profile_id", T.StringType()),
    T.StructField("position", T.IntegerType()),
    T.StructField("fence_id", T.StringType()),
    T.StructField("purpose", T.StringType()),
    T.StructField("geometry_version", T.StringType()),
    T.StructField("geometry_status", T.StringType()),
    T.StructField("review_owner", T.StringType()),
    T.StructField("effective_date", T.StringType()),
    T.StructField("inclusion_rule", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("ring", T.ArrayType(VERTEX)),
    T.StructField("coverage_hint", T.StringType()),
])

PROFILE = T.StructType([
    T.StructField("profile_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("config_version", T.StringType()),
    T.StructField("limitation_count", T.IntegerType()),
])
