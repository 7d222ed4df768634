"""SQL text per registered query, for an independent engine on the same tables.

The texts follow the definitions directly (self joins, plain window functions);
they share no logic with the Spark operators.
"""

from __future__ import annotations

from fairlead.operators.claims import BANNED, SCOPE_OVERREACH
from fairlead.operators.questions import METRIC_PATTERNS, TOOL_PATTERNS, WINDOW_PATTERNS
from fairlead.plans.views import PLANTED_PHRASES, QUESTIONS
from fairlead.schema import WATCH_METRICS
from fairlead.sources.registry import FENCES, PROFILES

_SQL: dict[str, str] = {}


def sql_texts() -> dict[str, str]:
    return dict(_SQL)


def _us(iso: str) -> str:
    return f"epoch_us(TIMESTAMP '{iso}')"


# --- shared relations ------------------------------------------------------------------

OBS = """
obs AS (
  SELECT event_id, user_id, 'ev-' || event_id AS observation_id, 'user:' || user_id AS entity_id,
    CASE WHEN event_id % 97 = 0 THEN 'tanker' WHEN user_id % 10 <= 3 THEN 'cargo_vessel'
         WHEN user_id % 10 <= 6 THEN 'tanker' WHEN user_id % 10 = 7 THEN 'bulk_carrier' ELSE 'unknown' END AS entity_type,
    CASE WHEN user_id % 6 = 5 THEN CAST(1.05 AS DOUBLE) + ((event_id*37 + user_id*11) % 400) / CAST(1250 AS DOUBLE)
         ELSE CAST(33.32 AS DOUBLE) + ((event_id*37 + user_id*11) % 400) / CAST(1000 AS DOUBLE) END AS latitude,
    CASE WHEN user_id % 6 = 5 THEN CAST(103.6 AS DOUBLE) + ((event_id*53 + user_id*29) % 200) / CAST(280 AS DOUBLE)
         ELSE CAST(-118.24 AS DOUBLE) + ((event_id*53 + user_id*29) % 200) / CAST(1000 AS DOUBLE) END AS longitude,
    CASE WHEN event_type <> 'error' THEN value / CAST(5 AS DOUBLE) END AS speed_knots,
    CAST(event_id % 360 AS DOUBLE) AS heading_degrees,
    epoch_us(ts) AS us, epoch_us(ts) + (event_id % 180) * 1000000 AS received_us,
    'prov-' || (event_id % 2) AS provider_id, 'feed-' || (event_id % 2) AS endpoint_id,
    CASE WHEN event_id % 10 <> 0 THEN 'r' || event_id END AS record_ref,
    CASE WHEN event_id % 50 = 0 THEN 'degraded' WHEN event_id % 50 = 1 THEN 'stale' ELSE 'fresh' END AS source_state,
    CASE WHEN event_id % 50 = 0 THEN 2 WHEN event_id % 50 = 1 THEN 1 ELSE 0 END AS rank,
    CASE WHEN event_type = 'signup' THEN 'inferred' ELSE 'confirmed' END AS classification
  FROM events)"""

COPIES = OBS + """,
copies AS (
  SELECT observation_id, entity_id, us, received_us, latitude, longitude, provider_id, endpoint_id, record_ref, event_id FROM obs
  UNION ALL
  SELECT observation_id || '-dup', entity_id, us, received_us + 3600000000, latitude, longitude, provider_id, endpoint_id, record_ref, event_id
  FROM obs WHERE event_id % 7 = 0),
keyed AS (
  SELECT *, CASE WHEN record_ref IS NOT NULL THEN 'ref:' || provider_id || ':' || record_ref
    ELSE 'pos:' || entity_id || ':' || us || ':' || CAST(floor(latitude*100000 + CAST(0.5 AS DOUBLE)) AS BIGINT) || ':'
         || CAST(floor(longitude*100000 + CAST(0.5 AS DOUBLE)) AS BIGINT) END AS duplicate_key
  FROM copies)"""


def _registry() -> str:
    rows = []
    for profile, fences in FENCES.items():
        for pos, (fence, purpose, version, _, hint, ring) in enumerate(fences):
            for i, (lat, lon) in enumerate(ring):
                rows.append(f"('{profile}',{pos},'{fence}','{purpose}','{version}','{hint}',{i},{lat}::DOUBLE,{lon}::DOUBLE)")
    return (
        "verts(profile_id, pos, fence_id, purpose, version, hint, i, lat, lon) AS (VALUES " + ",".join(rows) + ")"
    )


def _profiles() -> str:
    rows = [f"('{p}','{n}','{r}','{m}',{k})" for p, n, r, m, _, k in PROFILES]
    return "prof(profile_id, name, region, mode, limitations) AS (VALUES " + ",".join(rows) + ")"


EDGES = """
edges AS (
  SELECT v.*, coalesce(lag(lat) OVER w, last_value(lat) OVER f) AS lat_j, coalesce(lag(lon) OVER w, last_value(lon) OVER f) AS lon_j
  FROM verts v
  WINDOW w AS (PARTITION BY fence_id ORDER BY i),
         f AS (PARTITION BY fence_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
prim AS (
  SELECT profile_id, fence_id, version FROM (
    SELECT DISTINCT profile_id, fence_id, version, pos, purpose FROM verts)
  QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY CASE WHEN purpose = 'approach-flow' THEN 0 ELSE 1 END, pos) = 1)"""

HITS = """
hits AS (
  SELECT o.observation_id, e.profile_id, e.fence_id, any_value(e.version) AS version
  FROM obs o JOIN edges e ON ((e.lon > o.longitude) <> (e.lon_j > o.longitude))
    AND o.latitude < ((e.lat_j - e.lat) * (o.longitude - e.lon)) / (e.lon_j - e.lon) + e.lat
  GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""

MEMBERS = """
members AS (
  SELECT h.profile_id, bool_or(h.fence_id = p.fence_id) AS inside, o.*
  FROM hits h JOIN prim p USING (profile_id) JOIN obs o USING (observation_id)
  GROUP BY ALL)"""


def _geo() -> str:
    return f"WITH {OBS}, {_registry()}, {EDGES}, {HITS}"


def _windows(bounds) -> str:
    rows = [f"('{w}', {_us(s)}, {_us(e)})" for w, s, e in bounds]
    return (
        "win(window_id, s, e) AS (VALUES " + ",".join(rows) + """),
pairs AS (SELECT window_id, 'current' AS role, s, e, e AS computed FROM win
          UNION ALL SELECT window_id, 'baseline', s - (e - s), s, e FROM win)"""
    )


W3 = [("w1", "2024-01-15", "2024-01-22"), ("w2", "2024-01-20", "2024-01-22"), ("w3", "2024-01-10", "2024-01-12 12:00:00")]
GAP = 43_200_000_000


READINGS = """
fr AS (
  SELECT 'fm-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INT) AS metric_id,
    'site:' || l_suppkey AS facility_id, 'Site ' || l_suppkey AS display_name, CASE WHEN l_suppkey % 5 = 0 THEN 'rail' ELSE 'land' END AS mode, epoch_us(l_shipdate) AS us,
    epoch_us(l_shipdate) + (l_orderkey % 7) * 1000000 AS received_us,
    ['commercial_vehicle','passenger_vehicle','pedestrian','fast','nexus_sentri','ready','commercial_vehicle'][l_linenumber] AS lane,
    CASE WHEN l_partkey % 9 <> 0 THEN l_quantity END AS wait, l_suppkey % 4 = 0 AS is_live, 'profile-' || (l_suppkey % 10) AS profile_id, l_orderkey AS order_key
  FROM lineitem)"""
AIRCRAFT = """
a0 AS (SELECT event_id AS e, user_id AS u, epoch_us(ts) AS us FROM events),
a1 AS (
  SELECT e, u, us, 'a' || u AS hex, ['FDX','UPS','DLH','GTI','AF' || (u % 10),'BAW','BOX'][e % 7 + 1] IN ('FDX','UPS','GTI','BOX') AS freight,
    CAST(33.6 AS DOUBLE) + ((e*37 + u*11) % 400) / CAST(1000 AS DOUBLE) AS lat, CAST(-118.7 AS DOUBLE) + ((e*53 + u*29) % 500) / CAST(1000 AS DOUBLE) AS lon,
    CASE WHEN e % 6 <> 0 THEN floor((e % 40000) * CAST(0.3048 AS DOUBLE) + CAST(0.5 AS DOUBLE)) END AS alt,
    CASE WHEN e % 4 <> 0 THEN (e % 5000) / CAST(10 AS DOUBLE) END AS gs, (e % 3600) / CAST(10 AS DOUBLE) AS track, e % 9 = 0 AS mlat,
    CASE WHEN e % 3 <> 0 THEN (e % 90) / CAST(8 AS DOUBLE) END AS seen_pos FROM a0 WHERE e % 103 <> 0
  UNION ALL SELECT e, u, us, CASE WHEN e % 2 = 0 THEN 'b' || u END, false, CASE WHEN e % 5 = 0 THEN CAST(95.5 AS DOUBLE) ELSE CAST(33.8 AS DOUBLE) END,
    CASE WHEN e % 7 <> 0 THEN CAST(-118.4 AS DOUBLE) END, NULL, NULL, NULL, false, NULL FROM a0 WHERE e % 103 <> 0
  UNION ALL SELECT e, u, us, NULL, false, NULL, NULL, NULL, NULL, NULL, false, NULL FROM a0 WHERE e % 103 = 0),
air AS (
  SELECT *, CASE WHEN hex IS NULL OR lat IS NULL OR lon IS NULL THEN 'record.incomplete'
      WHEN lat > 90 THEN 'latitude.range' WHEN track >= 360 THEN 'heading_degrees.range' END AS reason,
    CASE WHEN seen_pos IS NULL THEN us
      ELSE CAST(floor((us - CAST(floor(seen_pos * 1000 + CAST(0.5 AS DOUBLE)) AS BIGINT) * 1000) / CAST(1000000 AS DOUBLE)) AS BIGINT) * 1000000 END AS seen,
    CASE WHEN freight THEN 'aircraft' ELSE 'unknown' END AS entity_type FROM a1)"""
# Aircraft rows and facility readings as of the current windows, for the profiles of these modes.
_FLOWN = "reason IS NULL AND lat < 33.95 AND lat >= 33.7 AND lon >= -118.65 AND lon < -118.25"
LAND = READINGS + """,
lm AS (SELECT *, epoch_us(TIMESTAMP '2024-01-01') + (((us - epoch_us(TIMESTAMP '1992-01-01')) // 86400000000) % 30 * 86400 + order_key % 86400) * 1000000 AS at_us FROM fr),
ld AS (SELECT 'el-paso-border-crossings' AS profile_id, metric_id, facility_id, display_name, at_us AS us, at_us + received_us - us AS received_us,
    CASE WHEN lane = 'commercial_vehicle' THEN wait END AS w FROM lm
  QUALIFY row_number() OVER (PARTITION BY facility_id, at_us, lane ORDER BY received_us - us DESC, metric_id DESC) = 1)"""
OTHERS = AIRCRAFT + "," + LAND + f""",
airc AS (SELECT p.window_id, count(*) AS n, count(*) FILTER (entity_type = 'aircraft') AS fr, count(*) FILTER (entity_type = 'unknown') AS un
  FROM air a JOIN pairs p ON p.role = 'current' AND a.seen BETWEEN p.s AND p.e WHERE {_FLOWN} GROUP BY 1),
lw AS (SELECT d.*, p.window_id FROM ld d JOIN pairs p ON p.role = 'current' AND d.us BETWEEN p.s AND p.e),
ll AS (SELECT * FROM lw QUALIFY row_number() OVER (PARTITION BY window_id, facility_id ORDER BY us DESC, received_us, metric_id) = 1),
landc AS (SELECT window_id, readings, facilities, w AS wait_minutes FROM (SELECT window_id, count(*) AS readings, count(DISTINCT facility_id) AS facilities FROM lw GROUP BY 1)
  JOIN (SELECT window_id, w FROM ll QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY us, metric_id) = 1) USING (window_id))"""


def _snap(bounds=W3, all_rows: bool = False) -> str:
    crossing_rows = """
cross_in AS (SELECT profile_id, entity_id, us, observation_id, inside, rank FROM members)"""
    if all_rows:
        crossing_rows = """
cross_in AS (
  SELECT p.profile_id, o.entity_id, o.us, o.observation_id, h.fence_id IS NOT NULL AS inside, o.rank
  FROM obs o CROSS JOIN prim p LEFT JOIN hits h ON h.observation_id = o.observation_id AND h.fence_id = p.fence_id)"""
    return f"""WITH {OBS}, {_registry()}, {_profiles()}, {EDGES}, {HITS}, {MEMBERS}, {_windows(bounds)}, {OTHERS}, {crossing_rows},
fan AS (
  SELECT m.*, p.window_id, p.role,
    lag(us) OVER w AS prev_us
  FROM members m JOIN pairs p ON m.us BETWEEN p.s AND p.e
  WINDOW w AS (PARTITION BY m.profile_id, p.window_id, p.role, m.entity_id ORDER BY m.us, m.observation_id)),
seg AS (
  SELECT *, sum(CASE WHEN prev_us IS NULL OR us - prev_us > {GAP} THEN 1 ELSE 0 END)
    OVER (PARTITION BY profile_id, window_id, role, entity_id ORDER BY us, observation_id) AS visit FROM fan),
vis AS (
  SELECT profile_id, window_id, role, entity_id, visit, count(*) AS n, min(us) AS a, max(us) AS b, max(rank) AS rank
  FROM seg GROUP BY ALL),
best AS (
  SELECT * FROM vis QUALIFY row_number() OVER (PARTITION BY profile_id, window_id, role, entity_id ORDER BY n DESC, a) = 1),
latest AS (
  SELECT profile_id, window_id, role, entity_id, entity_type, classification, speed_knots FROM fan
  QUALIFY row_number() OVER (PARTITION BY profile_id, window_id, role, entity_id ORDER BY us DESC, observation_id DESC) = 1),
tot AS (SELECT profile_id, window_id, role, entity_id, count(*) AS row_count, max(rank) AS rank FROM fan GROUP BY ALL),
flip AS (
  SELECT c.profile_id, p.window_id, p.role, c.entity_id, c.inside, c.us, c.rank,
    lag(c.inside) OVER w AS was, lag(c.us) OVER w AS prev_us, lag(c.rank) OVER w AS prev_rank
  FROM cross_in c JOIN pairs p ON c.us BETWEEN p.s AND p.e
  WINDOW w AS (PARTITION BY c.profile_id, p.window_id, p.role, c.entity_id ORDER BY c.us, c.observation_id)),
crs AS (
  SELECT profile_id, window_id, role, entity_id,
    count(*) FILTER (inside AND us - prev_us <= {GAP}) AS entries, count(*) FILTER (NOT inside AND us - prev_us <= {GAP}) AS exits,
    count(*) FILTER (us - prev_us > {GAP}) AS uncertain,
    max(greatest(rank, prev_rank)) FILTER (us - prev_us <= {GAP}) AS crossing_rank
  FROM flip WHERE was IS NOT NULL AND was <> inside GROUP BY ALL),
ent AS (
  SELECT t.*, CASE WHEN l.classification <> 'confirmed' THEN 'unclassified'
      WHEN l.entity_type IN ('cargo_vessel','tanker','bulk_carrier') THEN 'freight' ELSE 'other' END AS bucket,
    l.speed_knots, CASE WHEN b.n >= 2 THEN b.b - b.a END AS dwell_us, CASE WHEN b.n >= 2 THEN b.rank END AS dwell_rank,
    coalesce(c.entries, 0) AS entries, coalesce(c.exits, 0) AS exits, coalesce(c.uncertain, 0) AS uncertain, c.crossing_rank
  FROM tot t JOIN latest l USING (profile_id, window_id, role, entity_id)
    JOIN best b USING (profile_id, window_id, role, entity_id)
    LEFT JOIN crs c USING (profile_id, window_id, role, entity_id)),
flagged AS (
  SELECT *, bucket = 'freight' OR NOT bool_or(bucket = 'freight') OVER (PARTITION BY profile_id, window_id, role) AS chosen FROM ent),
agg AS (
  SELECT profile_id, window_id, role, sum(row_count)::BIGINT AS in_fence_rows,
    count(*) FILTER (bucket = 'freight') AS freight, count(*) FILTER (bucket = 'unclassified') AS unclassified,
    count(*) FILTER (bucket = 'other') AS other, max(rank) AS rank_all,
    count(*) FILTER (chosen AND speed_knots IS NOT NULL) AS eligible, count(*) FILTER (chosen AND speed_knots > 5) AS moving,
    count(*) FILTER (chosen AND speed_knots IS NULL) AS missing_speed, max(rank) FILTER (chosen) AS moving_rank,
    coalesce(sum(entries) FILTER (chosen), 0)::BIGINT AS entries, coalesce(sum(exits) FILTER (chosen), 0)::BIGINT AS exits,
    coalesce(sum(uncertain) FILTER (chosen), 0)::BIGINT AS uncertain, max(crossing_rank) FILTER (chosen) AS crossing_rank,
    count(dwell_us) AS dwell_cohort, median(dwell_us) / CAST(1000000 AS DOUBLE) AS median_dwell_seconds, max(dwell_rank) AS dwell_rank
  FROM flagged GROUP BY ALL),
labels_ AS (
  SELECT profile_id, string_agg(lab, '+' ORDER BY pos) AS fence_label FROM (
    SELECT DISTINCT profile_id, pos, fence_id || '@' || version AS lab FROM verts) GROUP BY 1),
wide AS (
  SELECT f.profile_id, f.name, f.region, f.mode, p.window_id, p.role, p.s AS window_start_us, p.e AS window_end_us, p.computed AS computed_us,
    l.fence_label, m.fence_id || '@' || m.version AS primary_label,
    coalesce(in_fence_rows, 0) AS in_fence_rows, coalesce(freight, 0) AS freight, coalesce(unclassified, 0) AS unclassified,
    coalesce(other, 0) AS other, coalesce(eligible, 0) AS eligible, coalesce(moving, 0) AS moving,
    coalesce(missing_speed, 0) AS missing_speed,
    CASE WHEN eligible > 0 THEN moving / CAST(eligible AS DOUBLE) END AS moving_fraction,
    coalesce(dwell_cohort, 0) AS dwell_cohort, median_dwell_seconds, coalesce(entries, 0) AS entries,
    coalesce(exits, 0) AS exits, coalesce(uncertain, 0) AS uncertain,
    CASE WHEN in_fence_rows IS NULL THEN 'unknown' ELSE ['fresh','stale','degraded'][rank_all + 1] END AS count_state,
    CASE WHEN coalesce(eligible, 0) = 0 THEN 'unknown' ELSE ['fresh','stale','degraded'][moving_rank + 1] END AS moving_state,
    CASE WHEN coalesce(dwell_cohort, 0) = 0 THEN 'unknown' ELSE ['fresh','stale','degraded'][dwell_rank + 1] END AS dwell_state,
    CASE WHEN coalesce(entries, 0) + coalesce(exits, 0) + coalesce(uncertain, 0) = 0 THEN 'unknown'
         ELSE ['fresh','stale','degraded'][coalesce(crossing_rank, 0) + 1] END AS crossing_state,
    CASE WHEN f.mode = 'air' AND p.role = 'current' THEN coalesce(ac.n, 0) END AS air_rows,
    CASE WHEN f.mode = 'air' AND p.role = 'current' THEN coalesce(ac.fr, 0) END AS air_freight,
    CASE WHEN f.mode = 'air' AND p.role = 'current' THEN coalesce(ac.un, 0) END AS air_unclassified,
    lc.facilities, lc.readings, lc.wait_minutes
  FROM prof f CROSS JOIN pairs p LEFT JOIN agg a ON a.profile_id = f.profile_id AND a.window_id = p.window_id AND a.role = p.role
    LEFT JOIN labels_ l ON l.profile_id = f.profile_id LEFT JOIN prim m ON m.profile_id = f.profile_id
    LEFT JOIN airc ac ON f.mode = 'air' AND p.role = 'current' AND ac.window_id = p.window_id
    LEFT JOIN landc lc ON f.mode = 'land' AND p.role = 'current' AND lc.window_id = p.window_id),
stamp AS (SELECT *, strftime(make_timestamp(computed_us), '%Y-%m-%dT%H:%M:%SZ') AS at_text FROM wide),
met AS (
  SELECT profile_id, mode, window_id, role, 'vessel_count' AS metric, 'vessel_count' AS metric_type, 'geofence:' || fence_label AS scope,
    CAST(freight AS DOUBLE) AS value, 'entities' AS unit, freight AS sample_count, count_state AS state, 'vessel-count-v1' AS formula_version, at_text, window_start_us, air_rows FROM stamp
  UNION ALL SELECT profile_id, mode, window_id, role, 'moving_fraction', 'moving_fraction', profile_id, moving_fraction, 'fraction', eligible, moving_state, 'moving-fraction-v1', at_text, window_start_us, NULL FROM stamp
  UNION ALL SELECT profile_id, mode, window_id, role, 'dwell_cohort_size', 'dwell_estimate', CASE WHEN role = 'baseline' THEN 'membership-predicate' ELSE profile_id END, CAST(dwell_cohort AS DOUBLE), 'entities', dwell_cohort, dwell_state, 'dwell-estimate-v1', at_text, window_start_us, NULL FROM stamp
  UNION ALL SELECT profile_id, mode, window_id, role, 'dwell_median_seconds', 'dwell_estimate', CASE WHEN role = 'baseline' THEN 'membership-predicate' ELSE profile_id END, median_dwell_seconds, 'seconds', dwell_cohort, dwell_state, 'dwell-estimate-v1', at_text, window_start_us, NULL FROM stamp
  UNION ALL SELECT profile_id, mode, window_id, role, 'entry_count', 'entry_count', 'geofence:' || primary_label, CAST(entries AS DOUBLE), 'crossings', entries, crossing_state, 'entry-exit-v1', at_text, window_start_us, NULL FROM stamp
  UNION ALL SELECT profile_id, mode, window_id, role, 'exit_count', 'exit_count', 'geofence:' || primary_label, CAST(exits AS DOUBLE), 'crossings', exits, crossing_state, 'entry-exit-v1', at_text, window_start_us, NULL FROM stamp),
metrics_ AS (
  SELECT profile_id, mode, window_id, role, metric, CASE WHEN mode = 'sea' THEN metric_type ELSE metric END AS metric_type,
    CASE WHEN mode = 'sea' THEN scope ELSE profile_id END AS scope, CASE WHEN mode = 'sea' THEN value ELSE CAST(nullif(air_rows, 0) AS DOUBLE) END AS value,
    CASE WHEN mode = 'sea' OR metric = 'moving_fraction' THEN unit ELSE 'count' END AS unit,
    CASE WHEN mode = 'sea' THEN sample_count ELSE coalesce(air_rows, 0) END AS sample_count,
    CASE WHEN mode = 'sea' THEN state WHEN air_rows > 0 THEN 'fresh' ELSE 'unknown' END AS state,
    CASE WHEN mode = 'sea' THEN formula_version WHEN air_rows IS NOT NULL THEN 'aircraft-count-v1-adsb' ELSE 'not-applicable-no-data' END AS formula_version,
    CASE WHEN mode = 'sea' THEN metric || '@' || scope || '@' || at_text ELSE profile_id || '.' || metric END AS metric_id, window_start_us
  FROM met),
cmp0 AS (
  SELECT c.profile_id, c.mode, c.window_id, c.metric, c.value AS current_value, b.value AS baseline_value, c.window_start_us, c.metric_id,
    c.value - b.value AS absolute_change,
    CASE WHEN b.value <> 0 THEN (c.value - b.value) / abs(b.value) END AS relative_change,
    least(c.sample_count, b.sample_count) AS sample_count,
    greatest(list_position(['fresh','stale','degraded','unknown'], c.state), list_position(['fresh','stale','degraded','unknown'], b.state)) AS worst
  FROM metrics_ c JOIN metrics_ b ON c.role = 'current' AND b.role = 'baseline' AND c.profile_id = b.profile_id
    AND c.window_id = b.window_id AND c.metric = b.metric)"""


def _compared(min_sample: int) -> str:
    return f"""
cmp AS (
  SELECT *, sample_count < {min_sample} AS low_sample,
    absolute_change IS NOT NULL AND relative_change IS NULL AS zero_baseline,
    CASE WHEN absolute_change IS NULL OR sample_count < {min_sample} THEN 'unknown'
      WHEN relative_change IS NULL THEN CASE WHEN absolute_change > 0 THEN 'increase' WHEN absolute_change < 0 THEN 'decrease' ELSE 'stable' END
      WHEN abs(relative_change) < CAST(0.05 AS DOUBLE) THEN 'stable' WHEN relative_change > 0 THEN 'increase' ELSE 'decrease' END AS direction,
    CASE WHEN absolute_change IS NULL OR sample_count < {min_sample} THEN 'unknown'
      ELSE ['fresh','stale','degraded','unknown'][worst] END AS state
  FROM cmp0)"""


EAGER = """
rules(event_type, metric, rule_direction, rel, absolute) AS (VALUES
  ('queue_buildup','dwell_cohort_size','increase',0.05::DOUBLE,1.0::DOUBLE), ('stoppage','moving_fraction','decrease',0.05::DOUBLE,0.01::DOUBLE),
  ('flow_surge','entry_count','increase',0.05::DOUBLE,1.0::DOUBLE), ('flow_drop','entry_count','decrease',0.05::DOUBLE,1.0::DOUBLE)),
fired AS (
  SELECT r.event_type || '@' || c.profile_id || '@' || c.window_start_us AS event_id, r.event_type, c.profile_id AS scope, c.*
  FROM cmp c JOIN rules r USING (metric)
  WHERE c.mode = 'sea' AND c.state <> 'unknown' AND c.direction = r.rule_direction
    AND abs(coalesce(absolute_change, 0)) >= r.absolute AND (relative_change IS NULL OR abs(relative_change) >= r.rel))"""

_SQL["snapshot"] = _snap() + """
SELECT profile_id, window_id, in_fence_rows, freight, unclassified, other, eligible, moving, moving_fraction, dwell_cohort,
  median_dwell_seconds, entries, exits, uncertain, count_state, moving_state, dwell_state, crossing_state AS entry_state,
  crossing_state AS exit_state
FROM wide WHERE profile_id = 'long-beach-approach' AND role = 'current'"""
_AIR = {
    "in_fence_rows": "ELSE air_rows", "freight": "ELSE air_freight", "unclassified": "ELSE air_unclassified",
    "other": "WHEN air_rows IS NOT NULL THEN 0",
}
_SQL["all_snapshots"] = _snap() + """
SELECT profile_id, mode, window_id, role, window_start_us, window_end_us, """ + ", ".join(
    f"CASE WHEN mode = 'sea' THEN {c} {_AIR.get(c, '')} END AS {c}"
    for c in "in_fence_rows freight unclassified other eligible moving missing_speed dwell_cohort entries exits uncertain".split()
) + """, CASE WHEN mode = 'sea' THEN count_state WHEN air_rows > 0 THEN 'fresh' ELSE 'unknown' END AS count_state, facilities, readings, wait_minutes FROM wide"""
_SQL["facility_windows"] = _snap() + """
SELECT profile_id, window_id, facility_id, metric_id, us AS observed_at_us, w AS commercial_wait_minutes FROM ll"""
_SQL["open_water_crossings"] = _snap(all_rows=True) + """
SELECT profile_id, window_id, role, entries, exits, uncertain FROM wide WHERE mode = 'sea'"""
_SQL["dwell_metrics"] = _snap() + """
SELECT profile_id, window_id, role, dwell_cohort, median_dwell_seconds, dwell_state FROM wide WHERE mode = 'sea'"""
_SQL["metrics_long"] = _snap() + """
SELECT profile_id, window_id, role, metric, metric_type, metric_id, scope, value, unit, sample_count, state, formula_version
FROM metrics_ WHERE mode = 'sea'"""
_SQL["metric_grid"] = _snap() + """
SELECT profile_id, metric, unit, formula_version, count(*) AS rows, count(value) AS known, count(*) FILTER (state = 'unknown') AS unknown
FROM metrics_ GROUP BY ALL"""
_SQL["baseline_comparison"] = _snap() + "," + _compared(1) + """
SELECT profile_id, window_id, metric, current_value, baseline_value, absolute_change, relative_change, direction, state, sample_count,
  low_sample, zero_baseline FROM cmp"""
_SQL["detected_events"] = _snap() + "," + _compared(3) + "," + EAGER + """
SELECT event_id, event_type, scope, window_id, metric, current_value, baseline_value, absolute_change, relative_change, direction, state FROM fired"""
_SQL["network_totals"] = _snap() + """
SELECT window_id, mode, count(*) AS profiles, sum(CASE WHEN mode = 'sea' THEN freight END)::BIGINT AS vessels,
  sum(air_rows)::BIGINT AS aircraft_rows, sum(CASE WHEN mode = 'land' THEN coalesce(readings, 0) END)::BIGINT AS facility_readings
FROM wide WHERE role = 'current' GROUP BY ALL"""
_SQL["event_topk"] = _snap() + "," + _compared(3) + "," + EAGER + """,
r AS (SELECT window_id, event_id, abs(coalesce(relative_change, 0)) AS p FROM fired),
k AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY p DESC, event_id) AS rank,
  count(*) OVER (PARTITION BY window_id) AS considered FROM r)
SELECT window_id, event_id, rank, considered, greatest(0, considered - 6) AS dropped FROM k WHERE rank <= 6"""
_SQL["compare_rows"] = _snap() + "," + _compared(1) + """,
cmp3 AS (SELECT * REPLACE (CASE WHEN sample_count < 3 THEN 'unknown' ELSE state END AS state,
  CASE WHEN sample_count < 3 THEN 'unknown' ELSE direction END AS direction) FROM cmp),
""" + EAGER.replace("FROM cmp c", "FROM cmp3 c") + """,
ev AS (SELECT scope AS profile_id, window_id, count(*) AS n, max(abs(relative_change)) AS ch FROM fired GROUP BY ALL),
ch AS (SELECT profile_id, window_id, max(abs(relative_change)) AS ch FROM cmp WHERE metric IN ('vessel_count','moving_fraction') GROUP BY ALL),
cov AS (SELECT profile_id, count(*) AS n, count(*) FILTER (hint = 'covered') AS c FROM (SELECT DISTINCT profile_id, fence_id, hint FROM verts) GROUP BY 1)
SELECT w.profile_id, w.window_id, w.name, w.region, w.mode, CASE mode WHEN 'sea' THEN CAST(freight AS DOUBLE) WHEN 'air' THEN CAST(nullif(air_rows, 0) AS DOUBLE) ELSE wait_minutes END AS headline,
  coalesce(ev.n, 0) AS event_count, CASE WHEN cov.c = cov.n THEN 'covered' WHEN cov.c = 0 THEN 'unknown' ELSE 'partial' END AS coverage_state,
  greatest(CAST(0 AS DOUBLE), coalesce(ev.ch, 0), CASE WHEN mode = 'sea' THEN coalesce(ch.ch, 0) ELSE 0 END) AS anomaly_priority
FROM wide w LEFT JOIN ev USING (profile_id, window_id) LEFT JOIN ch USING (profile_id, window_id) JOIN cov USING (profile_id)
WHERE role = 'current'"""
_SQL["metric_provenance"] = _snap() + """,
i AS (SELECT f.*, 'vessel_count' AS metric FROM fan f
  UNION ALL SELECT f.*, 'moving_fraction' FROM fan f JOIN flagged g USING (profile_id, window_id, role, entity_id) WHERE g.chosen)
SELECT profile_id, window_id, role, metric, provider_id, endpoint_id, max(received_us) AS retrieved_at_us, min(us) AS interval_start_us,
  max(us) AS interval_end_us, count(*) AS observations, 'open' AS license_id, CAST(NULL AS VARCHAR) AS violation FROM i GROUP BY ALL"""
_SQL["metric_inputs"] = _snap() + """
SELECT f.profile_id, f.window_id, f.role, 'vessel_count' AS metric, f.observation_id FROM fan f
UNION ALL
SELECT f.profile_id, f.window_id, f.role, 'moving_fraction', f.observation_id
FROM fan f JOIN flagged g USING (profile_id, window_id, role, entity_id) WHERE g.chosen"""

WATCHES = """
w0 AS (
  SELECT 'w|' || (user_id % 40) || '|' || (event_id % 7) AS id,
    ['long-beach-approach','singapore-malacca-approach','suez-canal-approaches','lax-cargo-air','nowhere'][user_id % 5 + 1] AS profile_id,
    CASE WHEN event_id % 31 = 0 THEN 'weather' ELSE
      ['vessel_count','moving_fraction','dwell_cohort_size','dwell_median_seconds','entry_count','exit_count'][(event_id % 7) % 6 + 1] END AS metric,
    CASE WHEN user_id % 2 = 0 THEN 'increase' ELSE 'decrease' END AS watch_direction, CAST(event_id % 9 - 1 AS DOUBLE) AS pct_threshold,
    CASE WHEN user_id % 3 = 0 THEN 'require-fresh' ELSE 'allow-stale' END AS freshness_policy, event_id AS seq
  FROM events),
wv AS (SELECT * FROM w0 WHERE metric <> 'weather' AND pct_threshold > 0)"""
_SQL["watch_upsert"] = "WITH " + WATCHES + """,
u AS (SELECT * FROM wv QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq % 2 DESC, seq DESC) = 1)
SELECT id, profile_id, metric, watch_direction, pct_threshold, seq FROM u WHERE id NOT IN (SELECT id FROM w0 WHERE seq % 101 = 0)"""
_SQL["watch_evaluation"] = _snap() + "," + _compared(1) + "," + WATCHES + """,
st AS (SELECT * FROM wv QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq % 2 DESC, seq DESC) = 1),
j AS (
  SELECT st.*, m.window_id, m.value AS observed_value, c.relative_change, c.direction, c.state AS cstate, c.direction IS NOT NULL AS has_cmp,
    c.direction = 'unknown' OR c.relative_change IS NULL OR NOT (st.freshness_policy = 'allow-stale' OR c.state = 'fresh') AS unusable
  FROM st LEFT JOIN metrics_ m ON m.role = 'current' AND m.profile_id = st.profile_id AND m.metric = st.metric
    LEFT JOIN cmp c ON c.profile_id = m.profile_id AND c.window_id = m.window_id AND c.metric = m.metric AND c.metric IN ('vessel_count','moving_fraction'))
SELECT id, window_id, profile_id, metric, observed_value,
  CASE WHEN has_cmp THEN CASE WHEN unusable THEN relative_change ELSE relative_change * 100 END END AS relative_change_pct,
  CASE WHEN window_id IS NULL THEN 'unavailable' WHEN NOT has_cmp AND observed_value IS NULL THEN 'unavailable'
    WHEN NOT has_cmp OR unusable THEN 'unknown'
    WHEN (CASE WHEN watch_direction = 'increase' THEN relative_change * 100 >= 0 ELSE relative_change * 100 <= 0 END)
      AND abs(relative_change * 100) >= pct_threshold THEN 'fired' ELSE 'clear' END AS status
FROM j"""

CLAIMS = """
v AS (SELECT * FROM metrics_ WHERE role = 'current' AND mode = 'sea' AND metric = 'vessel_count'),
m AS (SELECT * FROM metrics_ WHERE role = 'current' AND mode = 'sea' AND metric = 'moving_fraction'),
c AS (SELECT * FROM cmp WHERE metric = 'vessel_count'),
n AS (SELECT profile_id, window_id, in_fence_rows FROM wide WHERE role = 'current'),
cl AS (
  SELECT v.profile_id, v.window_id, 1 AS claim_order, 'claim-vessel-count' AS claim_id,
    CASE WHEN v.value = 0 AND n.in_fence_rows = 0 THEN 'vessel_count: unknown, nothing received in the fence'
      ELSE 'vessel_count: ' || CAST(v.value AS BIGINT) END AS text,
    CASE WHEN v.value = 0 AND n.in_fence_rows = 0 THEN 'LIMITATION' ELSE 'CALCULATION' END AS category,
    CASE WHEN v.value = 0 AND n.in_fence_rows = 0 THEN 0 WHEN v.state = 'fresh' THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS confidence, 1 AS n_support
  FROM v JOIN n USING (profile_id, window_id)
  UNION ALL
  SELECT c.profile_id, c.window_id, 2, 'claim-vessel-count-baseline',
    CASE WHEN direction = 'stable' OR abs(relative_change) < 1e-12 THEN 'vessel_count against baseline: unchanged'
      ELSE 'vessel_count against baseline: ' || CASE WHEN relative_change > 0 THEN '+' ELSE '-' END
        || printf('%.1f', floor(abs(relative_change) * 100 * CAST(10 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE)) || '%' END,
    'COMPARISON', CASE WHEN state = 'fresh' THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END, 2
  FROM c WHERE mode = 'sea' AND direction <> 'unknown' AND relative_change IS NOT NULL
  UNION ALL
  SELECT profile_id, window_id, 3, 'claim-moving-fraction',
    'moving_fraction: ' || CAST(floor(abs(value) * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) || '% of the vessels with a speed',
    'CALCULATION', CASE WHEN state = 'fresh' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END, 1
  FROM m WHERE value IS NOT NULL)"""
_SQL["claims"] = _snap() + "," + _compared(1) + "," + CLAIMS + """
SELECT profile_id, window_id, claim_order, claim_id, text, category, confidence, CAST(n_support AS BIGINT) AS n_support FROM cl"""

# --- scans, ordering ----------------------------------------------------------------------

_SQL["scoped_read"] = f"""WITH {OBS}
SELECT observation_id, entity_id, entity_type, latitude, longitude, us AS observed_at_us FROM obs
WHERE us BETWEEN {_us('2024-01-15')} AND {_us('2024-01-22')} AND entity_type IN ('cargo_vessel','tanker')"""
_SQL["scoped_facility_read"] = f"""WITH {READINGS}
SELECT metric_id, facility_id, mode, us AS observed_at_us FROM fr
WHERE mode = 'land' AND us BETWEEN {_us('1996-01-01')} AND {_us('1998-12-31')}"""
_SQL["prefer_live"] = f"""WITH {READINGS}, h AS (SELECT profile_id, bool_or(is_live) AS live FROM fr GROUP BY 1)
SELECT profile_id, facility_id, is_live, count(*) AS readings FROM fr JOIN h USING (profile_id)
WHERE CASE WHEN live THEN is_live ELSE facility_id LIKE 'site:1%' AND us BETWEEN {_us('1996-01-01')} AND {_us('1997-12-31')} END
GROUP BY ALL"""
_SQL["commercial_wait"] = f"""WITH {READINGS}
SELECT metric_id, facility_id, CASE WHEN lane = 'commercial_vehicle' THEN wait END AS commercial_wait_minutes FROM fr"""
_SQL["dedupe_facility"] = f"""WITH {READINGS},
k AS (SELECT *, facility_id || '|' || us || '|' || lane || ':lanes_open|' || lane || ':wait_minutes' AS duplicate_key FROM fr)
SELECT metric_id, duplicate_key, us AS observed_at_us, received_us AS received_at_us FROM k
QUALIFY row_number() OVER (PARTITION BY duplicate_key ORDER BY received_us DESC, metric_id DESC) = 1"""
_SQL["latest_per_facility"] = f"""WITH {READINGS}
SELECT facility_id, metric_id, us AS observed_at_us FROM fr
QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY us DESC, received_us, metric_id) = 1"""
_SQL["facility_claims"] = f"""WITH {READINGS},
l AS (SELECT *, CASE WHEN lane = 'commercial_vehicle' THEN wait END AS w FROM fr
  QUALIFY row_number() OVER (PARTITION BY facility_id ORDER BY us DESC, received_us, metric_id) = 1)
SELECT profile_id, 'claim-facility-' || facility_id || CASE WHEN w IS NULL THEN '-unknown' ELSE '-commercial-wait' END AS claim_id,
  CASE WHEN w IS NULL THEN 'commercial_wait at ' || display_name || ': unknown'
    ELSE 'commercial_wait at ' || display_name || ': ' || CAST(w AS BIGINT) || ' min, read ' || strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ') END AS text,
  CASE WHEN w IS NULL THEN 'LIMITATION' ELSE 'OBSERVATION' END AS category, CASE WHEN w IS NULL THEN 0 ELSE CAST(0.95 AS DOUBLE) END AS confidence
FROM l
UNION ALL SELECT 'empty-' || r_regionkey, 'claim-facility-none', 'commercial_wait: unknown, no reading in the window', 'LIMITATION', 0 FROM region"""
_SQL["sorted_observations"] = f"WITH {COPIES} SELECT us AS observed_at_us, entity_id, observation_id FROM copies ORDER BY ALL"
_SQL["dedupe_observations"] = f"""WITH {COPIES}
SELECT observation_id, duplicate_key, us AS observed_at_us, received_us AS received_at_us FROM keyed
QUALIFY row_number() OVER (PARTITION BY duplicate_key ORDER BY us, entity_id, observation_id) = 1"""
_SQL["duplicates_removed"] = f"""WITH {COPIES}
SELECT count(*) AS rows, count(DISTINCT duplicate_key) AS unique_rows, count(*) - count(DISTINCT duplicate_key) AS removed FROM keyed"""
_SQL["retention"] = f"""WITH {OBS},
a AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY received_us DESC, observation_id DESC) <= 5000),
b AS (SELECT * FROM obs WHERE received_us >= {_us('2024-01-30')} - 86400000000
  QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY us DESC, observation_id DESC) <= 100)
SELECT 'arrival' AS rule, provider_id, observation_id, received_us AS received_at_us FROM a WHERE received_us >= {_us('2024-01-30')} - 259200000000
UNION ALL SELECT 'time', provider_id, observation_id, received_us FROM b"""
_SQL["bounded_topk"] = """WITH k AS (SELECT event_type, CAST(event_id AS VARCHAR) AS id, value AS priority,
  row_number() OVER (PARTITION BY event_type ORDER BY value DESC, CAST(event_id AS VARCHAR)) AS rank,
  count(*) OVER (PARTITION BY event_type) AS considered FROM events)
SELECT event_type, id, priority, rank, considered, greatest(0, considered - 25) AS dropped FROM k WHERE rank <= 25"""
_SQL["cohort_stability"] = """WITH a AS (SELECT DISTINCT event_type, user_id FROM events WHERE ts < TIMESTAMP '2024-01-16'),
b AS (SELECT DISTINCT event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
j AS (SELECT coalesce(a.event_type, b.event_type) AS event_type, a.user_id IS NULL OR b.user_id IS NULL AS differs
  FROM a FULL JOIN b ON a.event_type = b.event_type AND a.user_id = b.user_id)
SELECT event_type, count(*) FILTER (differs) AS differing_ids, count(*) FILTER (differs) = 0 AS stable FROM j GROUP BY 1"""
_SQL["network_topk"] = _geo() + "," + MEMBERS + """,
c AS (SELECT profile_id, count(*) AS considered FROM members GROUP BY 1),
s AS (SELECT greatest(1, 800 // count(*)) AS share FROM c),
r AS (SELECT m.profile_id, observation_id, us, considered, row_number() OVER (PARTITION BY m.profile_id ORDER BY us DESC, entity_id || '@' || us, observation_id) AS rn
  FROM members m JOIN c USING (profile_id))
SELECT profile_id, observation_id, us AS observed_at_us, considered, greatest(0, considered - share) AS dropped FROM r, s WHERE rn <= share"""

# --- space --------------------------------------------------------------------------------

_SQL["point_in_polygon"] = _geo() + """
SELECT o.observation_id, h.observation_id IS NOT NULL AS inside FROM obs o
LEFT JOIN (SELECT DISTINCT observation_id FROM hits WHERE profile_id = 'long-beach-approach') h USING (observation_id)"""
_SQL["fence_membership"] = _geo() + "SELECT observation_id, profile_id, fence_id, version AS geometry_version FROM hits"
_SQL["profile_membership"] = _geo() + "," + MEMBERS + "SELECT observation_id, profile_id, inside AS inside_primary FROM members"
_SQL["bbox_candidates"] = _geo() + """,
b AS (SELECT fence_id, min(lat) - CAST(0.05 AS DOUBLE) AS a, max(lat) + CAST(0.05 AS DOUBLE) AS b, min(lon) - CAST(0.05 AS DOUBLE) AS c, max(lon) + CAST(0.05 AS DOUBLE) AS d FROM verts GROUP BY 1)
SELECT b.fence_id, count(o.observation_id) AS candidates FROM b LEFT JOIN obs o ON o.latitude BETWEEN b.a AND b.b AND o.longitude BETWEEN b.c AND b.d GROUP BY 1"""

SUPPLIERS = """
s0 AS (SELECT s_suppkey AS s, s_nationkey AS nation, CAST(33.32 AS DOUBLE) + (s_suppkey % 40) / CAST(100 AS DOUBLE) AS la,
    CAST(-118.24 AS DOUBLE) + (s_suppkey % 19) / CAST(100 AS DOUBLE) AS lo, CAST(0.01 AS DOUBLE) + (s_suppkey % 5) / CAST(200 AS DOUBLE) AS z FROM supplier),
sv AS (
  SELECT s, 0 AS i, la + CAST(0 AS DOUBLE) AS lat, lo + CAST(0 AS DOUBLE) AS lon FROM s0 UNION ALL SELECT s, 1, la + z, lo FROM s0
  UNION ALL SELECT s, 2, la + z, lo + z FROM s0 UNION ALL SELECT s, 3, la + z / 2, lo + z / 2 FROM s0 WHERE s % 29 <> 0
  UNION ALL SELECT s, 4, la, lo + z FROM s0 WHERE s % 29 <> 0),
sr AS (SELECT s, i, CASE WHEN s % 29 <> 0 AND s % 31 = 0 THEN lat + 100 ELSE lat END AS lat, lon FROM sv),
sc AS (SELECT s, nation, CASE WHEN s % 13 = 0 THEN 'geometry_status.not_reviewed' WHEN s % 17 = 0 THEN 'review_owner.blank'
    WHEN s % 19 = 0 THEN 'effective_date.not_date' WHEN s % 23 = 0 THEN 'rationale.incomplete'
    WHEN s % 29 = 0 THEN 'ring.too_short' WHEN s % 31 = 0 THEN 'ring.latitude_range' END AS violation FROM s0)"""
_SQL["fence_validation"] = f"WITH {SUPPLIERS} SELECT 'f-' || s AS fence_id, violation, violation IS NULL AS usable FROM sc"
_SQL["fence_bboxes"] = f"""WITH {SUPPLIERS}
SELECT 'f-' || s AS fence_id, min(lat) - CAST(0.05 AS DOUBLE) AS min_lat, min(lon) - CAST(0.05 AS DOUBLE) AS min_lon,
  max(lat) + CAST(0.05 AS DOUBLE) AS max_lat, max(lon) + CAST(0.05 AS DOUBLE) AS max_lon FROM sr GROUP BY 1"""
_SQL["ring_centroids"] = f"""WITH {SUPPLIERS},
p AS (SELECT s, list(lat ORDER BY i) AS lats, list(lon ORDER BY i) AS lons FROM sr GROUP BY 1)
SELECT 'f-' || s AS fence_id, list_reduce(lats, lambda a, b: a + b) / len(lats) AS latitude, list_reduce(lons, lambda a, b: a + b) / len(lons) AS longitude FROM p"""
_SQL["fence_extents"] = f"""WITH {SUPPLIERS},
b AS (SELECT s, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM sr GROUP BY 1),
e AS (SELECT s, (a + b) / 2 AS latitude, (c + d) / 2 AS longitude, abs(b - a) * CAST(111.32 AS DOUBLE) AS x, abs(d - c) * CAST(111.32 AS DOUBLE) * cos(radians((a + b) / 2)) AS y FROM b)
SELECT 'f-' || s AS fence_id, floor(latitude * 1e6 + 0.5) / 1e6 AS latitude, floor(longitude * 1e6 + 0.5) / 1e6 AS longitude,
  floor(x * 1e6 + 0.5) / 1e6 AS span_lat_km, floor(y * 1e6 + 0.5) / 1e6 AS span_lon_km FROM e"""
_SQL["primary_fence"] = f"""WITH {SUPPLIERS}
SELECT 'p-' || nation AS profile_id, 'f-' || s AS fence_id, 'metrics' AS rule FROM s0
QUALIFY row_number() OVER (PARTITION BY nation ORDER BY CASE WHEN s % 4 = 1 THEN 0 ELSE 1 END, s) = 1
UNION ALL
SELECT 'p-' || nation, 'f-' || s, 'framing' FROM s0
QUALIFY row_number() OVER (PARTITION BY nation ORDER BY CASE WHEN s % 4 = 0 THEN 0 WHEN s % 4 = 1 THEN 1 ELSE 2 END, s) = 1"""
_SQL["grid_membership"] = f"""WITH {OBS}, {SUPPLIERS},
e AS (SELECT r.*, coalesce(lag(lat) OVER w, last_value(lat) OVER f) AS lat_j, coalesce(lag(lon) OVER w, last_value(lon) OVER f) AS lon_j
  FROM sr r JOIN sc USING (s) WHERE violation IS NULL
  WINDOW w AS (PARTITION BY s ORDER BY i), f AS (PARTITION BY s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
h AS (SELECT e.s, o.observation_id, o.entity_id, o.us FROM obs o JOIN e ON ((e.lon > o.longitude) <> (e.lon_j > o.longitude))
    AND o.latitude < ((e.lat_j - e.lat) * (o.longitude - e.lon)) / (e.lon_j - e.lon) + e.lat
  GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT 'f-' || s AS fence_id, count(*) AS rows, count(DISTINCT entity_id) AS entities, max(us) AS newest_us FROM h GROUP BY 1"""
_SQL["coverage_state"] = f"""WITH {SUPPLIERS}, c AS (SELECT nation, count(*) AS n, count(*) FILTER (s % 2 = 0) AS c FROM s0 GROUP BY 1)
SELECT 'p-' || nation AS profile_id, 'p-' || nation AS name, 'r' AS region, 'sea' AS mode, n AS fence_count, c AS covered_fences,
  CASE WHEN c = n THEN 'covered' WHEN c = 0 THEN 'unknown' ELSE 'partial' END AS coverage_state, CAST(3 AS BIGINT) AS limitation_count FROM c"""

# --- windows and sequences ------------------------------------------------------------------

_SQL["default_window"] = "SELECT 'default' AS window_id, epoch_us(min(ts)) AS start_at_us, epoch_us(max(ts)) AS end_at_us FROM events"
_SQL["relative_windows"] = """WITH b AS (SELECT epoch_us(min(ts)) AS f, epoch_us(max(ts)) AS t FROM events),
r AS (SELECT event_id, ['last_6_hours','last_24_hours','last_3_days'][event_id % 3 + 1] AS relative, epoch_us(ts) + 3600000000 AS ref,
  [6, 24, 72][event_id % 3 + 1] AS h FROM events)
SELECT event_id, relative, ref AS reference_at_us, least(ref, t) AS end_at_us, greatest(f, least(ref, t) - CAST(h AS BIGINT) * 3600000000) AS start_at_us FROM r, b"""
_SQL["replay_snapshots"] = _geo() + "," + MEMBERS + f""",
b(window_id, s, e) AS (VALUES ('r1', {_us('2024-01-15')}, {_us('2024-01-18 09:30:00')}), ('r2', {_us('2024-01-17 12:00:00')}, {_us('2024-01-19')})),
cs AS (SELECT DISTINCT window_id, least(s + k * 3600000000, e) AS c FROM b, range(0, 83) t(k)),
inw AS (SELECT m.*, window_id, c FROM members m JOIN cs ON m.us BETWEEN c - 21600000000 AND c),
l AS (SELECT * FROM inw QUALIFY row_number() OVER (PARTITION BY window_id, profile_id, c, entity_id ORDER BY us DESC, observation_id DESC) = 1),
n AS (SELECT window_id, profile_id, c, count(*) AS in_fence_rows FROM inw GROUP BY ALL)
SELECT window_id, profile_id, c AS cursor_us, any_value(in_fence_rows) AS in_fence_rows, count(*) AS entities,
  count(*) FILTER (classification = 'confirmed' AND entity_type IN ('cargo_vessel','tanker','bulk_carrier')) AS vessels
FROM l JOIN n USING (window_id, profile_id, c) GROUP BY window_id, profile_id, c"""
_SQL["headline_series"] = _geo() + "," + MEMBERS + "," + AIRCRAFT + "," + LAND + f""",
b(window_id, s, e) AS (VALUES ('s1', {_us('2024-01-15')}, {_us('2024-01-22')}), ('s2', {_us('2024-01-10')}, {_us('2024-01-16')})),
k AS (SELECT m.*, window_id, ((us - s) * 12) // (e - s) AS bucket FROM members m, b WHERE us >= s AND us < e),
l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY window_id, profile_id, bucket, entity_id ORDER BY us DESC, observation_id DESC) = 1),
v AS (SELECT window_id, profile_id, bucket, count(*) FILTER (classification = 'confirmed' AND entity_type IN ('cargo_vessel','tanker','bulk_carrier')) AS vessels FROM l GROUP BY ALL),
fl AS (SELECT 'lax-cargo-air' AS profile_id, window_id, ((seen - s) * 12) // (b.e - s) AS bucket, count(*) AS n FROM air, b WHERE {_FLOWN} AND seen >= s AND seen < b.e GROUP BY ALL),
lk AS (SELECT d.*, window_id, ((us - s) * 12) // (e - s) AS bucket FROM ld d, b WHERE us >= s AND us < e),
lf AS (SELECT * FROM lk QUALIFY row_number() OVER (PARTITION BY window_id, bucket, facility_id ORDER BY us DESC, received_us, metric_id) = 1),
lh AS (SELECT * FROM lf QUALIFY row_number() OVER (PARTITION BY window_id, bucket ORDER BY us, metric_id) = 1)
SELECT b.window_id, p.profile_id, p.mode, g.bucket, CASE WHEN mode = 'sea' THEN coalesce(v.vessels, 0) END AS vessels,
  CASE mode WHEN 'sea' THEN CAST(coalesce(v.vessels, 0) AS DOUBLE) WHEN 'air' THEN CAST(fl.n AS DOUBLE) ELSE lh.w END AS value
FROM b CROSS JOIN (VALUES ('long-beach-approach', 'sea'), ('singapore-malacca-approach', 'sea'), ('suez-canal-approaches', 'sea'), ('lax-cargo-air', 'air'),
  ('el-paso-border-crossings', 'land')) p(profile_id, mode)
CROSS JOIN range(0, 12) g(bucket) LEFT JOIN v ON v.window_id = b.window_id AND v.profile_id = p.profile_id AND v.bucket = g.bucket
LEFT JOIN fl ON fl.window_id = b.window_id AND fl.profile_id = p.profile_id AND fl.bucket = g.bucket
LEFT JOIN lh ON lh.window_id = b.window_id AND lh.profile_id = p.profile_id AND lh.bucket = g.bucket"""
TRACKS = OBS + f""",
g AS (SELECT *, lag(us) OVER w AS prev_us FROM obs WINDOW w AS (PARTITION BY entity_id ORDER BY us, observation_id)),
t AS (SELECT *, sum(CASE WHEN prev_us IS NULL OR us - prev_us > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY us, observation_id) AS seg FROM g),
trk AS (SELECT entity_id, seg, min(us) AS a, max(us) AS b, count(*) AS n, max(rank) AS rank,
  max(CASE WHEN prev_us IS NULL OR us - prev_us > {GAP} THEN 0 ELSE us - prev_us END) AS gap FROM t GROUP BY ALL)"""
_SQL["track_segments"] = f"""WITH {TRACKS}
SELECT entity_id, a AS start_at_us, b AS end_at_us, n AS observed_points, gap / CAST(1000000 AS DOUBLE) AS largest_gap_seconds,
  ['fresh','stale','degraded'][rank + 1] AS source_state, 0 AS interpolated_points, entity_id || '@' || a AS track_id FROM trk"""
_SQL["track_points"] = f"""WITH {TRACKS}
SELECT t.entity_id || '@' || a AS track_id, observation_id FROM t JOIN trk USING (entity_id, seg)"""
CLASSES = OBS + """,
g AS (SELECT *, lag(entity_type) OVER w AS prev_type FROM obs WINDOW w AS (PARTITION BY entity_id ORDER BY us, observation_id)),
ch AS (SELECT entity_id, count(*) FILTER (prev_type IS NOT NULL AND prev_type <> entity_type) AS classification_changes FROM g GROUP BY 1),
la AS (SELECT entity_id, entity_type, classification = 'confirmed' AS reliable, observation_id AS decided_by FROM obs
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY us DESC, observation_id DESC) = 1),
cls AS (SELECT * FROM la JOIN ch USING (entity_id))"""
_SQL["entity_classification"] = f"WITH {CLASSES} SELECT entity_id, entity_type, reliable, decided_by, classification_changes FROM cls"
BUCKET = """CASE WHEN NOT reliable THEN 'unclassified' WHEN entity_type IN ('cargo_vessel','tanker','bulk_carrier') THEN 'freight' ELSE 'other' END"""
_SQL["cohorts"] = f"WITH {CLASSES} SELECT entity_id, {BUCKET} AS bucket, entity_type, reliable, decided_by, classification_changes FROM cls"
_SQL["moving_fraction"] = f"""WITH {CLASSES}, {_windows(W3)},
f AS (SELECT o.*, w.window_id FROM obs o JOIN win w ON o.us BETWEEN w.s AND w.e JOIN cls USING (entity_id)
  WHERE cls.reliable AND cls.entity_type IN ('cargo_vessel','tanker','bulk_carrier')),
l AS (SELECT window_id, entity_id, speed_knots, max(rank) OVER (PARTITION BY window_id, entity_id) AS rank FROM f
  QUALIFY row_number() OVER (PARTITION BY window_id, entity_id ORDER BY us DESC, observation_id DESC) = 1)
SELECT window_id, count(speed_knots) AS eligible, count(*) FILTER (speed_knots > 5) AS moving, count(*) FILTER (speed_knots IS NULL) AS missing_speed,
  count(*) FILTER (speed_knots > 5) / CAST(count(speed_knots) AS DOUBLE) AS moving_fraction,
  CASE WHEN count(speed_knots) = 0 THEN 'unknown' ELSE ['fresh','stale','degraded'][max(rank) + 1] END AS state FROM l GROUP BY 1"""
_SQL["vessel_count"] = _geo() + f""", {_windows(W3)},
f AS (SELECT o.*, w.window_id, o.observation_id IN (SELECT observation_id FROM hits WHERE profile_id = 'long-beach-approach') AS inside
  FROM obs o JOIN win w ON o.us BETWEEN w.s AND w.e),
l AS (SELECT window_id, entity_type, classification, bool_or(inside) OVER p AS inside, max(rank) OVER p AS rank,
    row_number() OVER (PARTITION BY window_id, entity_id ORDER BY us DESC, observation_id DESC) AS rn FROM f
  WINDOW p AS (PARTITION BY window_id, entity_id)),
x AS (SELECT * FROM l WHERE rn = 1 AND inside)
SELECT win.window_id, count(*) FILTER (classification = 'confirmed' AND entity_type IN ('cargo_vessel','tanker','bulk_carrier')) AS counted,
  count(*) FILTER (classification <> 'confirmed') AS unclassified,
  count(*) FILTER (classification = 'confirmed' AND entity_type NOT IN ('cargo_vessel','tanker','bulk_carrier')) AS outside_allowlist,
  CASE WHEN count(x.rn) = 0 THEN 'unknown' ELSE ['fresh','stale','degraded'][max(rank) + 1] END AS state
FROM win LEFT JOIN x USING (window_id) GROUP BY 1"""
_SQL["entry_exit"] = _geo() + f""", {_windows(W3)},
f AS (SELECT o.entity_id, o.us, w.window_id, o.observation_id,
    o.observation_id IN (SELECT observation_id FROM hits WHERE fence_id = 'approach-corridor') AS inside
  FROM obs o JOIN win w ON o.us BETWEEN w.s AND w.e),
l AS (SELECT *, lag(inside) OVER w AS was, lag(us) OVER w AS prev_us FROM f WINDOW w AS (PARTITION BY window_id, entity_id ORDER BY us, observation_id))
SELECT window_id, count(*) FILTER (inside AND us - prev_us <= {GAP}) AS entries, count(*) FILTER (NOT inside AND us - prev_us <= {GAP}) AS exits,
  count(*) FILTER (us - prev_us > {GAP}) AS uncertain FROM l WHERE was IS NOT NULL AND was <> inside GROUP BY 1"""
_SQL["dwell_per_entity"] = _geo() + "," + MEMBERS + f""", {_windows(W3)},
f AS (SELECT m.*, w.window_id, lag(us) OVER p AS prev_us FROM members m JOIN win w ON m.us BETWEEN w.s AND w.e
  WINDOW p AS (PARTITION BY m.profile_id, w.window_id, m.entity_id ORDER BY m.us, m.observation_id)),
s AS (SELECT *, sum(CASE WHEN prev_us IS NULL OR us - prev_us > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id, window_id, entity_id ORDER BY us, observation_id) AS visit FROM f),
v AS (SELECT profile_id, window_id, entity_id, visit, min(us) AS a, max(us) AS b, count(*) AS n,
  max(CASE WHEN prev_us IS NULL OR us - prev_us > {GAP} THEN 0 ELSE us - prev_us END) AS gap FROM s GROUP BY ALL),
k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY profile_id, window_id, entity_id ORDER BY n DESC, a) = 1)
SELECT profile_id, window_id, entity_id, a AS first_inside_at_us, b AS last_inside_at_us, n AS observation_count,
  gap / CAST(1000000 AS DOUBLE) AS largest_gap_seconds, (b - a) / CAST(1000000 AS DOUBLE) AS dwell_seconds FROM k WHERE n >= 2"""
_SQL["worst_state"] = f"""WITH {OBS}
SELECT entity_id, ['fresh','stale','degraded'][max(rank) + 1] AS metric_state, ['fresh','stale','degraded'][max(rank) + 1] AS track_state, count(*) AS rows
FROM obs GROUP BY 1"""

# --- provenance and health ------------------------------------------------------------------

_SQL["provenance"] = f"""WITH {COPIES}
SELECT provider_id, endpoint_id, max(received_us) AS retrieved_at_us, min(us) AS interval_start_us, max(us) AS interval_end_us,
  count(*) AS observations, 'open' AS license_id, CAST(NULL AS VARCHAR) AS violation FROM copies GROUP BY ALL"""
HEALTH = """
r AS (SELECT 'src-' || (user_id % 25) AS source_id, event_id AS seq, epoch_us(ts) AS now_us,
    CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'partial' ELSE 'ok' END AS status,
    CASE WHEN event_id % 4 <> 0 THEN epoch_us(ts) - CAST(trunc(value * 100) AS BIGINT) * 1000000 END AS seen FROM events),
u AS (SELECT *, max(CASE WHEN status <> 'failure' THEN seen END) OVER (PARTITION BY source_id ORDER BY now_us, seq) AS last FROM r),
h AS (SELECT *, CASE WHEN status = 'failure' THEN 'UNAVAILABLE' WHEN status = 'partial' THEN 'DEGRADED' WHEN last IS NULL THEN 'UNAVAILABLE'
    WHEN now_us - last <= 3600000000 THEN 'FRESH' ELSE 'STALE' END AS state FROM u)"""
_SQL["source_health"] = f"WITH {HEALTH} SELECT source_id, seq, status, last AS last_observation_at_us, state FROM h"
AS_OF = HEALTH + """,
p AS (SELECT event_id, 'src-' || (event_id % 27) AS source_id, epoch_us(ts) + 90000000 AS pa FROM events),
j AS (SELECT p.event_id, p.source_id, p.pa, h.state, h.now_us, h.last FROM p LEFT JOIN h ON h.source_id = p.source_id AND h.now_us <= p.pa
  QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY h.now_us DESC NULLS LAST, h.seq DESC) = 1),
a AS (SELECT source_id, pa, CASE WHEN now_us IS NULL THEN 'NEVER_ANSWERED' WHEN state = 'FRESH' AND pa - last > 3600000000 THEN 'STALE' ELSE state END AS state,
  now_us, last, CAST(floor((pa - last) / CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS age FROM j)"""
_SQL["health_as_of"] = f"WITH {AS_OF} SELECT source_id, pa AS probe_at_us, state, now_us AS last_refresh_at_us, last AS last_observation_at_us, age AS age_seconds FROM a"
_SQL["readiness_rollup"] = f"""WITH {AS_OF},
q AS (SELECT *, pa // 21600000000 * 21600000000 AS quarter FROM a),
x AS (SELECT quarter, count(DISTINCT source_id) AS sources, count(*) AS reports, count(*) FILTER (state <> 'FRESH') AS not_fresh FROM q GROUP BY 1),
y AS (SELECT g.quarter, count(*) AS expected, count(*) FILTER (s.source_id NOT IN (SELECT source_id FROM q WHERE q.quarter = g.quarter)) AS missing
  FROM (SELECT DISTINCT quarter FROM q) g CROSS JOIN (SELECT DISTINCT source_id FROM r) s GROUP BY 1)
SELECT quarter AS quarter_us, expected, sources, reports, missing, not_fresh, missing = 0 AS ready,
  CASE WHEN missing > 0 THEN 'error' WHEN not_fresh > 0 THEN 'degraded' ELSE 'ok' END AS status FROM y LEFT JOIN x USING (quarter)"""

# --- counters -------------------------------------------------------------------------------

REQUESTS = """
q AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN '/api/health' WHEN 'click' THEN 'static' WHEN 'signup' THEN '/metrics'
    WHEN 'error' THEN 'other' ELSE 'static' END AS route,
  CASE WHEN value > 100 THEN '5xx' WHEN value > 50 THEN '4xx' ELSE '2xx' END AS status FROM events)"""
_SQL["status_classes"] = f"WITH {REQUESTS} SELECT event_id, route, status FROM q"
_SQL["label_counters"] = f"WITH {REQUESTS} SELECT route, status, count(*) AS value, 'http_requests_total' AS counter FROM q GROUP BY ALL"
_SQL["rate_5m"] = f"""WITH {REQUESTS}
SELECT (epoch_us(ts) // 300000000) * 300000000 AS window_start_us, route, count(*) AS events, count(*) / CAST(300 AS DOUBLE) AS per_second FROM q GROUP BY ALL"""
_SQL["stream_rate_5m"] = f"""WITH {REQUESTS},
w AS (SELECT (epoch_us(ts) // 300000000) * 300000000 AS a, route, count(*) AS n FROM q GROUP BY ALL)
SELECT a AS window_start_us, route, n AS events, n / CAST(300 AS DOUBLE) AS per_second FROM w"""

# --- detector -------------------------------------------------------------------------------

# Labels in order, one per step: each takes its nearest detection that no earlier one has taken.
MATCHED = """RECURSIVE
d AS (SELECT event_id AS did, user_id % 5 AS zone, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'),
l AS (SELECT event_id AS lid, user_id % 5 AS zone, epoch_us(ts) AS us FROM events WHERE event_type = 'error'),
c AS (SELECT l.lid, l.zone, list({'dist': abs(d.us - l.us), 'did': d.did} ORDER BY abs(d.us - l.us), d.did) AS cand
  FROM l JOIN d ON d.zone = l.zone AND abs(d.us - l.us) <= 1800000000 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY lid) AS k FROM c),
st AS (SELECT DISTINCT zone, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS lid,
    CAST(NULL AS STRUCT(dist BIGINT, did BIGINT)) AS pick FROM o
  UNION ALL SELECT zone, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.did) END, lid, pick FROM (
    SELECT st.zone, o.k, st.used, o.lid, list_filter(o.cand, lambda x: NOT list_contains(st.used, x.did))[1] AS pick
    FROM st JOIN o ON o.zone = st.zone AND o.k = st.k + 1) t),
m AS (SELECT zone, lid, pick.did AS did, pick.dist AS dist FROM st WHERE pick IS NOT NULL)"""
_SQL["match_labels"] = f"""WITH {MATCHED}
SELECT 'l-' || lid AS label_id, 'd-' || did AS detection_id, dist AS distance_us FROM m"""
_SQL["evaluation_report"] = f"""WITH {MATCHED},
pl AS (SELECT zone, count(*) AS labels FROM l GROUP BY 1), pd AS (SELECT zone, count(*) AS detections FROM d GROUP BY 1),
pm AS (SELECT zone, count(*) AS true_positives, sum(dist)::BIGINT AS distance_us FROM m GROUP BY 1)
SELECT 'stoppage' AS event_type, 'zone-' || zone AS scope, labels, detections, true_positives, distance_us
FROM pl FULL JOIN pd USING (zone) LEFT JOIN pm USING (zone)"""
_SQL["report_tables"] = f"""WITH {MATCHED},
z AS (SELECT (SELECT count(*) FROM l) AS nl, (SELECT count(*) FROM d) AS nd, (SELECT count(*) FROM m) AS tp),
p AS (SELECT tp / CAST(nd AS DOUBLE) AS p, tp / CAST(nl AS DOUBLE) AS r, * FROM z)
SELECT 'labels' AS table_name, nl AS rows, NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, NULL::DOUBLE AS f1 FROM p UNION ALL SELECT 'events', nd, NULL, NULL, NULL FROM p
UNION ALL SELECT 'matches', tp, NULL, NULL, NULL FROM p UNION ALL SELECT 'manifest', (SELECT count(*) FROM events), NULL, NULL, NULL
UNION ALL SELECT 'scores', 1, p, r, 2 * p * r / (p + r) FROM p"""
_SQL["detector_scores"] = f"""WITH {MATCHED},
z AS (SELECT (SELECT count(*) FROM l) AS nl, (SELECT count(*) FROM d) AS nd, (SELECT count(*) FROM m) AS tp, (SELECT sum(dist) FROM m) AS s)
SELECT tp AS true_positives, nd - tp AS false_positives, nl - tp AS false_negatives, CAST(0 AS BIGINT) AS true_negatives,
  tp / CAST(nd AS DOUBLE) AS precision, tp / CAST(nl AS DOUBLE) AS recall,
  2 * (tp / CAST(nd AS DOUBLE)) * (tp / CAST(nl AS DOUBLE)) / ((tp / CAST(nd AS DOUBLE)) + (tp / CAST(nl AS DOUBLE))) AS f1,
  (nd - tp) / CAST(1000 AS DOUBLE) AS false_positives_per_entity_hour, CAST(s AS DOUBLE) / CAST(1000000 AS DOUBLE) / tp AS mean_latency_seconds FROM z"""

# --- normalization --------------------------------------------------------------------------

_OBS_REASON = """CASE WHEN event_id % 257 = 0 THEN 'record.not_object'
    WHEN event_id % 199 = 0 THEN 'observation_id.blank' WHEN event_id % 229 = 0 THEN 'mode.unlisted=submarine'
    WHEN event_id % 227 = 0 THEN 'entity_type.unlisted=yacht'
    WHEN event_id % 211 = 0 THEN 'latitude.range'
    WHEN event_id % 233 = 0 AND user_id % 6 <> 5 THEN 'longitude.range'
    WHEN event_id % 223 = 0 THEN 'heading_degrees.range'
    WHEN event_id % 239 = 0 THEN 'observed_at.not_time'
    WHEN event_id % 241 = 0 THEN 'license_id.blank'
    WHEN event_id % 251 = 0 THEN 'source_state.unlisted=rotten' END"""
RAWS = OBS + f""",
raws AS (
  SELECT *, {_OBS_REASON} AS reject_reason, CASE WHEN event_id % 257 <> 0 AND event_id % 239 <> 0 THEN us END AS seen_us FROM obs)"""
_SQL["normalize_observations"] = f"""WITH {RAWS}, x AS (SELECT *, event_id % 257 <> 0 AS ok FROM raws)
SELECT event_id AS seq, reject_reason, CASE WHEN ok AND event_id % 199 <> 0 THEN observation_id END AS observation_id,
  CASE WHEN ok THEN entity_id END AS entity_id,
  CASE WHEN ok THEN CASE WHEN event_id % 211 = 0 THEN latitude + 100 ELSE latitude END END AS latitude,
  CASE WHEN ok THEN CASE WHEN event_id % 233 = 0 THEN longitude - 100 ELSE longitude END END AS longitude,
  CASE WHEN ok THEN speed_knots END AS speed_knots,
  CASE WHEN ok THEN CASE WHEN event_id % 223 = 0 THEN 400 ELSE heading_degrees END END AS heading_degrees,
  seen_us AS observed_at_us, CASE WHEN ok THEN received_us END AS received_at_us, CASE WHEN ok THEN record_ref END AS record_ref,
  CASE WHEN ok THEN CASE WHEN event_id % 251 = 0 THEN 'rotten' ELSE source_state END END AS source_state FROM x"""
_SQL["rejects_by_reason"] = f"WITH {RAWS} SELECT reject_reason, count(*) AS rejected FROM raws WHERE reject_reason IS NOT NULL GROUP BY 1"
_SQL["ingest_outcome"] = f"""WITH {RAWS}
SELECT event_id % 16 AS batch, count(*) FILTER (reject_reason IS NULL) AS accepted, count(*) FILTER (reject_reason IS NOT NULL) AS rejected,
  max(us) FILTER (reject_reason IS NULL) AS last_observation_at_us,
  CASE WHEN count(*) FILTER (reject_reason IS NULL) = 0 THEN 'failure' WHEN count(*) FILTER (reject_reason IS NOT NULL) > 0 THEN 'partial' ELSE 'ok' END AS status
FROM raws GROUP BY 1"""
MANIFESTS = RAWS + """,
mf AS (SELECT *, CASE WHEN event_id % 257 = 0 AND event_id % 29 <> 0 THEN 'manifest.not_object' WHEN event_id % 37 = 0 THEN 'truth_state.not_simulated' WHEN event_id % 41 = 0 THEN 'simulated.not_true'
    WHEN event_id % 31 = 0 THEN 'provider_id.not_simulated' WHEN event_id % 29 = 0 THEN 'observations.not_list'
    WHEN event_id % 43 = 0 THEN 'fixture_id.blank' END AS violation FROM raws)"""
_FIXTURE_ID = "CASE WHEN event_id % 257 = 0 AND event_id % 29 <> 0 THEN NULL WHEN event_id % 43 = 0 THEN '' ELSE 'fx-' || event_id END"
_SQL["manifest_guard"] = f"WITH {MANIFESTS} SELECT 'fx-' || event_id || '.json' AS file, {_FIXTURE_ID} AS fixture_id, violation FROM mf"
_SQL["scan_manifests"] = f"""WITH {MANIFESTS}
SELECT coalesce(reject_reason, 'accepted') AS outcome, count(*) AS rows, max(seen_us) AS newest_us FROM mf WHERE violation IS NULL GROUP BY 1"""
_SQL["dataset_manifest"] = f"""WITH {MANIFESTS}
SELECT 'fx-' || event_id || '.json' AS file, {_FIXTURE_ID} AS fixture_id,
  CASE WHEN event_id % 257 = 0 AND event_id % 29 <> 0 THEN NULL WHEN event_id % 37 = 0 THEN 'OBSERVED' ELSE 'SIMULATED' END AS truth_state,
  CAST(CASE WHEN event_id % 257 = 0 OR event_id % 29 = 0 THEN 0 ELSE 1 END AS BIGINT) AS observations FROM mf"""
_SQL["entity_keys"] = """SELECT 'prov-' || (event_id % 3) || ':mmsi-' || user_id AS entity_key, count(*) AS rows,
  count(*) FILTER (33 + (event_id % 120) - 30 <= 90) AS valid_latitudes FROM events GROUP BY 1"""
_SHIP = """CASE WHEN {c} BETWEEN 70 AND 79 THEN 'cargo_vessel' WHEN {c} BETWEEN 80 AND 89 THEN 'tanker' ELSE 'unknown' END"""
_SHIP_CLASS = "CASE WHEN {c} BETWEEN 20 AND 99 THEN 'confirmed' ELSE 'unknown' END"
_SQL["ship_type_class"] = f"""WITH c AS (SELECT l_partkey % 110 AS code FROM lineitem)
SELECT code, {_SHIP.format(c='code')} AS entity_type, {_SHIP_CLASS.format(c='code')} AS classification, count(*) AS rows FROM c GROUP BY ALL"""

FRAMES = f"""
f0 AS (
  SELECT event_id AS e, user_id AS u, event_id % 8 AS k, epoch_us(ts) AS us, epoch_us(ts) + (event_id % 180) * 1000000 AS received_us,
    CASE event_id % 8 WHEN 0 THEN 'ShipStaticData' WHEN 1 THEN 'StaticDataReport' WHEN 2 THEN 'BaseStationReport'
      WHEN 6 THEN 'StandardClassBPositionReport' WHEN 7 THEN 'ExtendedClassBPositionReport' ELSE 'PositionReport' END AS mtype,
    CASE WHEN event_id % 11 <> 0 THEN CAST(33.32 AS DOUBLE) + ((event_id*37 + user_id*11) % 400) / CAST(1000 AS DOUBLE) ELSE CAST(33.4 AS DOUBLE) END AS lat,
    CASE WHEN event_id % 11 <> 0 THEN CAST(-118.24 AS DOUBLE) + ((event_id*53 + user_id*29) % 200) / CAST(1000 AS DOUBLE)
         WHEN event_id % 77 <> 0 THEN CAST(-118.1 AS DOUBLE) END AS lon
  FROM events),
f1 AS (
  SELECT *, CASE WHEN e % 19 = 0 THEN NULL WHEN e % 17 <> 0 AND e % 23 = 0 THEN (us // 1000) * 1000 - 7200000000 ELSE (us // 1000) * 1000 END AS seen,
    CASE WHEN e % 101 = 0 THEN 'frame.not_object' WHEN k = 3 THEN 'metadata.absent'
      WHEN k IN (0, 1) THEN NULL WHEN k = 2 THEN 'message_type.unused=BaseStationReport'
      WHEN lon IS NULL THEN 'longitude.not_number' WHEN e % 19 = 0 THEN 'time_utc.not_time=soon' END AS reason FROM f0),
f2 AS (
  SELECT *, CASE WHEN e % 101 = 0 THEN 'invalid' WHEN k = 2 THEN 'unsupported' WHEN reason IS NOT NULL THEN 'invalid'
      WHEN k IN (0, 1) THEN 'classification-update' ELSE 'observation' END AS kind FROM f1),
frm AS (
  SELECT *, kind = 'observation' AS good, kind = 'classification-update' AS stat,
    CASE WHEN seen % 1000000 = 0 THEN strftime(make_timestamp(seen), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(make_timestamp(seen), '%Y-%m-%dT%H:%M:%S.%gZ') END AS seen_text,
    {_SHIP.format(c='e % 100')} AS stype, {_SHIP_CLASS.format(c='e % 100')} AS sclass FROM f2)"""
_SQL["normalize_frames"] = f"""WITH {FRAMES}
SELECT e AS arrival_seq, kind, reason AS reject_reason, CASE WHEN e % 101 <> 0 THEN mtype END AS message_type,
  CASE WHEN e % 101 <> 0 THEN u END AS mmsi, CASE WHEN good OR stat THEN 'aisstream:' || u END AS entity_id,
  CASE WHEN good THEN 'aisstream:mmsi-' || u || ':' || seen_text END AS observation_id,
  CASE WHEN good THEN lat END AS latitude, CASE WHEN good THEN lon END AS longitude,
  CASE WHEN good AND e % 13 <> 0 THEN (e % 300) / CAST(10 AS DOUBLE) END AS speed_knots,
  CASE WHEN good THEN CASE WHEN e % 5 <> 0 THEN CAST(e % 360 AS DOUBLE) WHEN e % 3 <> 0 THEN nullif((e % 3600) / CAST(10 AS DOUBLE), 360) END END AS heading_degrees,
  CASE WHEN good THEN seen END AS observed_at_us, CASE WHEN stat THEN stype END AS static_type, CASE WHEN stat THEN sclass END AS static_classification
FROM frm"""
_SQL["asof_classification"] = f"""WITH {FRAMES},
o AS (SELECT * FROM frm WHERE good OR stat),
l AS (SELECT *, last_value(CASE WHEN stat THEN stype END IGNORE NULLS) OVER w AS t, last_value(CASE WHEN stat THEN sclass END IGNORE NULLS) OVER w AS c
  FROM o WINDOW w AS (PARTITION BY u ORDER BY received_us, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT u AS mmsi, e AS arrival_seq, coalesce(t, 'unknown') AS entity_type, coalesce(c, 'unknown') AS classification FROM l WHERE good"""
_SQL["stream_asof_classification"] = _SQL["asof_classification"]
_SQL["stream_frames"] = f"""WITH {FRAMES},
g AS (SELECT (received_us // 86400000000) * 86400000000 AS day, kind, count(*) AS frames FROM frm GROUP BY ALL)
SELECT day AS day_us, kind, frames FROM g"""

_LANE = "['commercial_vehicle','passenger_vehicle','pedestrian','fast','nexus_sentri','ready','commercial_vehicle'][l_linenumber]"
_SQL["normalize_facility"] = f"""WITH b AS (
  SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, l_partkey AS p, l_quantity AS q, epoch_us(l_shipdate) AS us, {_LANE} AS lane FROM lineitem),
r AS (SELECT *, CASE WHEN o % 73 = 0 THEN 'facility_id.blank' WHEN o % 79 = 0 THEN 'mode.unlisted=sea'
    WHEN o % 53 = 0 THEN 'observed_at.after_received' WHEN o % 59 = 0 THEN 'measurements.empty'
    WHEN o % 61 = 0 THEN 'lane_group.unlisted=all' WHEN p % 9 <> 0 AND o % 67 = 0 THEN 'wait_minutes.negative'
    WHEN o % 71 = 0 THEN 'lanes_open.not_whole' WHEN o % 47 = 0 THEN 'source.incomplete' END AS reason FROM b)
SELECT o AS order_key, n AS line_number, s AS supp_key, reason AS reject_reason, 'fm-' || o || '-' || n AS metric_id,
  CASE WHEN o % 73 <> 0 THEN 'site:' || s END AS facility_id, us AS observed_at_us, us + CASE WHEN o % 53 = 0 THEN -60000000 ELSE 60000000 END AS received_at_us,
  CASE WHEN o % 59 <> 0 THEN CASE WHEN o % 61 = 0 THEN 'all' ELSE lane END END AS first_lane, CASE WHEN o % 59 <> 0 THEN 'minutes' END AS first_unit,
  CASE WHEN o % 59 <> 0 THEN CASE WHEN p % 9 = 0 THEN NULL WHEN o % 67 = 0 THEN -3 ELSE q END END AS first_value,
  CASE WHEN o % 3 = 0 THEN 'fresh' ELSE 'unavailable' END AS source_state FROM r"""
_SQL["border_feed"] = """WITH b AS (
  SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, l_partkey AS p, CAST(l_quantity AS INT) AS q, epoch_us(l_shipdate) AS us FROM lineitem),
c AS (SELECT *, o % 83 = 0 AS down, p % 11 <> 0 AND p % 13 <> 0 AS usable, p % 9 <> 0 AS w, n % 3 <> 0 AS l,
    lower(CASE WHEN s % 3 = 0 THEN 'Port' ELSE 'Gate' || (s % 7) END) AS gate FROM b),
one AS (SELECT *, CASE WHEN down OR NOT usable THEN 0 ELSE (w::INT + l::INT + (w AND l)::INT) END AS per,
    CASE WHEN down THEN 0 ELSE 1 + (n % 2 = 0)::INT + (n % 4 = 0)::INT END AS lanes FROM c),
f AS (SELECT *, CASE WHEN NOT down AND o % 97 <> 0 THEN 'cbp:' || (240000 + s) || ':' || gate END AS fac,
    CASE WHEN NOT down AND o % 89 <> 0 THEN us + 27000000000 END AS seen FROM one),
t AS (SELECT *, list_aggregate(list_filter([CASE WHEN w THEN 'wait_minutes' END, CASE WHEN l THEN 'lanes_open' END, CASE WHEN w AND l THEN 'operational_status' END], lambda x: x IS NOT NULL), 'string_agg', '|') AS names FROM f),
z AS (SELECT *, list_filter([CASE WHEN per > 0 THEN 'commercial_vehicle:' || replace(names, '|', '|commercial_vehicle:') END,
    CASE WHEN per > 0 AND n % 2 = 0 THEN 'fast:' || replace(names, '|', '|fast:') END,
    CASE WHEN per > 0 AND n % 4 = 0 THEN 'pedestrian:' || replace(names, '|', '|pedestrian:') END], lambda x: x IS NOT NULL) AS parts FROM t)
SELECT o AS order_key, n AS line_number, s AS supp_key,
  CASE WHEN down THEN 'payload.not_list' WHEN o % 97 = 0 THEN 'crossing.incomplete'
    WHEN o % 89 = 0 THEN 'date.not_date=soon' WHEN per = 0 THEN 'measurements.empty=' || fac END AS reject_reason,
  fac AS facility_id, seen AS observed_at_us,
  CASE WHEN down THEN NULL WHEN n % 2 <> 0 THEN 'At 7:00 am' ELSE 'At 7:15 am' END AS provider_update_label,
  CAST(CASE WHEN down THEN 0 ELSE per * lanes END AS BIGINT) AS n_measurements,
  CAST(CASE WHEN down OR NOT usable OR NOT w THEN 0 ELSE lanes END AS BIGINT) AS n_waits,
  CASE WHEN NOT down AND usable AND w THEN CAST(q AS DOUBLE) END AS first_wait,
  CASE WHEN len(parts) = 0 THEN '' ELSE array_to_string(parts, '|') END AS readings FROM z"""

_SQL["aircraft_feed"] = f"""WITH {AIRCRAFT}
SELECT e AS poll_id, reason AS reject_reason,
  'adsb-lol:' || hex || ':' || CASE WHEN seen % 1000000 = 0 THEN strftime(make_timestamp(seen), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(make_timestamp(seen), '%Y-%m-%dT%H:%M:%S.%gZ') END AS observation_id,
  'aircraft:' || hex AS entity_id, entity_type, CASE WHEN freight THEN 'inferred' ELSE 'unknown' END AS classification, lat AS latitude, lon AS longitude,
  alt AS altitude_meters, gs AS speed_knots, track AS heading_degrees, seen AS observed_at_us, CASE WHEN mlat THEN 'approximate' ELSE 'exact' END AS position_accuracy FROM air"""
_SQL["aircraft_polls"] = f"""WITH {AIRCRAFT}
SELECT e AS poll_id, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected,
  max(seen) FILTER (reason IS NULL) AS last_observation_at_us, CASE WHEN count(*) FILTER (reason IS NULL) = 0 THEN 'failure' ELSE 'ok' END AS status FROM air GROUP BY 1"""
_SQL["aircraft_count"] = f"""WITH {AIRCRAFT}, {_windows(W3)},
f AS (SELECT * FROM air WHERE {_FLOWN}),
g AS (SELECT p.profile_id, w.window_id, w.s, w.e FROM win w, (VALUES ('lax-cargo-air'), ('suez-canal-approaches')) p(profile_id))
SELECT g.profile_id, g.window_id, nullif(count(f.e), 0) AS value, count(f.e) AS sample_count, count(*) FILTER (f.entity_type = 'aircraft') AS freight_rows,
  count(*) FILTER (f.entity_type = 'unknown') AS unclassified_rows, CASE WHEN count(f.e) = 0 THEN 'unknown' ELSE 'fresh' END AS state
FROM g LEFT JOIN f ON g.profile_id = 'lax-cargo-air' AND f.seen BETWEEN g.s AND g.e GROUP BY g.profile_id, g.window_id"""
_SQL["freight_callsign"] = """WITH c AS (
  SELECT upper(substr(substr(c_mktsegment, 1, 3) || c_custkey, 1, 3)) AS p FROM customer
  UNION ALL SELECT ['FDX','UPS','DLH','GTI','AF' || (user_id % 10),'BAW','BOX'][event_id % 7 + 1] FROM events WHERE event_id % 103 <> 0
  UNION ALL SELECT NULL FROM events)
SELECT coalesce(p IN ('FDX','UPS','GTI','CLX','CKS','ABX','ATN','BOX'), false) AS freight, count(*) AS rows FROM c GROUP BY 1"""
_SQL["redact_text"] = r"""WITH l AS (
  SELECT 'ev-' || event_id AS line_id, CASE event_id % 4 WHEN 0 THEN 'GET /api?token=abc' || event_id || '&x=1 ok' WHEN 1 THEN 'auth bearer  tok' || event_id || ' "done"'
    WHEN 2 THEN 'key sk-abcdef_' || event_id || '; task-sk-1 left' ELSE 'plain line ' || event_id END AS text FROM events
  UNION ALL SELECT 'doc-' || doc_id, text FROM documents),
r AS (SELECT line_id, text, regexp_replace(regexp_replace(regexp_replace(text, '([?&](?:key|apikey|api_key|token|authorization)=)[^&\s"]+', '\1<redacted>', 'gi'),
  '\bsk-[A-Za-z0-9_-]{8,}\b', '<redacted>', 'g'), '\bBearer\s+[^\s"]+', '<redacted>', 'gi') AS clean FROM l)
SELECT line_id, md5(clean) AS redacted_md5, clean <> text AS changed FROM r"""

# --- claims and questions -------------------------------------------------------------------

CLAIM_ROWS = """
ce AS (
  SELECT 'u' || user_id || '-d' || strftime(ts, '%Y%m%d') AS bundle_id, 'c-' || event_id AS claim_id, event_id AS e,
    CASE event_id % 12 WHEN 0 THEN 'A suspicious stop was seen at berth ' || user_id
      WHEN 1 THEN 'Waits grew because of fog, now ' || printf('%.2f', value) WHEN 2 THEN 'The queue will rise to ' || printf('%.2f', value)
      WHEN 3 THEN 'The beneficial owner is not known' WHEN 4 THEN 'The vessel intends to anchor'
      WHEN 5 THEN 'All vessels at the port: ' || printf('%.2f', value) WHEN 6 THEN 'The reading was ' || printf('%.2f', value + 7) || ' minutes'
      WHEN 7 THEN 'At 7:45 on 2024-01-15T10:00:00Z the wait was ' || printf('%.2f', value) WHEN 8 THEN 'The share was ' || printf('%.1f', value * 100)
      ELSE 'The observed value was ' || printf('%.2f', value) || ' in the window' END AS text,
    CASE WHEN event_id % 10 = 0 THEN 'LIMITATION' WHEN event_id % 10 = 1 THEN 'COMPARISON' WHEN event_id % 10 < 6 THEN 'CALCULATION' ELSE 'OBSERVATION' END AS category,
    CASE WHEN event_id % 13 <> 0 THEN 'm-' || event_id END AS support, value FROM events),
cd AS (SELECT 'doc-' || source AS bundle_id, 'd-' || doc_id AS claim_id, doc_id AS e, text, CASE WHEN doc_id % 2 = 0 THEN 'LIMITATION' ELSE 'OBSERVATION' END AS category,
  'doc-' || doc_id AS support FROM documents),
ca AS (SELECT bundle_id, claim_id, e, text, category, support FROM ce UNION ALL SELECT bundle_id, claim_id, e, text, category, support FROM cd)"""
def _rules(pairs, text: str, ignore_case: bool) -> str:
    flag = "(?i)" if ignore_case else ""
    return "CASE " + " ".join(
        f"WHEN regexp_matches({text}, '{flag}{pattern}') THEN '{name}'" for name, pattern in pairs
    ) + " END"


_BANNED = _rules([(category, pattern) for category, pattern, _ in BANNED], "text", True)
_SCOPE = f"regexp_matches(text, '(?i){SCOPE_OVERREACH}')"
_SQL["language_audit"] = f"""WITH {CLAIM_ROWS},
t AS (SELECT 'doc-' || doc_id AS text_id, text FROM documents UNION ALL SELECT 'cv-' || conv_id || '-' || turn, text FROM conversations
  UNION ALL SELECT claim_id, text FROM ce)
SELECT text_id, {_BANNED} AS banned_category, {_SCOPE} AS scope_overreach FROM t"""
_AUDIT = rf""",
nm AS (SELECT bundle_id, claim_id, support, unnest(list_zip(ns, range(len(ns)))) AS p FROM (
  SELECT *, regexp_extract_all(regexp_replace(regexp_replace(text, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?Z', ' ', 'g'), '\b\d{{1,2}}:\d{{2}}\b', ' ', 'g'), '\d+(?:\.\d+)?') AS ns
  FROM ca WHERE category NOT IN ('LIMITATION','QUALITY'))),
vals AS (SELECT DISTINCT 'u' || user_id || '-d' || strftime(ts, '%Y%m%d') AS bundle_id, value FROM events),
open_ AS (SELECT bundle_id, claim_id, p[1] AS number, p[2] AS pos FROM nm WHERE NOT coalesce(contains(support, p[1]), false)),
bad AS (SELECT o.bundle_id, o.claim_id, arg_min(o.number, o.pos) AS unsupported_number FROM open_ o
  WHERE NOT EXISTS (SELECT 1 FROM vals v WHERE v.bundle_id = o.bundle_id AND (abs(v.value - CAST(o.number AS DOUBLE)) < CAST(1e-9 AS DOUBLE) OR abs(v.value * 100 - CAST(o.number AS DOUBLE)) < CAST(0.15 AS DOUBLE)))
  GROUP BY ALL),
judged AS (SELECT ca.*, unsupported_number, coalesce({_BANNED}, CASE WHEN {_SCOPE} THEN 'SCOPE' END, CASE WHEN support IS NULL THEN 'PROVENANCE' END,
  CASE WHEN unsupported_number IS NOT NULL THEN 'NUMERIC' END) AS rejection FROM ca LEFT JOIN bad USING (bundle_id, claim_id))"""
JUDGED = CLAIM_ROWS + _AUDIT
_SQL["numeric_grounding"] = f"WITH {JUDGED} SELECT bundle_id, claim_id, unsupported_number FROM bad"
_SQL["rejection_counts"] = f"WITH {JUDGED} SELECT rejection AS category, count(*) AS rejected FROM judged WHERE rejection IS NOT NULL GROUP BY 1"
_SQL["claim_verdicts"] = f"""WITH {JUDGED},
b AS (SELECT bundle_id, CASE WHEN length(bundle_id) % 2 = 0 THEN 'fresh' ELSE 'STALE' END AS source_health, count(*) FILTER (rejection IS NULL) AS accepted,
  count(*) FILTER (rejection IS NOT NULL) AS rejected, bool_or(category = 'COMPARISON') AS caveat_baseline, bool_or(category = 'CALCULATION') AS caveat_coverage FROM judged GROUP BY 1)
SELECT *, source_health <> 'fresh' AS caveat_source, false AS caveat_empty,
  CASE WHEN accepted = 0 THEN 'rejected' WHEN rejected > 0 OR source_health <> 'fresh' OR caveat_baseline OR caveat_coverage THEN 'accepted_with_caveats' ELSE 'accepted' END AS verdict FROM b"""
# Document claims with a phrase planted by doc_id, or without support: the plant is the label.
_PHRASE = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{said} '" for i, (_, said) in enumerate(PLANTED_PHRASES)) + " ELSE '' END"
_PLANTED = CLAIM_ROWS.replace("doc_id AS e, text,", f"doc_id AS e, {_PHRASE} || coalesce(text, '') AS text,").replace(
    "'doc-' || doc_id AS support", "CASE WHEN doc_id % 7 <> 6 THEN 'doc-' || doc_id END AS support"
)
_PLANT = "CASE e % 7 " + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(PLANTED_PHRASES)) + " ELSE 'PROVENANCE' END"
_SQL["groundedness"] = f"""WITH {_PLANTED + _AUDIT},
x AS (SELECT category, coalesce(rejection, 'accepted') AS actual, CASE WHEN claim_id LIKE 'd-%' THEN {_PLANT} ELSE
    CASE e % 12 WHEN 0 THEN 'THREAT' WHEN 1 THEN 'CAUSE' WHEN 2 THEN 'PREDICTION' WHEN 3 THEN 'IDENTITY'
    WHEN 4 THEN 'INTENT' WHEN 5 THEN 'SCOPE' ELSE CASE WHEN e % 13 = 0 THEN 'PROVENANCE' WHEN e % 12 = 6 AND category <> 'LIMITATION' THEN 'NUMERIC' ELSE 'accepted' END END END AS expected
  FROM judged)
SELECT category, count(*) AS cases, count(*) FILTER (expected = actual) AS passed, count(*) FILTER (expected = actual) / CAST(count(*) AS DOUBLE) AS pass_rate FROM x GROUP BY 1"""

_TOOLS = [(tool, pattern) for tool, patterns in TOOL_PATTERNS for pattern in patterns]
_PLACES = [
    ("long-beach-approach", r"long-beach-approach|\blos angeles long beach\b|\bangeles\b|\bbeach\b"),
    ("singapore-malacca-approach", r"singapore-malacca-approach|\bsingapore\b|\bmalacca\b|\bapproach\b"),
    ("suez-canal-approaches", r"suez-canal-approaches|\bsuez\b|\bcanal\b|\bapproaches\b"),
    ("lax-cargo-air", r"lax-cargo-air|\bcargo\b"),
    ("el-paso-border-crossings", r"el-paso-border-crossings|\bpaso\b|\bborder\b|\bcrossings\b"),
]
_METRICS = [(m, m.replace("_", " ")) for m in WATCH_METRICS] + METRIC_PATTERNS
_ASKED = "[" + ",".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS) + "]"
ROUTED = rf"""
qs AS (SELECT 'cv-' || conv_id || '-' || turn AS question_id, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'ev-' || event_id, {_ASKED}[event_id % {len(QUESTIONS)} + 1] FROM events),
q1 AS (SELECT *, trim(text) AS t, lower(trim(text)) AS lt FROM qs),
q2 AS (SELECT *, {_rules(_TOOLS, 't', True)} AS tool0, {_rules(_PLACES, 'lt', False)} AS place0 FROM q1),
q3 AS (SELECT *, CASE WHEN t = '' THEN 'question.blank' WHEN tool0 IS NULL THEN 'intent.none'
    WHEN tool0 NOT IN ('explain_metric','set_time_window','start_replay','stop_replay') AND place0 IS NULL
      AND NOT regexp_matches(lt, '\b(current|this|here)\b') THEN 'profile.none' END AS abstention FROM q2),
rt AS (SELECT question_id, text, abstention, CASE WHEN abstention IS NULL THEN tool0 END AS tool, CASE WHEN abstention IS NULL THEN place0 END AS profile_id,
  CASE WHEN abstention IS NULL THEN {_rules(WINDOW_PATTERNS, 'lt', False)} END AS relative,
  CASE WHEN abstention IS NULL THEN coalesce({_rules(_METRICS, 'lt', False)}, CASE WHEN tool0 = 'compare_with_baseline' THEN 'vessel_count' END) END AS metric FROM q3)"""
_SQL["route_questions"] = f"WITH {ROUTED} SELECT question_id, abstention, tool, profile_id, relative, metric FROM rt"
_RUN = [("context", "2024-01-15", "2024-01-22"), ("last_24_hours", "2024-01-21", "2024-01-22"), ("last_3_days", "2024-01-19", "2024-01-22"),
        ("last_6_hours", "2024-01-21 18:00:00", "2024-01-22")]
BUNDLES = ROUTED + """,
ctx AS (SELECT *, CASE WHEN length(question_id) % 2 = 0 THEN 'long-beach-approach' END AS cp FROM rt),
b0 AS (SELECT question_id, text, tool, CASE WHEN abstention IS NULL THEN coalesce(profile_id, cp) END AS profile_id,
  CASE WHEN abstention IS NULL AND coalesce(profile_id, cp) IS NOT NULL THEN coalesce(relative, 'context') END AS window_id,
  CASE WHEN abstention IS NOT NULL THEN abstention WHEN coalesce(profile_id, cp) IS NULL THEN 'profile.no_context' END AS abstention FROM ctx),
{HEALTH}
hs AS (SELECT DISTINCT source_id, CASE CAST(substr(source_id, 5) AS INT) % 5 WHEN 0 THEN 'land' WHEN 1 THEN 'air' ELSE 'sea' END AS mode FROM r),
hj AS (SELECT hs.mode, win.window_id, win.e, h.now_us, h.last, h.state FROM hs CROSS JOIN win LEFT JOIN h ON h.source_id = hs.source_id AND h.now_us <= win.e
  QUALIFY row_number() OVER (PARTITION BY hs.source_id, win.window_id ORDER BY h.now_us DESC NULLS LAST, h.seq DESC) = 1),
hw AS (SELECT mode, window_id, ['FRESH','STALE','DEGRADED','UNAVAILABLE','NEVER_ANSWERED'][max(list_position(['FRESH','STALE','DEGRADED','UNAVAILABLE','NEVER_ANSWERED'],
  CASE WHEN now_us IS NULL THEN 'NEVER_ANSWERED' WHEN state = 'FRESH' AND e - last > 3600000000 THEN 'STALE' ELSE state END))] AS source_health FROM hj GROUP BY ALL),
bun AS (SELECT b0.* EXCLUDE (abstention), coalesce(b0.abstention, CASE WHEN w.mode = 'air' THEN CASE WHEN w.air_rows > 0 THEN 'air.counts_only' ELSE 'air.no_rows' END END) AS abstention,
  w.mode, coalesce(CASE w.mode WHEN 'sea' THEN w.in_fence_rows WHEN 'air' THEN w.air_rows END, 0) AS observations,
  coalesce(w.readings, 0) AS facility_readings, hw.source_health,
  'bundle-' || substr(sha256(text || '|' || coalesce(b0.profile_id, '') || '|' || coalesce(CAST(window_start_us AS VARCHAR), '') || '|' || coalesce(CAST(window_end_us AS VARCHAR), '')), 1, 16) AS bundle_id
  FROM b0 LEFT JOIN wide w ON w.role = 'current' AND w.profile_id = b0.profile_id AND w.window_id = b0.window_id
    LEFT JOIN hw ON hw.mode = w.mode AND hw.window_id = w.window_id)""".replace("{HEALTH}", HEALTH.strip() + ",")
_SQL["evidence_bundles"] = _snap(_RUN) + "," + BUNDLES + """
SELECT question_id, bundle_id, tool, profile_id, window_id, abstention, observations, facility_readings, source_health FROM bun"""
_QUESTIONED = _snap(_RUN) + "," + _compared(1) + "," + CLAIMS + "," + BUNDLES + """,
cmp3 AS (SELECT * REPLACE (CASE WHEN sample_count < 3 THEN 'unknown' ELSE state END AS state,
  CASE WHEN sample_count < 3 THEN 'unknown' ELSE direction END AS direction) FROM cmp),
""" + EAGER.replace("FROM cmp c", "FROM cmp3 c") + r""",
cid AS (SELECT profile_id, window_id, metric, metric_id FROM metrics_ WHERE role = 'current'),
ce AS (SELECT cl.profile_id, cl.window_id, claim_order, claim_id, text, category, NULL AS event_id, metric_id AS cited FROM cl
    JOIN cid ON cid.profile_id = cl.profile_id AND cid.window_id = cl.window_id
      AND cid.metric = CASE WHEN claim_id = 'claim-moving-fraction' THEN 'moving_fraction' ELSE 'vessel_count' END
  UNION ALL SELECT scope, window_id, 10, 'event-' || event_id, event_type || ' rule fired: ' || metric || ' ' ||
    CASE WHEN relative_change IS NULL THEN 'by an unknown change' ELSE CASE WHEN relative_change >= 0 THEN '+' ELSE '-' END ||
      printf('%.1f', floor(abs(relative_change) * 100 * CAST(10 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE)) || '%' END,
    'COMPARISON', event_id, event_id FROM fired
  UNION ALL SELECT profile_id, window_id, 1, 'claim-facility-' || facility_id || CASE WHEN w IS NULL THEN '-unknown' ELSE '-commercial-wait' END,
    CASE WHEN w IS NULL THEN 'commercial_wait at ' || display_name || ': unknown'
      ELSE 'commercial_wait at ' || display_name || ': ' || CAST(w AS BIGINT) || ' min, read ' || strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ') END,
    CASE WHEN w IS NULL THEN 'LIMITATION' ELSE 'OBSERVATION' END, NULL, metric_id FROM ll
  UNION ALL SELECT profile_id, window_id, 1, 'claim-facility-none', 'commercial_wait: unknown, no reading in the window', 'LIMITATION', NULL, profile_id || '.facility'
    FROM wide WHERE mode = 'land' AND role = 'current' AND facilities IS NULL)"""
_SQL["evidence_references"] = _QUESTIONED + """,
asked AS (SELECT DISTINCT profile_id, window_id FROM bun WHERE abstention IS NULL),
refs AS (SELECT profile_id, window_id, 'observation' AS kind, observation_id AS id FROM fan WHERE role = 'current'
  UNION ALL SELECT DISTINCT profile_id, window_id, CASE WHEN event_id IS NULL THEN 'metric' ELSE 'event' END, cited FROM ce
  UNION ALL SELECT DISTINCT profile_id, window_id, 'comparison', 'comparison:' || cited FROM ce WHERE claim_id = 'claim-vessel-count-baseline')
SELECT profile_id, window_id, kind, id FROM refs JOIN asked USING (profile_id, window_id)"""
_SQL["answers"] = _QUESTIONED + r""",
nums AS (SELECT ce.*, unnest(regexp_extract_all(regexp_replace(text, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z', ' ', 'g'), '\d+(?:\.\d+)?')) AS number
  FROM ce WHERE category <> 'LIMITATION'),
vals AS (SELECT profile_id, window_id, value FROM metrics_ WHERE role = 'current' UNION ALL SELECT profile_id, window_id, w FROM ll),
bad AS (SELECT DISTINCT profile_id, window_id, claim_id FROM nums s WHERE NOT contains(cited, number) AND NOT EXISTS (
  SELECT 1 FROM vals v WHERE v.profile_id = s.profile_id AND v.window_id = s.window_id
    AND (abs(v.value - CAST(s.number AS DOUBLE)) < CAST(1e-9 AS DOUBLE) OR abs(v.value * 100 - CAST(s.number AS DOUBLE)) < CAST(0.15 AS DOUBLE)))),
jc AS (SELECT ce.*, bad.claim_id IS NOT NULL AS rejected FROM ce LEFT JOIN bad USING (profile_id, window_id, claim_id)),
sv AS (SELECT b.question_id, j.* FROM bun b JOIN jc j USING (profile_id, window_id) WHERE b.abstention IS NULL AND
  (CASE WHEN claim_id LIKE 'claim-facility-%' THEN b.tool IN ('count_vessels','summarize_profile','show_vessel_cohort','compare_with_baseline','list_recent_changes')
    WHEN event_id IS NOT NULL THEN b.tool = 'list_recent_changes'
    ELSE b.tool IN ('count_vessels','summarize_profile','show_vessel_cohort') OR (b.tool = 'compare_with_baseline' AND j.category IN ('COMPARISON','CALCULATION')) END)),
ag AS (SELECT question_id, count(*) FILTER (NOT rejected) AS accepted, count(*) FILTER (rejected) AS rejected, bool_or(category = 'COMPARISON') AS cb,
  bool_or(category = 'CALCULATION') AS cc, string_agg(text, ' ' ORDER BY claim_order, claim_id) FILTER (NOT rejected) AS texts FROM sv GROUP BY 1),
an AS (SELECT b.question_id, b.tool, coalesce(accepted, 0) AS accepted, coalesce(rejected, 0) AS rejected,
  CASE WHEN b.abstention IS NOT NULL THEN b.abstention ELSE coalesce(texts,
    CASE WHEN tool = 'list_recent_changes' AND coalesce(accepted + rejected, 0) = 0 THEN 'No rule fired in the window.' END, 'No accepted claim covers this question.') END AS answer,
  array_to_string(list_filter([CASE WHEN b.abstention IS NULL AND source_health <> 'fresh' THEN 'source' END, CASE WHEN cb THEN 'baseline' END,
    CASE WHEN cc THEN 'coverage' END, CASE WHEN coalesce(accepted + rejected, 0) = 0 THEN 'empty' END], lambda x: x IS NOT NULL), ',') AS caveats
  FROM bun b LEFT JOIN ag USING (question_id))
SELECT *, CASE WHEN accepted = 0 THEN 'rejected' WHEN rejected > 0 OR caveats <> '' THEN 'accepted_with_caveats' ELSE 'accepted' END AS verdict FROM an"""

# --- streams --------------------------------------------------------------------------------

_SQL["stream_dedupe"] = f"WITH {COPIES} SELECT DISTINCT duplicate_key, entity_id, us AS observed_at_us FROM keyed"
_SQL["stream_sessions"] = f"""WITH {TRACKS}
SELECT entity_id, a AS start_at_us, b AS end_at_us, n AS observed_points FROM trk"""
_SQL["stream_snapshot"] = _snap() + """
SELECT profile_id, window_id, role, in_fence_rows, freight, moving, eligible, dwell_cohort, entries, exits, uncertain FROM wide WHERE mode = 'sea'"""
_SQL["stream_rate_sliding"] = f"""WITH {REQUESTS},
w AS (SELECT route, (epoch_us(ts) // 60000000 - k) * 60000000 AS window_start_us FROM q, range(0, 5) t(k))
SELECT window_start_us, route, count(*) AS events, count(*) / CAST(300 AS DOUBLE) AS per_second FROM w GROUP BY ALL"""
_SQL["stream_retention"] = f"""WITH {OBS},
a AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY received_us DESC, observation_id DESC) <= 5000)
SELECT provider_id, observation_id, received_us AS received_at_us FROM a WHERE received_us >= {_us('2024-01-30')} - 259200000000"""
_SQL["stream_health"] = f"WITH {HEALTH} SELECT source_id, seq, status, last AS last_observation_us, state FROM h"
