"""Operators on small literal tables with exact expected values."""

import contextlib
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from fairlead import schema
from fairlead.operators import claims as C
from fairlead.operators import compare, evaluation, facility, geo, health, metrics, network, ordering, sequence, windows
from fairlead.operators import normalize as N
from fairlead.operators import questions as Q
from fairlead.sources import aircraft, border, fixtures, frames, registry, tables

IN, OUT = (33.675, -118.185), (33.6, -118.28)  # inside / outside the outer anchorage
WIN = [("w", "2026-09-09T12:00:00Z", "2026-09-09T15:20:00Z")]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# --- sequences ---------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [60, 600, 86_400])
def test_tracks_split_on_gaps_strictly_above_the_limit(observe, chunk):
    obs = observe([(f"o{i}", "a", m, *OUT) for i, m in enumerate([0, 5, 10, 190, 195])])
    two = rows(sequence.track_segments(obs, 1800, chunk).select("observed_points", "largest_gap_seconds"), "observed_points")
    assert two == [(2, 300.0), (3, 300.0)]
    one = rows(sequence.track_segments(obs, 10_800, chunk).select("observed_points", "largest_gap_seconds"), "observed_points")
    assert one == [(5, 10_800.0)]


def test_tracks_do_not_depend_on_chunks_or_input_order(spark, observe):
    rng = random.Random(7)
    data = [(f"o{i}", f"e{rng.randrange(5)}", rng.randrange(5000), *OUT) for i in range(300)]
    obs = observe(data)
    base = sorted(map(tuple, sequence.track_segments(obs, 1800).collect()))
    for chunk, parts in ((60, 1), (3600, 7), (200_000, 3)):
        shuffled = obs.orderBy(F.rand(1)).repartition(parts)
        assert sorted(map(tuple, sequence.track_segments(shuffled, 1800, chunk).collect())) == base


@pytest.mark.parametrize("chunk", [60, 86_400])
def test_entry_exit_counts_crossings_and_uncertain_gaps(spark, observe, chunk):
    fence = registry.fences(spark).filter("fence_id = 'outer-anchorage'")
    wins = windows.windows(spark, WIN)
    obs = observe([("1", "a", 0, *OUT), ("2", "a", 12, *IN), ("3", "a", 24, *IN), ("4", "a", 40, *OUT)])
    flagged = geo.flag_inside(obs, fence)
    assert rows(sequence.entry_exit(flagged, wins, [], 3600, chunk), "window_id") == [("w", 1, 1, 0)]
    late = geo.flag_inside(observe([("1", "a", 0, *OUT), ("2", "a", 90, *IN)]), fence)
    assert rows(sequence.entry_exit(late, wins, [], 3600, chunk), "window_id") == [("w", 0, 0, 1)]


def test_dwell_keeps_the_longest_then_earliest_visit(spark, observe):
    wins = windows.windows(spark, WIN)
    obs = observe([("1", "a", 0, *IN), ("2", "a", 10, *IN), ("3", "a", 100, *IN), ("4", "a", 110, *IN), ("5", "b", 3, *IN)])
    got = rows(sequence.dwell_per_entity(obs, wins, [], None, 2, 3600, 1800).select(
        "entity_id", "dwell_seconds", "observation_count", "largest_gap_seconds"), "entity_id")
    assert got == [("a", 600.0, 2, 600.0)]
    with pytest.raises(ValueError):
        sequence.dwell_per_entity(obs, wins, [], None, 0)


def test_dwell_accepts_a_membership_column(spark, observe):
    wins = windows.windows(spark, WIN)
    obs = observe([("1", "a", 0, *IN), ("2", "a", 10, *OUT), ("3", "a", 20, *IN)])
    got = sequence.dwell_per_entity(obs, wins, [], F.col("latitude") > 33.65, 2, 3600).first()
    assert (got["dwell_seconds"], got["observation_count"]) == (1200.0, 2)


def test_last_classification_wins_and_changes_are_counted(observe):
    kinds = ["cargo_vessel", "cargo_vessel", "tanker", "unknown"]
    obs = observe([(f"o{i}", "a", i, *OUT, {"entity_type": k, "classification": "confirmed" if i < 3 else "unknown"})
                   for i, k in enumerate(kinds)])
    got = sequence.cohorts(sequence.entity_classifications(obs, chunk_seconds=60)).first()
    assert (got["bucket"], got["decided_by"], got["classification_changes"]) == ("unclassified", "o3", 2)


# --- order and duplicates ----------------------------------------------------------------


def test_duplicates_by_reference_and_by_rounded_place(observe):
    obs = observe([
        ("b", "a", 0, 33.5, -118.2, {"record_ref": "r1"}), ("a", "a", 0, 33.5, -118.2, {"record_ref": "r1"}),
        ("c", "z", 5, 33.500001, -118.2), ("d", "z", 5, 33.500004, -118.2), ("e", "z", 5, 33.50002, -118.2),
    ])
    assert [r[0] for r in rows(ordering.dedupe_observations(obs).select("observation_id"), "observation_id")] == ["a", "c", "e"]
    assert tuple(ordering.duplicates_removed(obs).first()) == (5, 3, 2)


def test_bounded_topk_orders_by_priority_then_id(spark):
    df = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 1.0), ("g", "c", 5.0), ("h", "x", 0.0)], "g string, id string, priority double")
    got = rows(ordering.bounded_topk(df, ["g"], 2).select("g", "id", "rank", "considered", "dropped"), "g", "rank")
    assert got == [("g", "c", 1, 3, 1), ("g", "a", 2, 3, 1), ("h", "x", 1, 1, 0)]
    with pytest.raises(ValueError):
        ordering.bounded_topk(df, ["g"], -1)


def test_selection_stability(spark):
    left = spark.createDataFrame([("g", 1), ("g", 2), ("h", 1)], "g string, id int")
    right = spark.createDataFrame([("g", 2), ("g", 1), ("h", 3)], "g string, id int")
    assert rows(ordering.cohort_stability(left, right, ["g"]).select("g", "stable"), "g") == [("g", True), ("h", False)]


# --- space -------------------------------------------------------------------------------


def _fence(spark, ring, **over):
    from fairlead import schema

    base = {"profile_id": "p", "position": 0, "fence_id": "f", "purpose": "approach-flow", "geometry_version": "v1",
            "geometry_status": "reviewed", "review_owner": "o", "effective_date": "2026-09-09", "inclusion_rule": "i",
            "rationale": "r", "ring": [{"lat": a, "lon": b} for a, b in ring], "coverage_hint": "covered", **over}
    return registry.local_table(spark, [base], schema.FENCE)


CONCAVE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0)]


def test_fences_drawn_alike_share_their_totals(spark, observe, monkeypatch):
    import functools

    square = [(0.0, 0.0), (1.5, 0.0), (1.5, 1.5), (0.0, 1.5)]
    drawn = [("a", "p", CONCAVE), ("b", "p", CONCAVE), ("b", "q", square), ("c", "q", CONCAVE), ("c", "r", CONCAVE), ("d", "q", CONCAVE),
             ("e", "p", square), ("e", "r", CONCAVE)]
    fences = functools.reduce(lambda x, y: x.unionByName(y), [_fence(spark, ring, fence_id=f, profile_id=p) for f, p, ring in drawn])
    obs = observe([(str(i), f"v{i % 7}", i, (i % 13) / 3 + 0.01, (i % 17) / 4 + 0.02) for i in range(400)])
    plain = geo.fence_membership(obs, fences).groupBy("fence_id").agg(
        F.count("*").alias("rows"), F.count_distinct("entity_id").alias("entities"), F.max("observed_at").alias("newest"))
    met, member = [], geo.fence_membership
    monkeypatch.setattr(geo, "fence_membership", lambda o, f, *rest: met.append(f) or member(o, f, *rest))
    assert rows(geo.fence_totals(obs, fences), "fence_id") == rows(plain, "fence_id")
    # Of a and d one is met, and of b and e, whose rings are the same in another order.
    assert met[0].select("fence_id").distinct().count() == 3


@pytest.mark.parametrize("limit", [200_000, 0])
def test_concave_ring_by_broadcast_and_by_salted_shuffle(spark, observe, monkeypatch, limit):
    monkeypatch.setattr(geo, "BROADCAST_BYTES", limit)
    obs = observe([("in", "a", 0, 1.0, 1.0), ("notch", "a", 1, 2.0, 3.5), ("arm", "a", 2, 3.5, 3.0), ("far", "a", 3, 9.0, 9.0)])
    fence = _fence(spark, CONCAVE)
    assert rows(geo.flag_inside(obs, fence).select("observation_id", "inside"), "observation_id") == [
        ("arm", True), ("far", False), ("in", True), ("notch", False)]
    assert geo.fence_membership(obs, fence).count() == 2
    assert geo.profile_membership(obs, fence).count() == 2


def test_fence_boxes_reach_the_scan(spark, observe, tmp_path):
    tables.write_observations(observe([("1", "a", 0, 1.0, 1.0), ("2", "a", 1, 50.0, 50.0)]), str(tmp_path / "t"))
    inside = geo.fence_membership(tables.read_observations(spark, str(tmp_path / "t")), _fence(spark, CONCAVE))
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        inside.explain("formatted")
    pushed = text.getvalue().split("PushedFilters")[1].split("\n")[0]
    assert "LessThanOrEqual(latitude,4.0)" in pushed and "GreaterThanOrEqual(longitude,0.0)" in pushed
    assert [r["observation_id"] for r in inside.collect()] == ["1"]


@pytest.mark.parametrize("over,reason", [
    ({"geometry_status": "placeholder"}, "geometry_status.not_reviewed"), ({"review_owner": "  "}, "review_owner.blank"),
    ({"effective_date": "soon"}, "effective_date.not_date"), ({"inclusion_rule": None}, "rationale.incomplete"),
])
def test_fence_rules(spark, over, reason):
    assert geo.fence_validation(_fence(spark, CONCAVE, **over)).first()["violation"] == reason


def test_ring_rules(spark):
    check = lambda ring: geo.fence_validation(_fence(spark, ring)).first()["violation"]
    assert check(CONCAVE[:3]) == "ring.too_short"
    assert check([(91.0, 0.0), *CONCAVE]) == "ring.latitude_range"
    assert check([(0.0, 181.0), *CONCAVE]) == "ring.longitude_range"
    assert check(CONCAVE) is None


# --- metrics and comparison ----------------------------------------------------------------


def test_vessel_count_uses_the_latest_row_of_entities_seen_inside(spark, observe):
    fence = registry.fences(spark).filter("fence_id = 'outer-anchorage'")
    wins = windows.windows(spark, WIN)
    obs = observe([
        ("1", "a", 0, *IN), ("2", "b", 1, *IN), ("3", "b", 2, *OUT, {"entity_type": "unknown"}),
        ("4", "c", 3, *IN, {"classification": "inferred"}), ("5", "d", 4, *OUT),
    ])
    assert tuple(metrics.vessel_count(obs, fence, wins).first()) == ("w", 1, 1, 1, "fresh")
    none = observe([("1", "a", 0, *OUT)])
    assert tuple(metrics.vessel_count(none, fence, wins).first()) == ("w", 0, 0, 0, "unknown")


def test_moving_fraction_excludes_entities_without_a_speed(spark, observe):
    wins = windows.windows(spark, WIN)
    obs = observe([("1", "a", 0, *IN), ("2", "b", 0, *IN, {"speed_knots": 0.1}), ("3", "c", 0, *IN),
                   ("4", "c", 1, *IN, {"speed_knots": None, "source_state": "stale"})])
    got = metrics.moving_fraction(obs, wins, [], 0.5).first()
    assert (got["eligible"], got["moving"], got["missing_speed"], got["moving_fraction"], got["state"]) == (2, 1, 1, 0.5, "stale")


METRIC = ("profile_id string, mode string, window_id string, role string, metric string, metric_type string, metric_id string, "
          "scope string, value double, unit string, sample_count bigint, state string, window_start timestamp, "
          "window_end timestamp, computed_at timestamp")


def _pair(spark, metric, cur, base, cur_n=10, base_n=10, scope="s", base_unit="u"):
    import datetime as dt

    t = dt.datetime(2026, 9, 9, 16)
    side = lambda role, v, n, unit: (scope, "sea", "w", role, metric, metric, f"{metric}-{role}", scope, v, unit, n, "fresh", t, t, t)
    return spark.createDataFrame([side("current", cur, cur_n, "u"), side("baseline", base, base_n, base_unit)], METRIC)


@pytest.mark.parametrize("cur,base,n,direction,relative", [
    (12.0, 10.0, 5, "increase", 0.2), (10.2, 10.0, 5, "stable", pytest.approx(0.02)), (5.0, 10.0, 5, "decrease", -0.5),
    (3.0, 0.0, 5, "increase", None), (0.0, 0.0, 5, "stable", None), (None, 1.0, 5, "unknown", None), (5.0, 10.0, 0, "unknown", -0.5),
])
def test_baseline_comparison(spark, cur, base, n, direction, relative):
    got = compare.baseline_comparisons(_pair(spark, "moving_fraction", cur, base, n, n)).first()
    assert got["direction"] == direction and got["relative_change"] == relative
    assert (got["state"] == "unknown") == (direction == "unknown")


def test_comparison_of_different_units_is_an_error(spark):
    with pytest.raises(Exception, match="same metric type and unit"):
        compare.baseline_comparisons(_pair(spark, "moving_fraction", 1.0, 1.0, base_unit="other")).collect()


def test_detector_scenarios_and_scores(spark):
    cases = [("A", "dwell_cohort_size", 30.0, 10.0, 10), ("B", "dwell_cohort_size", 11.0, 10.0, 10),
             ("C", "moving_fraction", 0.5, 0.9, 10), ("D", "entry_count", 8.0, 2.0, 8), ("E", "entry_count", 30.0, 5.0, 1)]
    pairs = None
    for scope, metric, cur, base, n in cases:
        one = _pair(spark, metric, cur, base, n, n, scope)
        pairs = one if pairs is None else pairs.unionByName(one)
    events = compare.detect_events(pairs)
    found = rows(events.select("scope", "event_type"), "scope")
    assert found == [("A", "queue_buildup"), ("C", "stoppage"), ("D", "flow_surge")]
    detections = events.select(F.col("event_id").alias("detection_id"), "event_type", "scope", "detected_at",
                               F.lit(1).alias("detection_seq"))
    labels = spark.createDataFrame(
        [("l1", "queue_buildup", "A", "2026-09-09 15:30:00", 1), ("l2", "stoppage", "C", "2026-09-09 15:40:00", 2),
         ("l3", "flow_surge", "D", "2026-09-09 15:50:00", 3), ("l4", "flow_surge", "E", "2026-09-09 15:20:00", 4)],
        "label_id string, event_type string, scope string, onset_at string, label_seq int",
    ).withColumn("onset_at", F.col("onset_at").cast("timestamp"))
    matches = evaluation.match_labels(labels, detections)
    got = evaluation.detector_scores(labels, detections, matches).first()
    assert (got["true_positives"], got["false_positives"], got["false_negatives"]) == (3, 0, 1)
    assert (got["precision"], got["recall"]) == (1.0, 0.75) and got["f1"] == pytest.approx(6 / 7)
    assert got["false_positives_per_entity_hour"] is None and got["mean_latency_seconds"] == 1200.0


def _matched_in_order(labels, dets, limit):
    want, free = set(), list(dets)
    for lid, _, scope, at, _ in sorted(labels, key=lambda x: (x[4], x[0])):
        options = [(abs(d[3] - at), d[4], d[0], d) for d in free if d[2] == scope and abs(d[3] - at) <= limit]
        if options:
            distance, *_, best = min(options)
            want.add((lid, best[0], distance * 1_000_000))
            free.remove(best)
    return want


def _items(spark, data, name, at, seq):
    made = spark.createDataFrame(data, f"{name} string, event_type string, scope string, at bigint, {seq} int")
    return made.withColumn(at, F.timestamp_seconds("at"))


@pytest.mark.parametrize("chunk", [86_400, 1_000, 1])
def test_label_matching_equals_the_sequential_rule(spark, chunk):
    rng = random.Random(3)
    order = rng.sample(range(240), 240)
    labels = [(f"l{i}", "t", f"s{rng.randrange(3)}", rng.randrange(40_000), order[i]) for i in range(120)]
    dets = [(f"d{i}", "t", f"s{rng.randrange(3)}", rng.randrange(40_000), order[-1 - i]) for i in range(120)]
    # A run without a gap, more labels than detections, and a crowd at one instant beside few detections.
    labels += [(f"m{i}", "t", "run", rng.randrange(0, 6_000, 20), i) for i in range(240)]
    dets += [(f"e{i}", "t", "run", rng.randrange(0, 6_000, 20), rng.randrange(1 << 30)) for i in range(200)]
    labels += [(f"n{i}", "t", "crowd", 5_000, 40 - i) for i in range(40)]
    dets += [(f"f{i}", "t", "crowd", 4_985 + i, i) for i in range(30)]
    got = evaluation.match_labels(_items(spark, labels, "label_id", "onset_at", "label_seq"),
                                  _items(spark, dets, "detection_id", "detected_at", "detection_seq"), 200, chunk)
    assert sorted(tuple(r) for r in got.collect()) == sorted(_matched_in_order(labels, dets, 200))


def test_label_matching_without_ids_numbers_or_rows(spark):
    labels = [("l1", "t", "s", 100, None), ("l2", "t", "s", 100, 7), (None, "t", "s", 100, 1), ("l3", None, "s", 100, 2), ("l4", "t", "s", None, 3)]
    dets = [("d1", "t", "s", 110, None), ("d2", "t", "s", 90, 4), (None, "t", "s", 100, 1)]
    make = lambda a, b: evaluation.match_labels(_items(spark, a, "label_id", "onset_at", "label_seq"),
                                                _items(spark, b, "detection_id", "detected_at", "detection_seq"), 60)
    assert sorted(tuple(r) for r in make(labels, dets).collect()) == [("l1", "d1", 10_000_000), ("l2", "d2", 10_000_000)]
    assert make(labels, []).count() == make([], dets).count() == 0


def test_watches(spark):
    metrics_df = _pair(spark, "vessel_count", 12.0, 10.0).unionByName(_pair(spark, "entry_count", 5.0, 1.0))
    comparisons = compare.baseline_comparisons(metrics_df)
    w = "id string, profile_id string, metric string, watch_direction string, pct_threshold double, freshness_policy string"
    watches = spark.createDataFrame([
        ("a", "s", "vessel_count", "increase", 20.0, "require-fresh"), ("b", "s", "vessel_count", "increase", 25.0, "allow-stale"),
        ("c", "s", "vessel_count", "decrease", 5.0, "allow-stale"), ("d", "s", "entry_count", "increase", 5.0, "allow-stale"),
        ("e", "nowhere", "vessel_count", "increase", 5.0, "allow-stale")], w)
    got = rows(network.evaluate_watches(watches, metrics_df, comparisons).select("id", "status"), "id")
    assert got == [("a", "fired"), ("b", "clear"), ("c", "clear"), ("d", "unknown"), ("e", "unavailable")]


# --- sources -----------------------------------------------------------------------------


def _frame(kind, typed, meta=None):
    return json.dumps({"MessageType": kind, "MetaData": {"MMSI": 7, "latitude": 1.0, "longitude": 2.0,
                       "time_utc": "2026-09-09 13:59:41.341 +0000 UTC", **(meta or {})}, "Message": {kind: typed}})


def test_position_frames(spark):
    cases = [
        ("a", _frame("PositionReport", {"SOG": 102.3, "COG": 360, "Heading": 511, "Latitude": 3.5, "Longitude": 4.5})),
        ("b", _frame("PositionReport", {"SOG": 9.5, "COG": 90.5, "Heading": 511}, {"time_utc": "2026-09-09 15:59:41.3 +0200 UTC"})),
        ("c", _frame("PositionReport", {}, {"MMSI": 1.5})), ("d", _frame("PositionReport", {"UserID": 9}, {"MMSI": None})),
        ("e", _frame("BaseStationReport", {})), ("f", _frame("ShipStaticData", {"Type": 74})), ("g", "{nope"),
        ("h", _frame("PositionReport", {"Latitude": "3"})), ("i", _frame("PositionReport", {}, {"time_utc": "soon"})),
        ("j", _frame("PositionReport", {"Latitude": 95.0})), ("k", json.dumps({"MessageType": "PositionReport", "Message": {}})),
    ]
    df = spark.createDataFrame(cases, "k string, frame string")
    got = {r["k"]: r for r in frames.normalize_frames(df).collect()}
    assert [got[k]["kind"] for k in "abcdefghijk"] == [
        "observation", "observation", "invalid", "observation", "unsupported", "classification-update", "invalid",
        "invalid", "invalid", "invalid", "invalid"]
    a, b = got["a"], got["b"]
    assert (a["latitude"], a["longitude"], a["speed_knots"], a["heading_degrees"]) == (3.5, 4.5, None, None)
    assert a["observation_id"] == "aisstream:mmsi-7:2026-09-09T13:59:41.341Z" and a["entity_id"] == "aisstream:7"
    assert (b["latitude"], b["heading_degrees"], b["observation_id"]) == (1.0, 90.5, "aisstream:mmsi-7:2026-09-09T13:59:41.300Z")
    assert got["d"]["mmsi"] == 9 and (got["f"]["static_type"], got["f"]["static_classification"]) == ("cargo_vessel", "confirmed")
    assert got["j"]["reject_reason"] == "position.range" and got["i"]["reject_reason"] == "time_utc.not_time=soon"


def test_static_reports_stamp_later_positions_by_arrival(spark):
    data = [(1, 1, "position", None, None), (1, 2, "static", "tanker", "confirmed"), (1, 3, "position", None, None),
            (1, 4, "static", "unknown", "unknown"), (1, 5, "position", None, None), (2, 6, "position", None, None)]
    df = spark.createDataFrame(data, "mmsi bigint, arrival_seq bigint, kind string, entity_type string, classification string").withColumn(
        "received_at", F.timestamp_seconds(F.col("arrival_seq") * 1000))
    for chunk in (500, 86_400):
        got = rows(sequence.asof_classification(df, chunk).select("arrival_seq", "entity_type"), "arrival_seq")
        assert got == [(1, "unknown"), (3, "tanker"), (5, "unknown"), (6, "unknown")]


def test_border_documents(spark):
    lane = lambda status, delay, lanes, label="": {"update_time": label, "operational_status": status, "delay_minutes": delay, "lanes_open": lanes}
    base = {"port_name": "El Paso", "date": "9/10/2026", "time": "07:36:42", "port_status": "Open"}
    pending = {**base, "port_number": "240202", "crossing_name": "Paso Del Norte", "commercial_vehicle_lanes": {"standard_lanes": lane("Update Pending", "", "")}}
    good = {**base, "port_number": "240201", "crossing_name": "Bridge of the Americas",
            "commercial_vehicle_lanes": {"standard_lanes": lane("no delay", "3", "2", "At 8:00 am MDT"), "FAST_lanes": lane("delay", "x", "4")},
            "pedestrian_lanes": {"ready_lanes": lane("N/A", "1", "1")}}
    polls = spark.createDataFrame([("p", json.dumps([pending, good])), ("q", "{}")], "poll string, document string").withColumn(
        "received_at", F.lit("2026-09-10T08:00:00Z").cast("timestamp"))
    out = border.transform_crossings(border.crossing_rows(polls))
    ok = out.filter("reject_reason is null").first()
    assert ok["facility_id"] == "cbp:240201:bridge" and ok["metric_id"] == "cbp:240201:bridge:2026-09-10T07:36:42Z"
    assert ok["provider_update_label"] == "At 8:00 am MDT"
    assert [(m["lane_group"], m["metric"], m["value"]) for m in ok["measurements"]] == [
        ("commercial_vehicle", "wait_minutes", 3.0), ("commercial_vehicle", "lanes_open", 2.0),
        ("commercial_vehicle", "operational_status", None), ("fast", "lanes_open", 4.0)]
    outcome = {r["poll"]: r["status"] for r in N.ingest_outcome(out, ["poll"]).collect()}
    assert outcome == {"p": "partial", "q": "failure"}
    assert facility.commercial_waits(out.filter("reject_reason is null")).first()["commercial_wait_minutes"] == 3.0


def test_border_lanes_and_dates_are_read_once(spark):
    lane = {"update_time": "", "operational_status": " delay ", "delay_minutes": " 7 ", "lanes_open": "x"}
    crossing = {"port_number": "1", "port_name": "P", "crossing_name": "", "date": "1/2/2024", "time": "07:30:00",
                "commercial_vehicle_lanes": {"FAST_lanes": lane, "standard_lanes": None}}
    polls = spark.createDataFrame([(json.dumps([crossing]),)], "document string").withColumn("received_at", F.lit("2024-01-03T00:00:00Z").cast("timestamp"))
    out = border.transform_crossings(border.crossing_rows(polls))
    row = out.first()
    assert [tuple(m) for m in row["measurements"]] == [("fast", "wait_minutes", 7.0, "minutes", "delay")] and row["reject_reason"] is None
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain("extended")
    optimized = text.getvalue().split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    # One test for digits per lane value and container, one split of the date.
    assert optimized.count("^[0-9]+$") == 6 and optimized.count(", /, -1)") == 1


def test_aircraft_record_is_read_once(spark):
    good = {"hex": "a", "flight": "FDX1", "type": "mlat", "lat": 1, "lon": 2.5, "track": 5}
    records = [good, {**good, "lat": "1"}, {**good, "track": "5"}, {**good, "hex": 5}, {**good, "track": 360}, [1], 5]
    polls = spark.createDataFrame([(json.dumps({"ac": records}),)], "document string").withColumn("received_at", F.lit("2024-01-03T00:00:00Z").cast("timestamp"))
    out = aircraft.transform_aircraft(aircraft.aircraft_rows(polls))
    bad = "record.incomplete"
    assert [r["reject_reason"] for r in out.collect()] == [None, bad, None, bad, "heading_degrees.range", bad, bad]
    assert [r["heading_degrees"] for r in out.collect()][:3] == [5.0, 5.0, None]
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain("extended")
    assert not [p for p in ("hex", "lat", "lon", "track") if f"$.{p}" in text.getvalue()]


def test_aircraft_documents(spark):
    doc = json.dumps({"ac": [{"hex": " A1B2 ", "flight": "fdx12 ", "lat": 33.8, "lon": -118.4, "alt_baro": 1000, "gs": 250.5, "seen_pos": 0.4,
                              "type": "mlat"}, {"hex": "c3", "lat": 33.8, "lon": -118.4, "alt_baro": "ground"}, {"lat": 1, "lon": 2}]})
    polls = spark.createDataFrame([("p", doc)], "poll string, document string").withColumn(
        "received_at", F.lit("2026-09-09T14:00:00Z").cast("timestamp"))
    got = aircraft.transform_aircraft(aircraft.aircraft_rows(polls)).orderBy(F.col("observation_id").asc_nulls_last()).collect()
    a, b, c = got
    assert a["observation_id"] == "adsb-lol:a1b2:2026-09-09T13:59:59Z" and a["altitude_meters"] == 305.0
    assert (a["entity_type"], a["classification"], a["position_accuracy"]) == ("aircraft", "inferred", "approximate")
    assert b["altitude_meters"] is None and b["entity_type"] == "unknown" and b["observed_at"] == b["received_at"]
    assert c["reject_reason"] == "record.incomplete"


GOOD = {"observationId": "1", "entityId": "e", "mode": "sea", "entityType": "tanker", "position": {"latitude": 1.0, "longitude": 2},
        "kinematics": {}, "observedAt": "2026-09-09T12:00:00Z", "receivedAt": "2026-09-09T12:00:01.5+02:00",
        "source": {"providerId": "p", "endpointId": "e", "licenseId": "l"}, "quality": {"sourceState": "fresh", "classification": "confirmed"}}


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"observationId": ""}, "observation_id.blank"), ({"mode": None}, "mode.unlisted=null"),
    ({"entityType": "yacht"}, "entity_type.unlisted=yacht"), ({"position": 5}, "position.absent"),
    ({"position": {"latitude": "12", "longitude": 1}}, "latitude.range"),
    ({"position": {"latitude": 1, "longitude": 200}}, "longitude.range"),
    ({"kinematics": {"speedKnots": None}}, "speed_knots.not_number"), ({"kinematics": {"headingDegrees": 360}}, "heading_degrees.range"),
    ({"observedAt": "yesterday"}, "observed_at.not_time"),
    ({"source": {"providerId": "p", "endpointId": "e"}}, "license_id.blank"),
    ({"source": {"providerId": "p", "endpointId": "e", "licenseId": "l", "recordRef": 5}}, "record_ref.not_text"),
    ({"quality": {"sourceState": "fresh", "classification": "sure"}}, "classification.unlisted=sure"),
    ({"quality": {"sourceState": "fresh", "classification": "confirmed", "positionAccuracy": None}}, "position_accuracy.unlisted=null"),
])
def test_first_failing_check_is_the_reason(spark, change, reason):
    df = spark.createDataFrame([(json.dumps({**GOOD, **change}),)], "raw string")
    assert N.normalize_observations(df).first()["reject_reason"] == reason


READING = {"metricId": "m", "facilityId": "f", "facilityType": "border-crossing", "displayName": "d", "mode": "land",
           "observedAt": "2026-09-10T07:00:00Z", "receivedAt": "2026-09-10T07:00:00Z",
           "measurements": [{"laneGroup": "fast", "metric": "wait_minutes", "value": 3}],
           "source": {"providerId": "p", "endpointId": "e", "licenseId": "l"}}


@pytest.mark.parametrize("change,reason", [
    ({}, None), ({"mode": "sea"}, "mode.unlisted=sea"), ({"receivedAt": "2026-09-10T06:59:59Z"}, "observed_at.after_received"),
    ({"location": {"latitude": 95, "longitude": 0}}, "latitude.range"),
    ({"measurements": []}, "measurements.empty"),
    ({"measurements": [{"laneGroup": "all", "metric": "wait_minutes", "value": 3}]}, "lane_group.unlisted=all"),
    ({"measurements": [{"laneGroup": "fast", "metric": "wait_minutes", "value": -1}]}, "wait_minutes.negative"),
    ({"measurements": [{"laneGroup": "fast", "metric": "lanes_open", "value": 1.5}]}, "lanes_open.not_whole"),
    ({"measurements": [{"laneGroup": "fast", "metric": "wait_minutes"}]}, "value.not_number=undefined"),
    ({"source": None}, "source.absent"),
])
def test_facility_checks(spark, change, reason):
    df = spark.createDataFrame([(json.dumps({**READING, **change}),)], "raw string")
    got = N.normalize_facility(df).first()
    assert got["reject_reason"] == reason and got["source_state"] == "unavailable"


def test_facility_document_is_read_once_as_a_whole(spark):
    odd = [[7], {"laneGroup": "fast", "metric": "wait_minutes", "value": "3"}]
    docs = [json.dumps(READING), json.dumps({**READING, "measurements": odd[:1]}), json.dumps({**READING, "measurements": odd[1:]}),
            json.dumps({**READING, "metricId": 5}), json.dumps([READING]), json.dumps({**READING, "source": []})]
    checked = N.normalize_facility(spark.createDataFrame(list(enumerate(docs)), "i int, raw string"))
    assert [r["reject_reason"] for r in checked.orderBy("i").collect()] == [
        None, "lane_group.unlisted=undefined", "value.not_number=3", "metric_id.blank", "metric_id.blank", "source.incomplete"]
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        checked.explain("extended")
    # No leaf is looked up by its path; only what a rejection shows is.
    leaves = ("metricId", "displayName", "observedAt", "source.providerId", "quality.sourceState")
    assert not [p for p in leaves if f"$.{p}" in text.getvalue()]


def test_manifest_files(spark, tmp_path):
    good = {"fixtureId": "fx", "truthState": "SIMULATED", "simulated": True, "provenance": {"providerId": "simulated-a"},
            "observations": [GOOD, {**GOOD, "entityType": "yacht"}], "facilityMetrics": [READING]}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({**good, "truthState": "OBSERVED"}))
    checked = fixtures.checked_manifests(fixtures.scan_manifests(spark, str(tmp_path)))
    assert rows(checked.select("file", "violation"), "file") == [("a.json", None), ("b.json", "truth_state.not_simulated")]
    assert fixtures.manifest_observations(checked).filter("reject_reason is null").count() == 1
    assert fixtures.manifest_facilities(checked).first()["metric_id"] == "m"
    assert rows(fixtures.dataset_manifest(checked).select("file", "observations"), "file") == [("a.json", 2), ("b.json", 2)]
    with pytest.raises(Exception, match="truth_state"):
        fixtures.checked_manifests(fixtures.scan_manifests(spark, str(tmp_path)), strict=True).select("violation").collect()


def test_observation_table_round_trip(spark, observe, tmp_path):
    obs = observe([("1", "a", 0, *IN), ("2", "a", 24 * 60, *IN)])
    tables.write_observations(obs, str(tmp_path / "t"))
    back = tables.read_observations(spark, str(tmp_path / "t"), "2026-09-10T00:00:00Z", "2026-09-10T12:00:00Z")
    assert [r["observation_id"] for r in back.collect()] == ["2"]
    # Reading leaves the shared schema as it was: validation still works, and a second read too.
    assert N.normalize_observations(spark.createDataFrame([(json.dumps(GOOD),)], "raw string")).first()["reject_reason"] is None
    assert tables.read_observations(spark, str(tmp_path / "t")).count() == 2


def test_windows_prune_date_partitions(spark, observe, tmp_path):
    tables.write_observations(observe([(str(i), "a", i * 24 * 60, *IN) for i in range(5)]), str(tmp_path / "t"))
    wins = windows.windows(spark, [("w", "2026-09-10T00:00:00Z", "2026-09-11T00:00:00Z")])
    pruned = windows.prune_to_windows(tables.read_observations(spark, str(tmp_path / "t")), wins)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        pruned.explain("formatted")
    assert "observed_date" in text.getvalue().split("PartitionFilters")[1].split("\n")[0]
    assert [r["observation_id"] for r in pruned.collect()] == ["1"]


def test_series_and_replay_answer_every_window(spark, observe):
    obs = observe([("1", "a", 0, *IN), ("2", "b", 30, *IN), ("3", "a", 24 * 60, *IN)])
    fence, profiles = registry.fences(spark), registry.profiles(spark)
    both = [("x", "2026-09-09T11:00:00Z", "2026-09-09T13:00:00Z"), ("y", "2026-09-10T11:00:00Z", "2026-09-10T13:00:00Z")]
    for name, call in (("series", lambda w: network.headline_series(obs, fence, profiles, w, 4)),
                       ("replay", lambda w: network.replay_counts(obs, fence, w, 3600, 7200))):
        whole = sorted(map(tuple, call(windows.windows(spark, both)).collect()))
        parts = sorted(tuple(r) for b in both for r in call(windows.windows(spark, [b])).collect())
        assert whole == parts and {r[0] for r in whole} == {"x", "y"}, name
    wins = windows.windows(spark, both)
    asked = spark.createDataFrame([("last_6_hours",)], "relative string").withColumn("reference_at", F.current_timestamp())
    with pytest.raises(Exception, match="more than one"):
        windows.relative_windows(asked, wins).collect()


# --- the other modes -------------------------------------------------------------------------


def readings_of(spark, data):
    """data: id, facility, minute, wait, live."""
    import datetime as dt

    noon = dt.datetime(2026, 9, 9, 12, tzinfo=dt.timezone.utc)
    full = []
    for mid, site, minute, wait, live in data:
        at = noon + dt.timedelta(minutes=minute)
        lanes = [{"lane_group": "passenger_vehicle", "metric": "wait_minutes", "value": 99.0, "unit": "minutes", "status_label": ""}]
        if wait != "none":
            lanes.append({"lane_group": "commercial_vehicle", "metric": "wait_minutes", "value": wait, "unit": "minutes", "status_label": ""})
        full.append((mid, site, site, at, at, lanes, live, "el-paso-border-crossings"))
    names = "metric_id string, facility_id string, display_name string, observed_at timestamp, received_at timestamp"
    from fairlead.schema import MEASUREMENT

    shape = f"{names}, measurements array<{MEASUREMENT.simpleString()}>, is_live boolean, profile_id string"
    return spark.createDataFrame(full, shape)


TWO = [("early", "2026-09-09T12:00:00Z", "2026-09-09T13:00:00Z"), ("late", "2026-09-09T14:00:00Z", "2026-09-09T15:00:00Z")]
AIR_IN, AIR_OUT = (33.8, -118.4), (34.5, -118.4)


def snap_of(spark, observe, aircraft_rows=None, readings=None):
    from fairlead.plans import snapshot as S

    return S.snapshot(
        observe([("s1", "ship", 5, *IN)]), registry.profiles(spark), registry.fences(spark), windows.windows(spark, TWO),
        aircraft=None if aircraft_rows is None else observe(aircraft_rows), readings=readings,
    )


def test_land_readings_are_simulated_in_the_window_or_live_whatever_the_window(spark, observe):
    simulated = [("m1", "cbp:1", 10, 3.0, False), ("m2", "cbp:1", 20, 5.0, False), ("m3", "cbp:2", 15, None, False), ("m4", "other:1", 5, 1.0, False)]
    snap = snap_of(spark, observe, readings=readings_of(spark, simulated))
    land = snap.wide.filter("mode = 'land' and role = 'current'").orderBy("window_id").collect()
    # The first facility by time is cbp:2, whose wait is missing: unknown, not zero.
    assert [(r.window_id, r.facilities, r.readings, r.wait_minutes) for r in land] == [("early", 2, 3, None), ("late", None, None, None)]
    assert sorted((r.window_id, r.metric_id) for r in snap.facilities.collect()) == [("early", "m2"), ("early", "m3")]
    assert all(r.in_fence_rows is None and r.count_state == "unknown" for r in land)
    live = [("l1", "cbp:1", -600, 7.0, True), ("l2", "cbp:1", -500, 8.0, True), ("l3", "cbp:2", -550, "none", True)]
    snap = snap_of(spark, observe, readings=readings_of(spark, simulated + live))
    land = snap.wide.filter("mode = 'land' and role = 'current'").orderBy("window_id").collect()
    assert [(r.window_id, r.facilities, r.readings, r.wait_minutes) for r in land] == [("early", 2, 2, None), ("late", 2, 2, None)]
    assert sorted((r.window_id, r.metric_id, r.commercial_wait_minutes) for r in snap.facilities.collect()) == [
        ("early", "l2", 8.0), ("early", "l3", None), ("late", "l2", 8.0), ("late", "l3", None)]
    # Readings never reach the other profiles, and ships never the land profile.
    assert snap.wide.filter("mode <> 'land' and readings is not null").count() == 0
    assert snap.wide.filter("profile_id = 'long-beach-approach' and window_id = 'early' and role = 'current'").first()["in_fence_rows"] == 1


def test_aircraft_are_counted_by_rows_and_none_is_unknown(spark, observe):
    rows_in = [("a1", "plane", 5, *AIR_IN, {"mode": "air", "entity_type": "aircraft"}), ("a2", "plane", 6, *AIR_IN, {"mode": "air", "entity_type": "aircraft"}),
               ("a3", "other", 7, *AIR_IN, {"mode": "air", "entity_type": "unknown"}), ("a4", "away", 8, *AIR_OUT, {"mode": "air"})]
    snap = snap_of(spark, observe, rows_in)
    air = {(r.window_id, r.role): r for r in snap.wide.filter("mode = 'air'").collect()}
    early, late = air["early", "current"], air["late", "current"]
    assert (early.in_fence_rows, early.freight, early.unclassified, early.other, early.count_state) == (3, 2, 1, 0, "fresh")
    assert (late.in_fence_rows, late.count_state) == (0, "unknown") and air["early", "baseline"].in_fence_rows is None
    values = {(r.window_id, r.metric): r for r in snap.metrics.filter("mode = 'air' and role = 'current'").collect()}
    assert values["early", "vessel_count"].value == 3 and values["early", "vessel_count"].state == "fresh"
    assert values["late", "vessel_count"].value is None and values["early", "moving_fraction"].value is None
    assert {r.direction for r in snap.comparisons.filter("profile_id = 'lax-cargo-air'").collect()} == {"unknown"}
    without = snap_of(spark, observe).wide.filter("mode = 'air'").collect()
    assert all(r.in_fence_rows is None and r.count_state == "unknown" for r in without)
    totals = {(r.window_id, r["mode"]): r for r in network.network_totals(snap.wide).collect()}
    assert totals["early", "air"].aircraft_rows == 3 and totals["early", "sea"].aircraft_rows is None
    heads = {(r.profile_id, r.window_id): r.headline for r in network.compare_rows(
        snap.wide, snap.comparisons, snap.events, network.coverage_states(registry.profiles(spark), registry.fences(spark))).collect()}
    assert heads["lax-cargo-air", "early"] == 3 and heads["lax-cargo-air", "late"] is None
    assert heads["long-beach-approach", "early"] == 1 and heads["el-paso-border-crossings", "early"] is None


def test_series_of_the_other_modes(spark, observe):
    land = readings_of(spark, [("m1", "cbp:1", 10, 3.0, False), ("m2", "cbp:1", 50, 5.0, False)])
    planes = observe([("a1", "p", 5, *AIR_IN, {"mode": "air", "entity_type": "aircraft"})])
    wins = windows.windows(spark, TWO[:1])
    got = network.headline_series(observe([("s", "x", 5, *IN)]), registry.fences(spark), registry.profiles(spark), wins, 2, aircraft=planes, readings=land)
    values = {(r.profile_id, r.bucket): r.value for r in got.collect()}
    assert values["el-paso-border-crossings", 0] == 3.0 and values["el-paso-border-crossings", 1] == 5.0
    assert values["lax-cargo-air", 0] == 1.0 and values["lax-cargo-air", 1] is None
    assert values["long-beach-approach", 0] == 1.0 and values["long-beach-approach", 1] == 0.0


def test_land_questions_are_answered_and_air_questions_are_not(spark, observe):
    from fairlead.plans import snapshot as S  # noqa: F401

    land = readings_of(spark, [("m1", "cbp:1", 10, 3.0, False), ("m2", "cbp:2", 20, None, False)])
    snap = snap_of(spark, observe, [("a1", "p", 5, *AIR_IN, {"mode": "air", "entity_type": "aircraft"})], land)
    asked = spark.createDataFrame([("q1", "how long is the wait at el paso?"), ("q2", "vessel count at cargo air"), ("q3", "tell me a joke"), ("q4", "any events at el paso")],
                                  "question_id string, text string")
    health_now = spark.createDataFrame([("land", "early", "STALE"), ("air", "early", "FRESH")], "mode string, window_id string, source_health string")
    routed = Q.route_questions(asked).withColumn("context_profile", F.lit(None).cast("string"))
    bundles = Q.evidence_bundles(routed, snap.wide, context="early", health=health_now)
    held = {r.question_id: r for r in bundles.collect()}
    assert (held["q1"].facility_readings, held["q1"].source_health, held["q2"].observations) == (2, "STALE", 1)
    wanted = snap.wide.filter("role = 'current' and mode = 'land'").select("profile_id", "window_id")
    made = C.facility_claims(snap.facilities, wanted, ["profile_id", "window_id"])
    values = snap.facilities.select("profile_id", "window_id", F.col("commercial_wait_minutes").alias("value"))
    judged = C.judge_claims(made, values, ["profile_id", "window_id"])
    got = {r.question_id: r for r in Q.answers(bundles, judged, "question_id").collect()}
    assert got["q1"].accepted == 2 and "3 min" in got["q1"].answer and "unknown" in got["q1"].answer
    assert (got["q1"].verdict, got["q1"].caveats) == ("accepted_with_caveats", "source") and got["q4"].accepted == 2
    assert (got["q2"].answer, got["q2"].verdict, got["q2"].accepted) == ("air.counts_only", "rejected", 0)
    assert (got["q3"].answer, got["q3"].verdict, got["q3"].caveats) == ("intent.none", "rejected", "empty")
    refs = Q.evidence_references(bundles, spark.createDataFrame([], "profile_id string, window_id string, observation_id string"), made)
    assert sorted((r.kind, r.id) for r in refs.collect()) == [("metric", "m1"), ("metric", "m2")]


def test_answer_texts_do_not_gather_what_they_cite(spark):
    cite = lambda *ids: [("metric", i) for i in ids]
    judged = spark.createDataFrame(
        [("p", "w", 2, "c2", "second", "OBSERVATION", cite("m3"), None), ("p", "w", 1, "c1", "first", "OBSERVATION", cite("m2", "m1"), None),
         ("p", "w", 3, "c3", "third", "OBSERVATION", cite("m4"), "NUMERIC")],
        "profile_id string, window_id string, claim_order int, claim_id string, text string, category string, "
        "support array<struct<kind: string, id: string>>, rejection string")
    bundles = spark.createDataFrame([("q", "b", "count_vessels", "p", "w", None, "fresh")],
                                    "question_id string, bundle_id string, tool string, profile_id string, window_id string, abstention string, source_health string")
    answered = Q.answers(bundles, judged, "question_id")
    row = answered.first()
    assert (row.answer, row.evidence_refs, row.accepted, row.rejected) == ("first second", "metric:m2,metric:m1,metric:m3", 2, 1)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        answered.select("question_id", "answer").explain("extended")
    optimized = text.getvalue().split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    assert "collect_list" in optimized and "support, support" not in optimized


def test_readiness_needs_every_expected_source(spark):
    states = spark.createDataFrame([("a", "s1", "FRESH"), ("a", "s2", "FRESH"), ("b", "s1", "FRESH"), ("b", "s1", "STALE"), ("c", "s1", "STALE"), ("c", "s2", "FRESH")],
                                   "k string, source_id string, state string")
    expected = spark.createDataFrame([(k, s) for k in "abcd" for s in ("s1", "s2")], "k string, source_id string")
    got = {r.k: (r.expected, r.sources, r.reports, r.missing, r.not_fresh, r.ready, r.status) for r in health.readiness_rollup(states, expected, ["k"]).collect()}
    assert got == {"a": (2, 2, 2, 0, 0, True, "ok"), "b": (2, 1, 2, 1, 1, False, "error"), "c": (2, 2, 2, 0, 1, True, "degraded"),
                   "d": (2, 0, 0, 2, 0, False, "error")}


# --- health and claims -----------------------------------------------------------------------


def test_source_health_states(spark):
    t = lambda s: f"2026-09-09 12:{s:02d}:00"
    data = [("s", 1, t(0), "ok", None), ("s", 2, t(1), "ok", t(0)), ("s", 3, t(20), "failure", t(19)), ("s", 4, t(30), "ok", None),
            ("s", 5, t(31), "partial", t(31)), ("s", 6, t(32), "ok", t(10))]
    df = spark.createDataFrame(data, "source_id string, seq bigint, now string, status string, last_observation_at string")
    df = df.withColumn("now", F.col("now").cast("timestamp")).withColumn("last_observation_at", F.col("last_observation_at").cast("timestamp"))
    for chunk in (60, 86_400):
        got = [r["state"] for r in health.source_health(df, 600, chunk).orderBy("seq").collect()]
        assert got == ["UNAVAILABLE", "FRESH", "UNAVAILABLE", "STALE", "DEGRADED", "FRESH"]
    probes = spark.createDataFrame([("s", t(2)), ("s", t(15)), ("s", t(25)), ("x", t(5))], "source_id string, at string").select(
        "source_id", F.col("at").cast("timestamp").alias("probe_at"))
    got = rows(health.health_as_of(health.source_health(df, 600), probes, 600, 60).select("source_id", "state", "age_seconds"), "source_id", "probe_at")
    assert got == [("s", "FRESH", 120), ("s", "STALE", 900), ("s", "UNAVAILABLE", 1500), ("x", "NEVER_ANSWERED", None)]
    assert health.out_of_order(df).count() == 0


@pytest.mark.parametrize("text,category,support,want", [
    ("11 vessels were observed", "CALCULATION", ["m-1"], None), ("12 vessels were observed", "CALCULATION", ["m-1"], "NUMERIC"),
    ("The share was 91%", "CALCULATION", ["m-1"], None), ("A suspicious vessel", "CALCULATION", ["m-1"], "THREAT"),
    ("Delay due to fog", "OBSERVATION", ["m-1"], "CAUSE"), ("Traffic will rise", "OBSERVATION", ["m-1"], "PREDICTION"),
    ("The operator is X", "OBSERVATION", ["m-1"], "IDENTITY"), ("It intends to leave", "OBSERVATION", ["m-1"], "INTENT"),
    ("All vessels at the port", "OBSERVATION", ["m-1"], "SCOPE"), ("11 seen", "CALCULATION", [], "PROVENANCE"),
    ("99 is documented", "LIMITATION", ["m-1"], None), ("At 7:45 on 2026-09-09T12:00:00Z: 11", "OBSERVATION", ["m-1"], None),
    ("See 77", "OBSERVATION", ["ref-77"], None),
])
def test_claim_audit(spark, text, category, support, want):
    claims = spark.createDataFrame([("b", "c", 1, text, category, [("metric", s) for s in support])],
                                   "bundle string, claim_id string, claim_order int, text string, category string, support array<struct<kind:string,id:string>>")
    values = spark.createDataFrame([("b", 11.0), ("b", 0.91), ("b", None)], "bundle string, value double")
    assert C.judge_claims(claims, values, ["bundle"]).first()["rejection"] == want


@pytest.mark.parametrize("text,tool,profile,relative,metric", [
    ("How many vessels at Long Beach in the last 24 hours?", "count_vessels", "long-beach-approach", "last_24_hours", None),
    ("how long is it here", "count_vessels", None, None, None), ("Compare entries compared to Suez", "compare_with_baseline", "suez-canal-approaches", None, "entry_count"),
    ("vs baseline here", "compare_with_baseline", None, None, "vessel_count"), ("tell me a joke", None, None, None, None),
    ("how many ships", None, None, None, None), ("pause the replay", "stop_replay", None, None, None),
])
def test_question_routing(spark, text, tool, profile, relative, metric):
    got = Q.route_questions(spark.createDataFrame([(text,)], "text string")).first()
    assert (got["tool"], got["profile_id"], got["relative"], got["metric"]) == (tool, profile, relative, metric)


def test_exact_median(spark):
    from fairlead.functions.median import exact_median

    data = [("a", v) for v in (1, 2, 10, 20)] + [("b", v) for v in (5, 5, 5)] + [("c", 7)]
    got = rows(exact_median(spark.createDataFrame(data, "k string, v bigint"), ["k"], "v", 3, "m"), "k")
    assert got == [("a", 6.0), ("b", 5.0), ("c", 7.0)]


def test_redaction(spark):
    from fairlead.functions.patterns import redact

    texts = ["http://x/?key=SECRET123&y=1", "Bearer abc123def456", "token sk-abcdefghijklmnop"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(redact(F.col("t"))).collect()]
    assert got == ["http://x/?key=<redacted>&y=1", "<redacted>", "token <redacted>"]


# --- streams ---------------------------------------------------------------------------------


def test_a_restarted_stream_goes_on_where_it_stopped(spark, observe, tmp_path):
    from fairlead.streaming import feeds

    def land(rows, name):
        observe(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def tracks():
        stream = feeds.land_stream(spark, str(tmp_path / "in"), "*.parquet", schema.OBSERVATION)
        return sorted((r["entity_id"], r["observed_points"]) for r in feeds.run_available(
            feeds.session_stream(stream, 3600), "tracks", "complete", str(tmp_path / "run")).collect())

    land([("1", "a", 0, *IN), ("2", "a", 30, *IN)], "first")
    assert tracks() == [("a", 2)]
    assert tracks() == [("a", 2)]
    land([("3", "a", 10, *IN), ("4", "a", 300, *IN), ("5", "b", 0, *IN)], "late rows count too")
    assert tracks() == [("a", 1), ("a", 3), ("b", 1)]


def test_a_batch_that_runs_again_adds_nothing(spark, observe, tmp_path):
    from fairlead.streaming import feeds

    observe([("1", "a", 0, *IN), ("2", "b", 5, *IN)]).write.parquet(str(tmp_path / "in"))
    seen = []

    def count(session, landing):
        seen.append(tables.read_observations(session, landing).count())
        if len(seen) == 1:
            raise ValueError("stopped after the write")

    for _ in range(2):
        stream = feeds.land_stream(spark, str(tmp_path / "in"), "*.parquet", schema.OBSERVATION)
        query = feeds.snapshot_each_batch(stream, str(tmp_path / "landing"), count, str(tmp_path / "state"))
        try:
            query.awaitTermination()
        except Exception as stopped:
            assert "stopped after the write" in str(stopped)
    assert seen == [2, 2]


def test_stream_dedupe_keeps_late_rows_and_far_duplicates_out(spark, observe, tmp_path):
    import time

    from fairlead.streaming import feeds

    same = {"record_ref": "r"}
    for part in [
        [("a", "v1", 0, 1.0, 1.0), ("d", "v3", 0, 1.0, 1.0, same)], [("b", "v1", 1200, 1.0, 1.0)], [("c", "v2", 5, 1.0, 1.0), ("a", "v1", 0, 1.0, 1.0)], [("e", "v3", 2400, 1.0, 1.0, same)],
    ]:
        observe(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        time.sleep(1.1)  # files are taken by their time
    schema = spark.read.parquet(str(tmp_path / "feed")).schema
    feed = feeds.land_stream(spark, str(tmp_path / "feed"), "*.parquet", schema, files_per_batch=1)
    found = feeds.run_available(feeds.dedupe_stream(feed), "late-dedupe")
    assert sorted(r.observation_id for r in found.collect()) == ["a", "b", "c", "d"]


def test_stream_retention_equals_the_batch_operator(spark, observe, tmp_path):
    import time

    from fairlead.streaming import feeds

    rng = random.Random(5)
    data = [(f"o{i:03d}", "v", rng.randrange(6000), 1.0, 1.0, {"provider_id": f"p{i % 2}"}) for i in range(60)]
    for i in range(0, 60, 15):  # batches out of time order
        observe(data[i:i + 15]).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        time.sleep(1.1)
    feed = feeds.land_stream(spark, str(tmp_path / "feed"), "*.parquet", spark.read.parquet(str(tmp_path / "feed")).schema, files_per_batch=1)
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, feeds.ROCKSDB)
    try:
        buffers = feeds.run_available(feeds.retention_stream(feed, 10), "retention")
    finally:
        spark.conf.unset(key)
    now = F.lit("2026-09-13T12:00:00Z").cast("timestamp")
    want = rows(ordering.retain_by_arrival(observe(data), now, 10, 3600 * 24).select("provider_id", "observation_id"), "provider_id", "observation_id")
    assert rows(feeds.retained(buffers, now, 3600 * 24).select("provider_id", "observation_id"), "provider_id", "observation_id") == want
    assert 0 < len(want) < 20 and buffers.select("version").distinct().count() == 4


def test_sliding_rates_count_every_covering_window(spark):
    from fairlead.operators import counters

    panes = spark.createDataFrame([("a", 0, 2), ("a", 60, 1), ("a", 240, 5), ("b", 60, 3)], "route string, s bigint, events bigint").select(
        "route", "events", F.timestamp_seconds("s").alias("window_start"))
    got = {(r.route, r.s): r.events for r in counters.sliding_rates(panes, ["route"], 60, 180).select(
        "route", F.unix_seconds("window_start").alias("s"), "events").collect()}
    want = {}
    for route, at, n in [("a", 0, 2), ("a", 60, 1), ("a", 240, 5), ("b", 60, 3)]:
        for k in range(3):
            want[route, at - 60 * k] = want.get((route, at - 60 * k), 0) + n
    assert got == want
    with pytest.raises(ValueError):
        counters.sliding_rates(panes, ["route"], 70, 180)


def test_a_report_is_written_as_a_unit(spark, tmp_path):
    one = spark.range(3).withColumnRenamed("id", "n")
    shapes = {"a": one.schema, "b": one.schema}
    path = str(tmp_path / "report")
    broken = one.withColumn("n", F.raise_error(F.lit("stopped half way")).cast("bigint"))
    with pytest.raises(Exception, match="stopped half way"):
        tables.write_report({"a": one, "b": broken}, path, "r1")
    with pytest.raises(ValueError, match="not committed"):
        tables.read_report(spark, path, "r1", shapes)
    tables.write_report({"a": one, "b": one.filter("n > 0")}, path, "r1")
    tables.write_report({"a": one.filter("false"), "b": one}, path, "r1")  # already committed: nothing changes
    got = tables.read_report(spark, path, "r1", shapes)
    assert (got["a"].count(), got["b"].count()) == (3, 2)
    tables.write_report({"a": one.filter("n = 1"), "b": one}, path, "r2")
    assert tables.read_report(spark, path, "r2", shapes)["a"].count() == 1 and tables.read_report(spark, path, "r1", shapes)["a"].count() == 3


def test_stream_snapshot_recomputes_only_touched_windows(spark, observe, tmp_path):
    from fairlead.plans import snapshot as S
    from fairlead.streaming import feeds

    wins = windows.windows(spark, [("a", "2026-09-09T12:00:00Z", "2026-09-09T13:00:00Z"), ("b", "2026-09-10T12:00:00Z", "2026-09-10T13:00:00Z")])
    profiles, fences = registry.profiles(spark).filter("profile_id = 'long-beach-approach'"), registry.fences(spark)
    names = ["profile_id", "window_id", "role", "in_fence_rows", "freight", "entries", "exits", "dwell_cohort"]
    asked, landed = [], []

    def compute(obs, own):
        asked.append(sorted(r.window_id for r in own.collect()))
        return S.snapshot(obs, profiles, fences, own).wide.select(*names)

    day = 24 * 60
    for part, touched in [
        ([("1", "x", 5, *IN), ("2", "x", 20, *OUT)], [["a"]]), ([("3", "y", day + 10, *IN)], [["b"]]), ([("4", "z", 9 * day, *IN)], []),
        ([("5", "x", -30, *IN), ("6", "y", day - 20, *IN)], [["a", "b"]]),
    ]:
        landed += part
        observe(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        asked.clear()
        feed = feeds.land_stream(spark, str(tmp_path / "in"), "*.parquet", schema.OBSERVATION)
        feeds.snapshot_stream(feed, wins, compute, str(tmp_path / "run")).awaitTermination()
        assert asked == touched
        got = feeds.snapshot_results(spark, str(tmp_path / "run")).select(*names)
        known = {r.window_id for r in got.collect()}
        want = S.snapshot(observe(landed), profiles, fences, wins).wide.select(*names).filter(F.col("window_id").isin(list(known)))
        assert rows(got, "window_id", "role") == rows(want, "window_id", "role")


def test_headline_waits_are_those_of_the_land_summary(spark):
    """Duplicates in one or several profiles, ties, missing waits, live and simulated profiles, overlapping windows."""
    from fairlead.operators.facility import headline_waits, land_summary, readings_in_scope

    rng = random.Random(5)
    wins = windows.windows(spark, [*TWO, ("both", "2026-09-09T12:30:00Z", "2026-09-09T15:00:00Z"), ("never", "2026-09-10T12:00:00Z", "2026-09-10T13:00:00Z")])
    names = ["a", "b", "c", "d"]
    seen = set()
    for _ in range(6):
        data = [
            (f"m{i}", f"cbp:{rng.choice(names)}{rng.randrange(4)}", rng.choice([5, 10, 40, 50, 130, 150]), rng.choice([None, "none", 1.0, 2.0, 3.0, 4.0]), False)
            for i in rng.sample(range(60), 60)
        ]
        table = readings_of(spark, data).withColumn("late", F.rand(rng.randrange(99)))
        late = (F.floor(F.col("late") * 4) * 60).cast("int")
        # Facilities of c are in two profiles; those of d are live for some readings.
        table = table.withColumn("received_at", F.timestamp_micros(F.unix_micros("observed_at") + late * 1_000_000)).withColumn(
            "profile_id", F.when(F.col("facility_id").startswith("cbp:c"), F.when(F.col("late") < 0.5, "land-a").otherwise("land-c"))
            .otherwise(F.concat(F.lit("land-"), F.substring("facility_id", 5, 1)))
        ).withColumn("is_live", F.col("facility_id").isin("cbp:d0", "cbp:d1") & (F.col("late") > 0.5)).drop("late").cache()
        table.count()
        prune, fan = (lambda rows: windows.prune_to_windows(rows, wins)), (lambda rows: windows.assign_windows(rows, wins))
        whole = land_summary(*readings_in_scope(table, wins, ("window_id",), prune, fan), ("window_id",))
        want = sorted((r.profile_id, r.window_id, str(r.wait_minutes)) for r in whole.collect())
        got = headline_waits(table, wins, ("window_id",), prune, fan)
        assert sorted((r.profile_id, r.window_id, str(r.wait_minutes)) for r in got.collect()) == want
        seen |= {(p, w) for p, w, _ in want}
    assert {p for p, _ in seen} == {"land-a", "land-b", "land-c", "land-d"} and ("land-d", "never") in seen and ("land-a", "never") not in seen
