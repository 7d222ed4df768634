"""Observation, facility, claim and request views derived from the given tables.

The benchmark tables hold no positions.  Each view maps their rows one to one
(plus stated copies) with fixed formulas, so every query's work grows with the
tables and an independent SQL engine can compute the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairlead.functions.timeline import plus_micros
from fairlead.session import spread, use_utc

SEC = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _every(n: int) -> Column:
    return F.col("event_id") % n == 0


def _entity_type() -> Column:
    u = F.col("user_id") % 10
    return (
        F.when(u <= 3, "cargo_vessel").when(u <= 6, "tanker").when(u == 7, "bulk_carrier").otherwise("unknown")
    )


def observations_from(ev: DataFrame) -> DataFrame:
    """Canonical observations, one per event.  Every sixth user sails off Singapore."""
    far = F.col("user_id") % 6 == 5
    lat_step = (F.col("event_id") * 37 + F.col("user_id") * 11) % 400
    lon_step = (F.col("event_id") * 53 + F.col("user_id") * 29) % 200
    lat = F.when(far, F.lit(1.05) + lat_step / F.lit(1250.0)).otherwise(F.lit(33.32) + lat_step / F.lit(1000.0))
    lon = F.when(far, F.lit(103.6) + lon_step / F.lit(280.0)).otherwise(F.lit(-118.24) + lon_step / F.lit(1000.0))
    return ev.select(
        F.concat(F.lit("ev-"), F.col("event_id")).alias("observation_id"),
        F.concat(F.lit("user:"), F.col("user_id")).alias("entity_id"),
        F.lit("sea").alias("mode"),
        F.when(_every(97), F.lit("tanker")).otherwise(_entity_type()).alias("entity_type"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        F.lit(None).cast("double").alias("altitude_meters"),
        F.when(F.col("event_type") != "error", F.col("value") / F.lit(5.0)).alias("speed_knots"),
        F.lit(None).cast("double").alias("speed_kph"),
        (F.col("event_id") % 360).cast("double").alias("heading_degrees"),
        F.col("ts").alias("observed_at"),
        plus_micros(F.col("ts"), (F.col("event_id") % 180) * SEC).alias("received_at"),
        F.concat(F.lit("prov-"), F.col("event_id") % 2).alias("provider_id"),
        F.concat(F.lit("feed-"), F.col("event_id") % 2).alias("endpoint_id"),
        F.when(~_every(10), F.concat(F.lit("r"), F.col("event_id"))).alias("record_ref"),
        F.lit("open").alias("license_id"),
        F.when(_every(50), "degraded").when(F.col("event_id") % 50 == 1, "stale").otherwise("fresh").alias("source_state"),
        F.lit("exact").alias("position_accuracy"),
        F.when(F.col("event_type") == "signup", "inferred").otherwise("confirmed").alias("classification"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations_from(events(spark, sf_dir))


def observations_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations plus a late copy of every seventh event."""
    obs = observations(spark, sf_dir)
    again = observations_from(events(spark, sf_dir).filter(_every(7)))
    again = again.withColumn("received_at", plus_micros(F.col("received_at"), 3600 * SEC)).withColumn(
        "observation_id", F.concat("observation_id", F.lit("-dup"))
    )
    return obs.unionByName(again)


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents as a provider would deliver them, with planted faults."""
    obs = observations_from(spread(events(spark, sf_dir)))
    numbered = obs.withColumn("_e", F.substring("observation_id", 4, 20).cast("bigint"))
    e = F.col("_e")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    doc = F.struct(
        F.when(e % 199 != 0, F.col("observation_id")).alias("observationId"),
        F.col("entity_id").alias("entityId"),
        F.when(e % 229 == 0, F.lit("submarine")).otherwise(F.col("mode")).alias("mode"),
        F.when(e % 227 == 0, F.lit("yacht")).otherwise(F.col("entity_type")).alias("entityType"),
        F.struct(
            F.when(e % 211 == 0, F.col("latitude") + 100).otherwise(F.col("latitude")).alias("latitude"),
            F.when(e % 233 == 0, F.col("longitude") - 100).otherwise(F.col("longitude")).alias("longitude"),
        ).alias("position"),
        F.struct(
            F.col("speed_knots").alias("speedKnots"),
            F.when(e % 223 == 0, F.lit(400.0)).otherwise(F.col("heading_degrees")).alias("headingDegrees"),
        ).alias("kinematics"),
        F.when(e % 239 == 0, F.lit("yesterday")).otherwise(iso(F.col("observed_at"))).alias("observedAt"),
        iso(F.col("received_at")).alias("receivedAt"),
        F.struct(
            F.col("provider_id").alias("providerId"),
            F.col("endpoint_id").alias("endpointId"),
            F.col("record_ref").alias("recordRef"),
            F.when(e % 241 != 0, F.col("license_id")).alias("licenseId"),
        ).alias("source"),
        F.struct(
            F.when(e % 251 == 0, F.lit("rotten")).otherwise(F.col("source_state")).alias("sourceState"),
            F.col("position_accuracy").alias("positionAccuracy"),
            F.col("classification").alias("classification"),
        ).alias("quality"),
    )
    body = F.when(e % 257 == 0, F.lit("[not an object]")).otherwise(F.to_json(doc))
    return numbered.select(e.alias("seq"), body.alias("raw"))


# Lane group per line number.
_LANES = {
    1: "commercial_vehicle", 2: "passenger_vehicle", 3: "pedestrian", 4: "fast",
    5: "nexus_sentri", 6: "ready", 7: "commercial_vehicle",
}


def _lane_of(line: Column) -> Column:
    lane = F.lit(None).cast("string")
    for number, name in _LANES.items():
        lane = F.when(line == number, F.lit(name)).otherwise(lane)
    return lane


def facility_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility readings, one per line item; the wait is missing on every ninth part."""
    return _readings_of(table(spark, sf_dir, "lineitem"))


def _readings_of(li: DataFrame, *carry: str) -> DataFrame:
    """``carry``: columns of the line items to hand on."""
    observed = F.col("l_shipdate").cast("timestamp")
    lane = _lane_of(F.col("l_linenumber"))
    wait = F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity"))
    measure = lambda metric, value, unit: F.struct(
        lane.alias("lane_group"), F.lit(metric).alias("metric"), value.alias("value"),
        F.lit(unit).alias("unit"), F.col("l_returnflag").alias("status_label"),
    )
    return li.select(
        F.concat_ws(
            "-", F.lit("fm"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("l_quantity").cast("int"),
        ).alias("metric_id"),
        F.concat(F.lit("site:"), F.col("l_suppkey")).alias("facility_id"),
        F.lit("border-crossing").alias("facility_type"),
        F.concat(F.lit("Site "), F.col("l_suppkey")).alias("display_name"),
        F.when(F.col("l_suppkey") % 5 == 0, "rail").otherwise("land").alias("mode"),
        observed.alias("observed_at"),
        plus_micros(observed, (F.col("l_orderkey") % 7) * SEC).alias("received_at"),
        F.array(
            measure("wait_minutes", wait, "minutes"),
            measure("lanes_open", F.col("l_linenumber").cast("double"), "lanes"),
        ).alias("measurements"),
        F.lit("bwt").alias("provider_id"),
        F.lit("fresh").alias("source_state"),
        (F.col("l_suppkey") % 4 == 0).alias("is_live"),
        F.concat(F.lit("profile-"), F.col("l_suppkey") % 10).alias("profile_id"),
        *carry,
    )


# Facility ids of the views begin with this.
SITE_PREFIX = "site:"


def land_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facility readings as those of the land profile, moved into the month of the other tables; all simulated."""
    day = F.datediff("observed_at", F.lit("1992-01-01").cast("date")) % 30
    # The number in the metric id, not read out of it again for each row.
    second = F.col("l_orderkey").cast("bigint") % 86_400
    at = F.lit("2024-01-01").cast("timestamp")
    moved = plus_micros(at, (day.cast("bigint") * 86_400 + second) * SEC)
    late = F.unix_micros("received_at") - F.unix_micros("observed_at")
    return _readings_of(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumns({
        "received_at": plus_micros(moved, late), "observed_at": moved, "profile_id": F.lit("el-paso-border-crossings"),
        "is_live": F.lit(False),
    }).drop("l_orderkey")


def aircraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted aircraft rows of all polls."""
    from fairlead.operators.normalize import accepted
    from fairlead.sources.aircraft import aircraft_rows, transform_aircraft

    return accepted(transform_aircraft(aircraft_rows(aircraft_polls(spark, sf_dir))))


def _json_number(value: Column) -> Column:
    return value.cast("double").cast("string")


def _pairs(*items: tuple[str, Column | None]) -> Column:
    """JSON object text from (key, JSON text or null); null parts are left out."""
    parts = [F.concat(F.lit(f'"{key}":'), value) for key, value in items]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def frames_from(ev: DataFrame) -> DataFrame:
    """Vessel feed frames, one per event: positions, static reports and faults by event id."""
    e, u = F.col("event_id"), F.col("user_id")
    k = e % 8
    kind = (
        F.when(k == 0, "ShipStaticData").when(k == 1, "StaticDataReport").when(k == 2, "BaseStationReport")
        .when(k == 6, "StandardClassBPositionReport").when(k == 7, "ExtendedClassBPositionReport")
        .otherwise("PositionReport")
    )
    number = lambda v: v.cast("string")
    code = number(e % 100)
    lat = _json_number(F.lit(33.32) + ((e * 37 + u * 11) % 400) / F.lit(1000.0))
    lon = _json_number(F.lit(-118.24) + ((e * 53 + u * 29) % 200) / F.lit(1000.0))
    typed_place = e % 11 != 0
    body = F.when(k == 0, _pairs(("Type", code), ("UserID", number(u)))).when(
        k == 1, _pairs(("UserID", number(u)), ("PartA", _pairs(("Type", code))))
    ).otherwise(
        _pairs(
            ("UserID", number(u)),
            ("Latitude", F.when(typed_place, lat)),
            ("Longitude", F.when(typed_place, lon)),
            ("SOG", F.when(e % 13 == 0, F.lit("102.3")).otherwise(_json_number((e % 300) / F.lit(10.0)))),
            ("Heading", F.when(e % 5 == 0, F.lit("511")).otherwise(number(e % 360))),
            ("COG", F.when(e % 3 == 0, F.lit("360")).otherwise(_json_number((e % 3600) / F.lit(10.0)))),
        )
    )
    stamp = (
        F.when(e % 19 == 0, F.lit("soon"))
        .when(e % 17 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(e % 23 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" +0200 UTC")))
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" +0000 UTC")))
    )
    meta = _pairs(
        ("MMSI", F.when(e % 9 != 0, number(u))),
        ("latitude", _json_number(F.lit(33.4))),
        ("longitude", F.when(e % 77 != 0, _json_number(F.lit(-118.1)))),
        ("time_utc", _quoted(stamp)),
    )
    frame = _pairs(
        ("MessageType", _quoted(kind)),
        ("MetaData", F.when(k != 3, meta)),
        ("Message", F.concat(F.lit("{"), _quoted(kind), F.lit(":"), body, F.lit("}"))),
    )
    return ev.select(
        e.alias("arrival_seq"),
        plus_micros(F.col("ts"), (e % 180) * SEC).alias("received_at"),
        F.when(e % 101 == 0, F.lit("{broken")).otherwise(frame).alias("frame"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_from(spread(events(spark, sf_dir)))


def aircraft_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aircraft poll documents, one per event, with a good and a doubtful record each."""
    e, u = F.col("event_id"), F.col("user_id")
    # Callsigns cycle through freight and other operators.
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("FDX", "ups", "DLH", "GTI", "AF", "BAW", "BOX")]), (e % 7 + 1).cast("int"))
    first = _pairs(
        ("hex", _quoted(F.concat(F.lit(" A"), u.cast("string")))),
        ("flight", _quoted(F.concat(prefix, (u % 10).cast("string"), F.lit("  ")))),
        ("lat", _json_number(F.lit(33.6) + ((e * 37 + u * 11) % 400) / F.lit(1000.0))),
        ("lon", _json_number(F.lit(-118.7) + ((e * 53 + u * 29) % 500) / F.lit(1000.0))),
        ("alt_baro", F.when(e % 6 == 0, F.lit('"ground"')).otherwise((e % 40000).cast("string"))),
        ("gs", F.when(e % 4 != 0, _json_number((e % 5000) / F.lit(10.0)))),
        ("track", _json_number((e % 3600) / F.lit(10.0))),
        ("type", F.when(e % 9 == 0, _quoted(F.lit("mlat"))).otherwise(_quoted(F.lit("adsb_icao")))),
        ("seen_pos", F.when(e % 3 != 0, _json_number((e % 90) / F.lit(8.0)))),
    )
    second = _pairs(
        ("hex", F.when(e % 2 == 0, _quoted(F.concat(F.lit("b"), u.cast("string"))))),
        ("lat", F.when(e % 5 == 0, F.lit("95.5")).otherwise(F.lit("33.8"))),
        ("lon", F.when(e % 7 != 0, F.lit("-118.4"))),
    )
    doc = F.concat(F.lit('{"ac":['), first, F.lit(","), second, F.lit("]}"))
    return spread(events(spark, sf_dir)).select(
        e.alias("poll_id"), F.col("ts").alias("received_at"),
        F.when(e % 103 == 0, F.lit('{"ac":[{}]}')).otherwise(doc).alias("document"),
    )


def border_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Border wait documents, one per line item: an array with one crossing."""
    o, s, n = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber")
    day = F.col("l_shipdate").cast("timestamp")
    text = lambda v: _quoted(v.cast("string"))
    status = (
        F.when(F.col("l_partkey") % 11 == 0, "Update Pending").when(F.col("l_partkey") % 13 == 0, "N/A").otherwise("no delay")
    )
    delay = F.when(F.col("l_partkey") % 9 == 0, F.lit('""')).otherwise(text(F.col("l_quantity").cast("int")))
    lane = lambda label: _pairs(
        ("update_time", text(label)), ("operational_status", text(status)),
        ("delay_minutes", delay), ("lanes_open", F.when(n % 3 == 0, F.lit('""')).otherwise(text(n))),
    )
    crossing = _pairs(
        ("port_number", F.when(o % 97 != 0, text(F.lit(240000) + s))),
        ("port_name", text(F.concat(F.lit("Port "), s % 20))),
        ("crossing_name", F.when(s % 3 == 0, F.lit('""')).otherwise(text(F.concat(F.lit("Gate"), s % 7, F.lit(" North"))))),
        ("date", F.when(o % 89 == 0, F.lit('"soon"')).otherwise(text(F.date_format(day, "M/d/yyyy")))),
        ("time", F.lit('"07:30:00"')),
        ("port_status", F.lit('"Open"')),
        ("commercial_vehicle_lanes", _pairs(
            ("standard_lanes", lane(F.when(n % 2 == 0, F.lit("")).otherwise(F.lit("At 7:00 am")))),
            ("FAST_lanes", F.when(n % 2 == 0, lane(F.lit("At 7:15 am")))),
        )),
        ("pedestrian_lanes", F.when(n % 4 == 0, _pairs(("ready_lanes", lane(F.lit("At 7:20 am")))))),
    )
    return spread(table(spark, sf_dir, "lineitem")).select(
        o.alias("order_key"), n.alias("line_number"), s.alias("supp_key"),
        plus_micros(day, 8 * 3600 * SEC).alias("received_at"),
        F.when(o % 83 == 0, F.lit('{"error":"down"}')).otherwise(F.concat(F.lit("["), crossing, F.lit("]"))).alias("document"),
    )


def raw_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility reading documents, one per line item, with planted faults."""
    o, s, n, p = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_partkey")
    day = F.col("l_shipdate").cast("timestamp")
    iso = lambda c: _quoted(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    text = lambda v: _quoted(v.cast("string"))
    lane = F.when(o % 61 == 0, F.lit('"all"')).otherwise(_quoted(_lane_of(n)))
    wait = _pairs(
        ("laneGroup", lane), ("metric", F.lit('"wait_minutes"')),
        ("value", F.when(p % 9 == 0, F.lit("null")).when(o % 67 == 0, F.lit("-3")).otherwise(_json_number(F.col("l_quantity")))),
        ("statusLabel", text(F.col("l_returnflag"))),
    )
    lanes = _pairs(
        ("laneGroup", _quoted(_lane_of(n))), ("metric", F.lit('"lanes_open"')),
        ("value", F.when(o % 71 == 0, F.lit("1.5")).otherwise(n.cast("string"))),
    )
    doc = _pairs(
        ("metricId", text(F.concat_ws("-", F.lit("fm"), o, n))),
        ("facilityId", F.when(o % 73 != 0, text(F.concat(F.lit("site:"), s)))),
        ("facilityType", F.lit('"border-crossing"')),
        ("displayName", text(F.concat(F.lit("Site "), s))),
        ("mode", F.when(o % 79 == 0, F.lit('"sea"')).otherwise(F.lit('"land"'))),
        ("observedAt", iso(day)),
        ("receivedAt", iso(plus_micros(day, F.when(o % 53 == 0, F.lit(-60)).otherwise(F.lit(60)) * SEC))),
        ("measurements", F.when(o % 59 == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), wait, F.lit(","), lanes, F.lit("]")))),
        ("source", _pairs(("providerId", F.lit('"bwt"')), ("endpointId", F.lit('"e"')),
                          ("licenseId", F.when(o % 47 != 0, F.lit('"pd"'))))),
        ("quality", F.when(o % 3 == 0, _pairs(("sourceState", F.lit('"fresh"'))))),
    )
    return spread(table(spark, sf_dir, "lineitem")).select(o.alias("order_key"), n.alias("line_number"), s.alias("supp_key"), doc.alias("raw"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated manifests, one per event, each with the event's raw observation."""
    e = F.col("seq")
    doc = _pairs(
        ("fixtureId", F.when(e % 43 == 0, F.lit('""')).otherwise(_quoted(F.concat(F.lit("fx-"), e)))),
        ("truthState", F.when(e % 37 == 0, F.lit('"OBSERVED"')).otherwise(F.lit('"SIMULATED"'))),
        ("simulated", F.when(e % 41 == 0, F.lit("false")).otherwise(F.lit("true"))),
        ("provenance", _pairs(("providerId", F.when(e % 31 == 0, F.lit('"live"')).otherwise(F.lit('"simulated-x"'))))),
        ("observations", F.when(e % 29 == 0, F.lit("{}")).otherwise(F.concat(F.lit("["), F.col("raw"), F.lit("]")))),
    )
    # A broken raw body breaks the manifest around it, which is then no object.
    return raw_observations(spark, sf_dir).select(
        F.concat(F.lit("fx-"), e, F.lit(".json")).alias("file"), doc.alias("document"), e.alias("seq")
    )


def refreshes_from(ev: DataFrame) -> DataFrame:
    """Source refresh outcomes, one per event: errors fail, sign-ups are partial."""
    e = F.col("event_id")
    return ev.select(
        F.concat(F.lit("src-"), F.col("user_id") % 25).alias("source_id"),
        e.alias("seq"),
        F.col("ts").alias("now"),
        F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "partial").otherwise("ok").alias("status"),
        F.when(e % 4 != 0, plus_micros(F.col("ts"), -((F.col("value") * 100).cast("bigint")) * SEC)).alias("last_observation_at"),
    )


def refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refreshes_from(events(spark, sf_dir))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim rows, one per event, bundled by user and day, with planted faults; plus one per document."""
    e, u = F.col("event_id"), F.col("user_id")
    shown = F.format_string("%.2f", F.col("value"))
    pick = e % 12
    text = (
        F.when(pick == 0, F.concat(F.lit("A suspicious stop was seen at berth "), u))
        .when(pick == 1, F.concat(F.lit("Waits grew because of fog, now "), shown))
        .when(pick == 2, F.concat(F.lit("The queue will rise to "), shown))
        .when(pick == 3, F.lit("The beneficial owner is not known"))
        .when(pick == 4, F.lit("The vessel intends to anchor"))
        .when(pick == 5, F.concat(F.lit("All vessels at the port: "), shown))
        .when(pick == 6, F.concat(F.lit("The reading was "), F.format_string("%.2f", F.col("value") + 7.0), F.lit(" minutes")))
        .when(pick == 7, F.concat(F.lit("At 7:45 on 2024-01-15T10:00:00Z the wait was "), shown))
        .when(pick == 8, F.concat(F.lit("The share was "), F.format_string("%.1f", F.col("value") * 100)))
        .otherwise(F.concat(F.lit("The observed value was "), shown, F.lit(" in the window")))
    )
    category = (
        F.when(e % 10 == 0, "LIMITATION").when(e % 10 == 1, "COMPARISON").when(e % 10 < 6, "CALCULATION").otherwise("OBSERVATION")
    )
    cited = F.array(F.struct(F.lit("metric").alias("kind"), F.concat(F.lit("m-"), e).alias("id")))
    from_events = events(spark, sf_dir).select(
        F.concat(F.lit("u"), u, F.lit("-d"), F.date_format("ts", "yyyyMMdd")).alias("bundle_id"),
        F.concat(F.lit("c-"), e).alias("claim_id"),
        e.alias("claim_order"),
        text.alias("text"),
        category.alias("category"),
        F.when(e % 13 == 0, F.array().cast("array<struct<kind:string,id:string>>")).otherwise(cited).alias("support"),
    )
    from_documents = spread(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("doc-"), F.col("source")).alias("bundle_id"),
        F.concat(F.lit("d-"), F.col("doc_id")).alias("claim_id"),
        F.col("doc_id").alias("claim_order"),
        "text",
        F.when(F.col("doc_id") % 2 == 0, "LIMITATION").otherwise("OBSERVATION").alias("category"),
        F.array(F.struct(F.lit("metric").alias("kind"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"))).alias("support"),
    )
    return from_events.unionByName(from_documents)


# Sentences planted into document claims in turn, by doc_id; every seventh one loses its support instead.
PLANTED_PHRASES = [
    ("THREAT", "A hostile act was reported."), ("CAUSE", "The delay is due to fog."), ("PREDICTION", "Queues will grow tomorrow."),
    ("IDENTITY", "Its operator is unknown."), ("INTENT", "The master is planning to leave."), ("SCOPE", "All vessels in the harbor wait."),
]


def planted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims, each with a known fault planted: event claims carry theirs, document claims get one by doc_id."""
    turn = F.col("claim_order") % (len(PLANTED_PHRASES) + 1)
    said = F.lit("")
    for i, (_, phrase) in enumerate(PLANTED_PHRASES):
        said = F.when(turn == i, phrase + " ").otherwise(said)
    document = F.col("claim_id").startswith("d-")
    bare = document & (turn == len(PLANTED_PHRASES))
    return claims(spark, sf_dir).withColumns({
        "text": F.when(document, F.concat(said, F.coalesce("text", F.lit("")))).otherwise(F.col("text")),
        "support": F.when(bare, F.array().cast("array<struct<kind:string,id:string>>")).otherwise(F.col("support")),
    })


def planted_label():
    """What a planted claim has to be judged."""
    e = F.col("claim_order")
    event = (
        F.when(e % 12 == 0, "THREAT").when(e % 12 == 1, "CAUSE").when(e % 12 == 2, "PREDICTION").when(e % 12 == 3, "IDENTITY")
        .when(e % 12 == 4, "INTENT").when(e % 12 == 5, "SCOPE").when(e % 13 == 0, "PROVENANCE")
        .when((e % 12 == 6) & (F.col("category") != "LIMITATION"), "NUMERIC").otherwise("accepted")
    )
    document = F.lit("PROVENANCE")
    for i, (name, _) in enumerate(PLANTED_PHRASES):
        document = F.when(e % (len(PLANTED_PHRASES) + 1) == i, name).otherwise(document)
    return F.when(F.col("claim_id").startswith("d-"), document).otherwise(event)


def claim_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric values the claims of a bundle may cite."""
    return events(spark, sf_dir).select(
        F.concat(F.lit("u"), F.col("user_id"), F.lit("-d"), F.date_format("ts", "yyyyMMdd")).alias("bundle_id"), "value"
    )


# Fixed question texts, cycled by event id.
QUESTIONS = [
    "How many vessels are waiting at Long Beach in the last 24 hours?",
    "Summarize Singapore", "Vessel count vs baseline here", "what changed at suez over 3 days",
    "Compare the moving fraction of the Suez Canal compared to before", "start the replay",
    "Explain the dwell", "show me the last 6 hours", "how long is the wait at the Paso border?",
    "list the ships near los angeles beach, 6 h", "any events", "go to malacca",
    "cargo flights here", "tell me a joke", "  ", "exit count current view vs. baseline",
]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations, and one fixed question per event."""
    asked = spread(table(spark, sf_dir, "conversations")).filter("role = 'user'").select(
        F.concat_ws("-", F.lit("cv"), "conv_id", "turn").alias("question_id"), "text"
    )
    text = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (F.col("event_id") % len(QUESTIONS) + 1).cast("int"))
    posed = spread(events(spark, sf_dir)).select(F.concat(F.lit("ev-"), F.col("event_id")).alias("question_id"), text.alias("text"))
    return asked.unionByName(posed)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to redact: every document and one request line per event."""
    e = F.col("event_id")
    line = (
        F.when(e % 4 == 0, F.concat(F.lit("GET /api?token=abc"), e, F.lit("&x=1 ok")))
        .when(e % 4 == 1, F.concat(F.lit("auth bearer  tok"), e, F.lit(' "done"')))
        .when(e % 4 == 2, F.concat(F.lit("key sk-abcdef_"), e, F.lit("; task-sk-1 left")))
        .otherwise(F.concat(F.lit("plain line "), e))
    )
    lines = events(spark, sf_dir).select(F.concat(F.lit("ev-"), e).alias("line_id"), line.alias("text"))
    docs = spread(table(spark, sf_dir, "documents")).select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("line_id"), "text")
    return lines.unionByName(docs)


def requests_from(ev: DataFrame) -> DataFrame:
    """Request log: path by event type, status by value."""
    path = (
        F.when(F.col("event_type") == "view", "/api/health").when(F.col("event_type") == "click", "/assets/app.js")
        .when(F.col("event_type") == "signup", "/metrics").when(F.col("event_type") == "error", "/nowhere").otherwise("/")
    )
    status = F.when(F.col("value") > 100, 500).when(F.col("value") > 50, 404).when(F.col("value") > 40, 302).otherwise(200)
    return ev.select("event_id", F.col("ts").alias("at"), path.alias("path"), status.alias("code"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_from(events(spark, sf_dir))


def watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watch rows, one per user and metric seen, some of them invalid."""
    u = F.col("user_id")
    metrics = ["vessel_count", "moving_fraction", "dwell_cohort_size", "dwell_median_seconds", "entry_count", "exit_count"]
    homes = ["long-beach-approach", "singapore-malacca-approach", "suez-canal-approaches", "lax-cargo-air", "nowhere"]
    cycle = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    return events(spark, sf_dir).select(
        F.concat_ws("|", F.lit("w"), u % 40, F.col("event_id") % 7).alias("id"),
        cycle(homes, u).alias("profile_id"),
        F.when(F.col("event_id") % 31 == 0, F.lit("weather")).otherwise(cycle(metrics, F.col("event_id") % 7)).alias("metric"),
        F.when(u % 2 == 0, "increase").otherwise("decrease").alias("watch_direction"),
        (F.col("event_id") % 9 - 1).cast("double").alias("pct_threshold"),
        F.when(u % 3 == 0, "require-fresh").otherwise("allow-stale").alias("freshness_policy"),
        F.col("ts").alias("created_at"),
        F.lit("1").alias("config_version"),
        F.col("event_id").alias("seq"),
    )


def labelled_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Detections from purchases, labels from errors, scoped by user group."""
    ev = events(spark, sf_dir)
    scope = F.concat(F.lit("zone-"), F.col("user_id") % 5)
    labels = ev.filter("event_type = 'error'").select(
        F.concat(F.lit("l-"), F.col("event_id")).alias("label_id"), F.lit("stoppage").alias("event_type"),
        scope.alias("scope"), F.col("ts").alias("onset_at"), F.col("event_id").alias("label_seq"),
    )
    detections = ev.filter("event_type = 'purchase'").select(
        F.concat(F.lit("d-"), F.col("event_id")).alias("detection_id"), F.lit("stoppage").alias("event_type"),
        scope.alias("scope"), F.col("ts").alias("detected_at"), F.col("event_id").alias("detection_seq"),
    )
    return labels, detections


def supplier_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small fence per supplier, grouped into profiles by nation, with planted faults."""
    s = F.col("s_suppkey")
    lat0 = F.lit(33.32) + (s % 40) / F.lit(100.0)
    lon0 = F.lit(-118.24) + (s % 19) / F.lit(100.0)
    vertex = lambda a, o: F.struct((lat0 + a).alias("lat"), (lon0 + o).alias("lon"))
    size = F.lit(0.01) + (s % 5) / F.lit(200.0)
    corners = F.array(
        vertex(F.lit(0.0), F.lit(0.0)), vertex(size, F.lit(0.0)), vertex(size, size),
        vertex(size / 2, size / 2), vertex(F.lit(0.0), size),
    )
    ring = F.when(s % 29 == 0, F.slice(corners, 1, 3)).when(
        s % 31 == 0, F.transform(corners, lambda v: F.struct((v["lat"] + 100).alias("lat"), v["lon"].alias("lon")))
    ).otherwise(corners)
    purpose = (
        F.when(s % 4 == 0, "waiting-cohort").when(s % 4 == 1, "approach-flow").when(s % 4 == 2, "port-basin")
        .otherwise("canal-corridor")
    )
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("p-"), F.col("s_nationkey")).alias("profile_id"),
        s.cast("int").alias("position"),
        F.concat(F.lit("f-"), s).alias("fence_id"),
        purpose.alias("purpose"),
        F.lit("v1").alias("geometry_version"),
        F.when(s % 13 == 0, "placeholder").otherwise("reviewed").alias("geometry_status"),
        F.when(s % 17 != 0, "owner").alias("review_owner"),
        F.when(s % 19 == 0, "soon").otherwise("2026-09-09").alias("effective_date"),
        F.when(s % 23 == 0, "").otherwise("inside").alias("inclusion_rule"),
        F.lit("because").alias("rationale"),
        ring.alias("ring"),
        F.when(s % 2 == 0, "covered").otherwise("unknown").alias("coverage_hint"),
    )
