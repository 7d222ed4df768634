"""Facility readings: duplicates, latest reading, commercial wait, live preference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlead.session import stage


def facility_duplicate_key() -> Column:
    lanes = F.array_sort(F.transform("measurements", lambda m: F.concat_ws(":", m["lane_group"], m["metric"])))
    return F.concat_ws(
        "|", F.col("facility_id"), F.unix_micros("observed_at").cast("string"), F.array_join(lanes, "|")
    )


def dedupe_facility(readings: DataFrame) -> DataFrame:
    """Per duplicate key keep the latest receipt, then the largest metric id."""
    best = Window.partitionBy("duplicate_key").orderBy(F.col("received_at").desc(), F.col("metric_id").desc())
    return (
        readings.withColumn("duplicate_key", facility_duplicate_key())
        .withColumn("_n", F.row_number().over(best))
        .filter("_n = 1")
        .drop("_n")
    )


def sort_facility(readings: DataFrame) -> DataFrame:
    return readings.orderBy("observed_at", "metric_id")


def latest_per_facility(readings: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Newest reading per facility (and keys); on a tie the one received first."""
    newest = Window.partitionBy(*keys, "facility_id").orderBy(
        F.col("observed_at").desc(), F.col("received_at").asc(), F.col("metric_id").asc()
    )
    return readings.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def commercial_wait() -> Column:
    """Value of the first commercial-vehicle wait reading; null when there is none."""
    hits = F.filter(
        "measurements", lambda m: (m["lane_group"] == "commercial_vehicle") & (m["metric"] == "wait_minutes")
    )
    return F.get(hits, 0)["value"]


def commercial_waits(readings: DataFrame) -> DataFrame:
    return readings.withColumn("commercial_wait_minutes", commercial_wait())


def prefer_live(readings: DataFrame, start: str, end: str, id_prefix: str) -> DataFrame:
    """Live rows of a profile when it has any (whatever the window), else its simulated rows in the window.

    ``readings``: profile_id, is_live, facility_id, observed_at, ...  The live flag is
    summed per profile and joined back; no profile is gathered in one task.
    """
    has_live = readings.groupBy("profile_id").agg(F.bool_or("is_live").alias("_has_live"))
    simulated = (
        F.col("facility_id").startswith(id_prefix)
        & F.col("observed_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    )
    return (
        readings.join(has_live, "profile_id")
        .filter(F.when(F.col("_has_live"), F.col("is_live")).otherwise(simulated))
        .drop("_has_live")
    )


_SLIM = ["profile_id", "facility_id", "display_name", "metric_id", "observed_at", "received_at", "is_live", "commercial_wait_minutes"]


def readings_in_scope(
    readings: DataFrame, scopes: DataFrame, keys: tuple[str, ...], prune: Callable[[DataFrame], DataFrame],
    fan: Callable[[DataFrame], DataFrame], id_prefix: str = "cbp:",
) -> tuple[DataFrame, DataFrame]:
    """The newest reading of each facility as of each scope, and the number of readings per (profile, scope).

    ``readings``: profile_id, is_live and the facility columns.  ``scopes`` lists the scope
    keys, ``prune`` leaves out rows that no scope contains, ``fan`` hands rows to the scopes
    that contain them.  Live readings of a profile stand for every scope, the newest of each
    facility alone; a profile without any has its simulated ones (by ``id_prefix``) inside
    the scope, duplicates removed.  Live and simulated rows are each read once; rows are
    limited per map task before they are shuffled and no profile is gathered.
    """
    names = ["profile_id", *keys, "facility_id", "display_name", "metric_id", "observed_at", "is_live", "commercial_wait_minutes"]
    waiting = readings.withColumn("commercial_wait_minutes", commercial_wait())
    live = stage(latest_per_facility(waiting.filter("is_live").select(*_SLIM), ("profile_id",)), "live-readings")
    has_live = live.select("profile_id").distinct()
    every_live = live.crossJoin(scopes.select(*keys)).select(*names)  # the asked grid of facilities and scopes
    own = prune(waiting.filter(~F.col("is_live") & F.col("facility_id").startswith(id_prefix)))
    simulated = fan(stage(dedupe_facility(own).select(*_SLIM), "simulated-readings"))
    newest = latest_per_facility(simulated, ("profile_id", *keys)).select(*names).join(has_live, "profile_id", "left_anti")
    counts = simulated.groupBy("profile_id", *keys).agg(F.count("*").alias("readings")).join(has_live, "profile_id", "left_anti")
    counts = counts.unionByName(every_live.groupBy("profile_id", *keys).agg(F.count("*").alias("readings")))
    return every_live.unionByName(newest), counts


def _first_wait(newest: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per key the wait of the first facility by (observed_at, metric_id)."""
    first = Window.partitionBy(*keys).orderBy("observed_at", "metric_id")
    return newest.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(
        *keys, F.col("commercial_wait_minutes").alias("wait_minutes")
    )


def headline_waits(
    readings: DataFrame, scopes: DataFrame, keys: tuple[str, ...], prune: Callable[[DataFrame], DataFrame],
    fan: Callable[[DataFrame], DataFrame], id_prefix: str = "cbp:",
) -> DataFrame:
    """The headline wait of ``land_summary`` alone, as of each scope; arguments as of ``readings_in_scope``.

    The wait is that of the facility whose newest simulated reading is the oldest, so instants
    are enough to find it, and duplicates are removed among the readings of that instant.  Only
    readings of facilities that several profiles have are compared in full: a duplicate may
    stand in another profile.
    """
    waiting = readings.withColumn("commercial_wait_minutes", commercial_wait())
    live = stage(latest_per_facility(waiting.filter("is_live").select(*_SLIM), ("profile_id",)), "live-readings")
    every_live = _first_wait(live, ("profile_id",)).crossJoin(scopes.select(*keys))
    own = prune(waiting.filter(~F.col("is_live") & F.col("facility_id").startswith(id_prefix)))
    scope = ["profile_id", *keys]
    newest = stage(
        fan(own.select("profile_id", "facility_id", "observed_at")).groupBy(*scope, "facility_id").agg(F.max("observed_at").alias("observed_at")),
        "newest-readings",
    )
    several = newest.groupBy("facility_id").agg(F.min("profile_id").alias("_p"), F.max("profile_id").alias("_q")).filter("_p < _q")
    several = stage(several.select("facility_id"), "shared-facilities")
    alone = newest.join(several, "facility_id", "left_anti")
    oldest = stage(alone.join(alone.groupBy(*scope).agg(F.min("observed_at").alias("observed_at")), [*scope, "observed_at"], "left_semi"), "oldest-readings")
    place = ["profile_id", "facility_id", "observed_at"]
    asked = dedupe_facility(own.join(oldest.select(*place).distinct(), place, "left_semi")).select(*_SLIM).join(oldest, place)
    shared = fan(dedupe_facility(own.join(several, "facility_id", "left_semi")).select(*_SLIM))
    names = [*keys, *_SLIM]
    simulated = _first_wait(latest_per_facility(asked.select(*names).unionByName(shared.select(*names)), tuple(scope)), tuple(scope))
    simulated = simulated.join(live.select("profile_id").distinct(), "profile_id", "left_anti")
    return every_live.select(*scope, "wait_minutes").unionByName(simulated)


def land_summary(newest: DataFrame, counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per (profile, scope): facilities, readings and the headline wait, that of the first facility by (observed_at, metric_id)."""
    headline = _first_wait(newest, ("profile_id", *keys))
    facilities = newest.groupBy("profile_id", *keys).agg(F.count("*").alias("facilities"))
    return facilities.join(headline, ["profile_id", *keys]).join(counts, ["profile_id", *keys])
