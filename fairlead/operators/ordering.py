"""Canonical order, duplicate removal, retention and bounded selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlead.functions.timeline import MICROS, plus_micros, round_half_up
from fairlead.functions.topn import top_n_per_group

CANONICAL = ["observed_at", "entity_id", "observation_id"]

# Display budgets of the bounded selections.
POINT_BUDGET = 800
EVENT_BUDGET = 6


def sort_observations(obs: DataFrame) -> DataFrame:
    """Total order; a range-partitioned sort, never a single task."""
    return obs.orderBy(*CANONICAL)


def duplicate_key() -> Column:
    """Provider reference when there is one, else entity, time and rounded position."""
    place = lambda c: round_half_up(F.col(c) * 100_000).cast("string")
    return F.when(
        F.col("record_ref").isNotNull(), F.concat(F.lit("ref:"), F.col("provider_id"), F.lit(":"), F.col("record_ref"))
    ).otherwise(
        F.concat_ws(
            ":", F.lit("pos"), F.col("entity_id"), F.unix_micros("observed_at").cast("string"),
            place("latitude"), place("longitude"),
        )
    )


def dedupe_observations(obs: DataFrame) -> DataFrame:
    """First row in canonical order per duplicate key.

    ``row_number() = 1`` is limited per map task before the shuffle, so a key
    with very many copies sends one row per task.
    """
    first = Window.partitionBy("duplicate_key").orderBy(*CANONICAL)
    return (
        obs.withColumn("duplicate_key", duplicate_key())
        .withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .drop("_n")
    )


def duplicates_removed(obs: DataFrame) -> DataFrame:
    """How many rows de-duplication drops, without carrying the rows."""
    per_key = obs.groupBy(duplicate_key().alias("k")).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("*").alias("unique_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"),
    )


def retain_by_arrival(obs: DataFrame, now: Column, max_records: int = 5000, ttl_seconds: int = 72 * 3600) -> DataFrame:
    """Last ``max_records`` arrivals per provider, then drop what is older than the time to live."""
    newest = [F.col("received_at").desc(), F.col("observation_id").desc()]
    kept = top_n_per_group(obs, ["provider_id"], newest, max_records, ["observation_id"]).drop("rank")
    return kept.filter(F.col("received_at") >= plus_micros(now, -ttl_seconds * MICROS))


def retain_by_time(obs: DataFrame, now: Column, max_records: int = 1000, ttl_seconds: int = 24 * 3600) -> DataFrame:
    """Drop what is older than the time to live, then keep the newest per provider."""
    fresh = obs.filter(F.col("received_at") >= plus_micros(now, -ttl_seconds * MICROS))
    newest = [F.col("observed_at").desc(), F.col("observation_id").desc()]
    return top_n_per_group(fresh, ["provider_id"], newest, max_records, ["observation_id"]).drop("rank")


def bounded_topk(candidates: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most ``n`` per group by priority descending, id ascending, with considered and dropped counts.

    ``candidates``: key columns, ``id``, ``priority``.
    """
    if not isinstance(n, int) or n < 0:
        raise ValueError("the bound must be a non-negative integer")
    best = [F.col("priority").desc(), F.col("id").asc()]
    chosen = top_n_per_group(candidates, keys, best, n, ["id"])
    totals = candidates.groupBy(*keys).agg(F.count("*").alias("considered"))
    totals = totals.withColumn("dropped", F.greatest(F.lit(0), F.col("considered") - n))
    return chosen.join(totals, keys)


def cohort_stability(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Whether two selections hold the same ids per group.

    Ids are counted per side, so a repeated id has to repeat on the other side too.
    """
    side = lambda df, name: df.select(*keys, "id", F.lit(name).alias("_side"))
    both = side(left, "a").unionByName(side(right, "b"))
    per_id = both.groupBy(*keys, "id").agg(
        F.count_if(F.col("_side") == "a").alias("_a"), F.count_if(F.col("_side") == "b").alias("_b")
    )
    return per_id.groupBy(*keys).agg(
        F.count_if(F.col("_a") != F.col("_b")).alias("differing_ids"),
        (F.count_if(F.col("_a") != F.col("_b")) == 0).alias("stable"),
    )


def network_topk(members: DataFrame, budget: int = POINT_BUDGET) -> DataFrame:
    """Newest observations of every profile under a shared budget.

    ``members``: one row per (profile_id, observation).  Profiles with rows share
    the budget equally, at least one each; ``dropped`` counts what a profile lost.
    """
    counts = members.groupBy("profile_id").agg(F.count("*").alias("considered"))
    share = counts.agg(F.greatest(F.lit(1), F.floor(F.lit(budget) / F.count("*"))).alias("share"))
    newest = [F.col("observed_at").desc(), F.col("id").asc(), F.col("observation_id").asc()]
    marked = members.withColumn("id", F.concat("entity_id", F.lit("@"), F.unix_micros("observed_at").cast("string")))
    # The share is at most the budget: cut by the literal budget first, which runs before the shuffle.
    chosen = top_n_per_group(marked, ["profile_id"], newest, max(1, budget), ["observation_id"])
    per_profile = counts.join(F.broadcast(share)).withColumn(
        "dropped", F.greatest(F.lit(0), F.col("considered") - F.col("share"))
    )
    return chosen.join(per_profile, "profile_id").filter(F.col("rank") <= F.col("share"))
