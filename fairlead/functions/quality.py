"""Worst-state rollups as integer ranks, so they combine map-side with max."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fairlead.schema import COMPARISON_STATES, METRIC_STATES, TRACK_STATES


def _rank(state: Column, scale: list[str]) -> Column:
    ranked = F.lit(None).cast("int")
    for position, name in enumerate(scale):
        ranked = F.when(state == name, F.lit(position)).otherwise(ranked)
    return ranked


def _label(rank: Column, scale: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in scale]), rank + 1)


def metric_rank(state: Column) -> Column:
    """Metric scale: "unavailable" counts as degraded."""
    return _rank(F.when(state == "unavailable", F.lit("degraded")).otherwise(state), METRIC_STATES)


def metric_label(rank: Column) -> Column:
    return _label(rank, METRIC_STATES)


def track_rank(state: Column) -> Column:
    return _rank(state, TRACK_STATES)


def track_label(rank: Column) -> Column:
    return _label(rank, TRACK_STATES)


def comparison_rank(state: Column) -> Column:
    return _rank(state, COMPARISON_STATES)


def comparison_label(rank: Column) -> Column:
    return _label(rank, COMPARISON_STATES)
