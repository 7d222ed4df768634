"""Polygon expressions over a ring column ``array<struct<lat,lon>>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ring_edges(ring: Column) -> Column:
    """Directed edges (vertex, previous vertex) of a ring, closing edge included."""
    previous = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1))
    return F.zip_with(
        ring,
        previous,
        lambda a, b: F.struct(
            a["lat"].alias("lat_i"), a["lon"].alias("lon_i"),
            b["lat"].alias("lat_j"), b["lon"].alias("lon_j"),
        ),
    )


def inside_ring(lat: Column, lon: Column, edges: Column) -> Column:
    """Even-odd ray casting: an odd number of edge crossings means inside."""

    def crosses(e: Column) -> Column:
        straddles = (e["lon_i"] > lon) != (e["lon_j"] > lon)
        lat_on_edge = F.try_divide(
            (e["lat_j"] - e["lat_i"]) * (lon - e["lon_i"]), e["lon_j"] - e["lon_i"]
        ) + e["lat_i"]
        return straddles & (lat < lat_on_edge)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def ring_min(ring: Column, axis: str) -> Column:
    return F.array_min(F.transform(ring, lambda v: v[axis]))


def ring_max(ring: Column, axis: str) -> Column:
    return F.array_max(F.transform(ring, lambda v: v[axis]))
