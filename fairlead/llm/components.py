"""Connected components of link tables, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fairlead.session import stage


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Node and smallest node of its component, for every node that has a link: node, root.

    Each step replaces a node's links by links to its smallest neighbour, first among
    larger nodes and then among smaller ones; the number of steps grows with the logarithm
    of the longest path.  Nothing is gathered per node: minima combine map-side and are
    joined back from written tables, so a node with very many links is split.
    """
    edges = stage(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links"
    )
    seen = _fingerprint(edges)
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        large = stage(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star"
        )
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least, "u")
        edges = stage(
            small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .filter("u <> v").distinct(),
            "small-star",
        )
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
