"""Merkle manifest of facility readings: a hash tree per provider and one over the providers, with proofs.

A node is labelled by the interval of leaf ranks that it covers: [lo, hi) of its tree at its
level.  Nothing points to a parent.  Ancestors are found by joins on the level and the
bucket of ranks that a parent of this level covers; among the nodes of such a bucket the one
whose interval contains a leaf is its ancestor, and the rest of the parent's interval are
the siblings.  Levels go in steps of STEP: a leaf meets the nodes of the first levels only
and takes the rest of its path from its ancestor at the step's end, which took it from its
own, so no node meets more than 2^STEP others, the root included.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from fairlead.llm.common import column, field, free_name, per_row
from fairlead.session import stage

STEP = 8

_STEPS = "array<struct<level: int, before: boolean, node: binary>>"


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _value(value: Column) -> Column:
    """A field in a leaf: '-' for null, else its UTF-8 length, ':' and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(values: list[Column]) -> Column:
    return _hash(F.concat(*map(_value, values)))


def _ranked(leaves: DataFrame) -> DataFrame:
    """Leaves (part, key, node, ...) with lo (rank within the part by key), n (leaves of the part), height.

    One sort by ranges; ranks come from row numbers inside the ranges and the small table of
    runs (one per range and part), so a part of any size is ranked by many tasks.
    """
    ordered = leaves.repartitionByRange("part", "key", "node").sortWithinPartitions("part", "key", "node")
    placed = stage(ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("shard", F.shiftright("at", 33)), "ordered-leaves")
    runs = placed.groupBy("part", "shard").agg(F.min("at").alias("first"), F.count("*").alias("length"))
    part = Window.partitionBy("part")
    earlier = part.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "part", "shard", F.sum("length").over(part).alias("n"),
        (F.coalesce(F.sum("length").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
    )
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    return stage(
        placed.join(runs, ["part", "shard"]).withColumn("lo", F.col("at") + F.col("shift")).withColumn("height", height)
        .drop("at", "shard", "shift"),
        "ranked-leaves",
    )


def _steps(ranked: DataFrame) -> int:
    """Steps of levels that the highest tree has."""
    height = ranked.agg(F.max("height")).first()[0] or 0
    return -(-height // STEP)


def _nodes(ranked: DataFrame, steps: int) -> DataFrame:
    """All nodes: part, height, level, lo, hi, node (the leaves at level 0).

    Per step the nodes of each 2^STEP ranks of the step's first level meet in one row, which
    grows all the levels above them up to the step's end.
    """
    schema = T.StructType([
        field("part", "string"), field("n", "bigint"), field("height", "int"), field("level", "int"), field("lo", "bigint"),
        field("hi", "bigint"), field("node", "binary"),
    ])

    def begin():
        def grow(part, n, height, level, lo, nodes):
            nodes = [node.hex() for node in nodes]
            for above in range(level + 1, min(level + STEP, height) + 1):
                nodes = [hashlib.sha256("".join(nodes[i:i + 2]).encode()).hexdigest() for i in range(0, len(nodes), 2)]
                for i, node in enumerate(nodes):
                    at = lo + (i << above)
                    yield part, n, height, above, at, min(at + (1 << above), n), bytes.fromhex(node)

        return grow

    found = base = ranked.select(
        "part", "n", "height", F.lit(0).alias("level"), "lo", (F.col("lo") + 1).alias("hi"), "node"
    )
    for step in range(steps):
        low, high = step * STEP, (step + 1) * STEP
        gathered = (
            base.filter(F.col("height") > low).groupBy("part", "n", "height", F.shiftleft(F.shiftright("lo", high), high).alias("first"))
            .agg(F.sort_array(F.collect_list(F.struct("lo", "node"))).alias("run"))
            .select("part", "n", "height", F.lit(low).alias("level"), "first", F.col("run.node").alias("nodes"))
        )
        grown = stage(per_row(gathered, begin, schema, lambda row: 100), "tree-nodes")
        base = grown.filter(F.col("level") == high)
        found = found.unionByName(grown)
    return found.drop("n")


def _paths(ranked: DataFrame, nodes: DataFrame, steps: int, tops: DataFrame) -> DataFrame:
    """part, lo, path, subroot, root of every leaf.

    ``path`` lists, level by level up to the root of all, the sibling and whether it stands
    before; a level without a sibling has a null one.  ``tops``: part, path, subroot, root
    of each part's own root.
    """
    upper = None
    for step in reversed(range(max(steps, 1))):
        low, high = step * STEP, (step + 1) * STEP
        entries = ranked.select("part", "lo", "height") if step == 0 else nodes.filter(
            (F.col("level") == low) & (F.col("height") > low)
        ).select("part", "lo", "height")
        asked = entries.filter(F.col("height") > low).select(
            "part", "lo", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.col("height")) - 1)).alias("level")
        ).withColumn("bucket", F.expr("shiftright(lo, level + 1)"))
        # The children of each parent of these levels, by the bucket of ranks that the parent covers.
        children = nodes.filter((F.col("level") >= low) & (F.col("level") < F.least(F.lit(high), F.col("height")))).select(
            "part", "level", F.expr("shiftright(lo, level + 1)").alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"), "node"
        )
        met = asked.join(children, ["part", "level", "bucket"])
        # Which child contains the leaf is its ancestor; the others are what its interval leaves of the parent's.
        sibling = (F.col("from") > F.col("lo")) | (F.col("to") <= F.col("lo"))
        step_of = F.when(sibling, F.struct("level", (F.col("to") <= F.col("lo")).alias("before"), "node"))
        alone = F.struct("level", F.lit(None).cast("boolean").alias("before"), F.lit(None).cast("binary").alias("node"))
        own = met.groupBy("part", "lo").agg(
            F.sort_array(F.collect_list(step_of)).alias("with_sibling"),
            F.sort_array(F.collect_set(F.when(~sibling, alone))).alias("ancestors"),
        )
        levels = F.transform("ancestors", lambda a: F.coalesce(
            F.get(F.filter("with_sibling", lambda s: s["level"] == a["level"]), 0), a
        ))
        own = own.select("part", "lo", levels.cast(_STEPS).alias("own"))
        rows = entries.join(own, ["part", "lo"], "left")
        ends = rows.filter(F.col("height") <= high).join(tops, "part")
        found = ends
        if upper is not None:
            going_on = rows.filter(F.col("height") > high).withColumn("above", F.shiftleft(F.shiftright("lo", high), high))
            found = ends.unionByName(
                going_on.join(upper.withColumnRenamed("lo", "above"), ["part", "above"]).drop("above")
            )
        empty = F.array().cast(_STEPS)
        found = found.select("part", "lo", F.concat(F.coalesce("own", empty), "path").alias("path"), "subroot", "root")
        upper = found if step == 0 else stage(found, "tree-paths")
    return upper


def _folded(start: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path, in hex."""
    return F.aggregate(path, start, lambda at, s: F.sha2(
        F.when(s["before"], F.concat(_hex(s["node"]), at)).when(~s["before"], F.concat(at, _hex(s["node"]))).otherwise(at), 256
    ))


def merkle_manifest(
    readings: DataFrame, key: str = "metric_id", part: str = "provider_id",
    fields: tuple[str, ...] = ("metric_id", "provider_id", "display_name", "port_status", "construction_notice"),
    claimed: dict[str, Column] | None = None,
) -> DataFrame:
    """The manifest of a table of readings: each reading's leaf, its roots and its proof, checked.

    A leaf hashes ``fields`` in their order (SHA-256; '-' for null, else UTF-8 length, ':'
    and value).  Leaves of one ``part`` ascend by ``key``, nulls first; every two consecutive
    nodes become the hash of their digests until one is left, the subroot.  Subroots by part
    (null first, bytewise) lead to the root in the same way.  ``claimed`` replaces fields by
    what somebody claims they are: the claimed leaf is folded with the original siblings.

    Columns: key, part, leaf, subroot, root, path (siblings level by level, ``before`` tells
    their side), proof_sha256 (hash of the siblings, left out where a node is alone),
    folded_root, verified.  Rows with the same key stand by leaf; equal rows are leaves of
    their own.  A part with one reading has its leaf as subroot.  Other columns are ignored;
    an empty table has an empty manifest.
    """
    claimed = claimed or {}
    held = free_name(readings, "claimed")
    rows = readings.withColumn(held, _leaf([claimed.get(name, column(name)) for name in fields]))
    leaves = stage(rows.select(
        F.coalesce(F.concat(F.lit("="), column(part).cast("string")), F.lit("-")).alias("part"), column(key).alias("key"),
        _leaf([column(name) for name in fields]).alias("node"), F.col(held).alias("claimed"),
    ), "leaves")
    ranked = _ranked(leaves)
    steps = _steps(ranked)
    nodes = _nodes(ranked, steps)

    subroots = nodes.filter(F.col("level") == F.col("height")).select(
        F.lit("").alias("part"), F.col("part").alias("key"), "node"
    )
    over = _ranked(subroots)
    over_steps = _steps(over)
    over_nodes = _nodes(over, over_steps)
    root = over_nodes.filter(F.col("level") == F.col("height")).select(
        "part", F.array().cast(_STEPS).alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root")
    )
    over_paths = _paths(over, over_nodes, over_steps, root).select("lo", "path", "root")
    tops = stage(
        over.select(F.col("key").alias("part"), "lo", F.col("node").alias("subroot")).join(over_paths, "lo").drop("lo"), "subroots"
    )

    paths = _paths(ranked, nodes, steps, tops)
    siblings = F.transform(F.filter("path", lambda s: s["node"].isNotNull()), lambda s: _hex(s["node"]))
    return ranked.select("part", "lo", "key", "node", "claimed").join(paths, ["part", "lo"]).select(
        F.col("key").alias(key), F.when(F.col("part") != "-", F.substring("part", 2, 1 << 30)).alias(part if part != key else free_name(readings, part)),
        _hex(F.col("node")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), "path",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), _folded(_hex(F.col("claimed")), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
