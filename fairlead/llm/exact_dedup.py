"""Exact duplicates of notices by deterministic block naming.

A text is cut into fixed-size blocks; the distinct blocks are sorted into integer names;
adjacent names are paired and the sorted pairs named again, until one name is left per
text.  Equal names mean equal texts at every level, so the last one (with the level it was
reached at) is a collision-free identity.
"""

from __future__ import annotations

import hashlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from fairlead.llm.common import field, key_type, keyed, per_row
from fairlead.session import stage

BLOCK_BYTES = 8192


def _digest(block: bytes) -> bytes:
    return hashlib.md5(block).digest()


def _blocks(rows: DataFrame, block_bytes: int, digest) -> DataFrame:
    """One row per block: row (number of its input row), key, n_blocks, pos, digest, text_sha256 (at pos 0), block."""
    schema = T.StructType([
        field("row", "bigint"), T.StructField("key", key_type(rows)), field("n_blocks", "int"), field("pos", "int"),
        field("digest", "binary"), field("text_sha256", "string"), field("block", "binary"),
    ])

    def begin():
        row = TaskContext.get().partitionId() << 40

        def cut(key, text):
            nonlocal row
            data = text.encode("utf-8").lower()  # bytes.lower: A-Z alone
            n = max(1, -(-len(data) // block_bytes))
            for pos in range(n):
                block = data[pos * block_bytes:(pos + 1) * block_bytes]
                yield row, key, n, pos, digest(block), hashlib.sha256(data).hexdigest() if pos == 0 else None, block
            row += 1

        return cut

    return per_row(rows, begin, schema, lambda r: len(r[6]))


def _names(items: DataFrame, by: list[str]) -> DataFrame:
    """An integer per distinct item, in sorted order; written down, so that a rerun task cannot name anew."""
    ordered = items.select(*by).distinct().repartitionByRange(*by).sortWithinPartitions(*by)
    return stage(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def _identities(readings: DataFrame, key: str, text: str, block_bytes: int, digest) -> DataFrame:
    """row, key, text_sha256, level, name of every reading, written down."""
    rows = keyed(readings, key, text=text)
    blocks = _blocks(rows, block_bytes, digest)
    # Every distinct block is compared in full here: one digest must stand for one block.
    per_digest = stage(blocks.select("digest", "block").distinct().groupBy("digest").agg(F.count("*").alias("blocks")), "digests")
    if per_digest.filter("blocks > 1").isEmpty():
        pieces, by, names = stage(blocks.drop("block"), "blocks"), ["digest"], _names(per_digest, ["digest"])
    else:  # unequal blocks share a digest: name and join by the blocks themselves
        pieces, by = stage(blocks, "blocks"), ["digest", "block"]
        names = _names(pieces, by)
    current = stage(pieces.join(names, by).select("row", "pos", "name", F.col("n_blocks").alias("left")), "named")
    longest = pieces.agg(F.max("n_blocks")).first()[0] or 1
    done, level = [], 0
    while True:
        done.append(current.filter("left = 1").select("row", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        pairs = stage(
            current.filter("left > 1").groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos"), "left").agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
            ),
            "pairs",
        )
        current = stage(
            pairs.join(_names(pairs, ["first", "second"]), ["first", "second"]).select(
                "row", "pos", "name", F.floor((F.col("left") + 1) / 2).cast("int").alias("left")
            ),
            "named",
        )
        longest, level = (longest + 1) // 2, level + 1
    identity = done[0]
    for part in done[1:]:
        identity = identity.unionByName(part)
    heads = pieces.filter("pos = 0").select("row", "key", "text_sha256")
    return stage(heads.join(identity, "row"), "identities")


def exact_duplicates(
    readings: DataFrame, key: str = "metric_id", text: str = "construction_notice", block_bytes: int = BLOCK_BYTES, digest=_digest
) -> DataFrame:
    """Groups of readings whose notices are equal after lower-casing A-Z; the largest key stays.

    One row per input row: ``<key>``, keep_id (key of the reading that stays), group_size,
    kept, text_sha256 (of the normalised text), level and name (the identity).

    A null notice equals an empty one.  Of repeated rows with the same key one stays; a
    null key stays only in a group without any other.  An empty table gives an empty
    result; other columns are ignored.  ``digest`` only addresses blocks: unequal blocks
    that share one are found by comparing them, and are then named by their bytes.
    Groups are counted map-side and joined back from a table, where a hot one is split.
    """
    found = _identities(readings, key, text, block_bytes, digest)
    groups = stage(
        found.groupBy("level", "name").agg(
            F.max("key").alias("keep_id"), F.count("*").alias("group_size"),
            F.coalesce(F.max_by("row", "key"), F.max("row")).alias("_keep_row"),
        ),
        "groups",
    )
    return found.join(groups, ["level", "name"]).select(
        F.col("key").alias(key), "keep_id", "group_size", (F.col("row") == F.col("_keep_row")).alias("kept"), "text_sha256", "level", "name"
    )
