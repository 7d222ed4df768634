"""Token-id files as directly addressable codes: any token of any notice without decoding a block.

A file set is a folder with two Parquet tables, so that it lives in any store Spark can
write: ``segments`` (one row per run of whole notices, each level of its codes in a column
of its own) and ``shards`` (one row per writing task: the number of ids before it).

An id is split into chunks of 8, 4, 4 and 16 bits, low bits first.  Level k holds the k-th
chunk of the ids that need one, a bitmap that tells which of them go on to level k + 1, and
a rank directory with the number of set bits before every 512th; following the ranks
finds one id by a few reads.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from fairlead.llm.common import field, key_type, keyed, map_batches, per_row
from fairlead.llm.words import word_ids

WIDTHS = (8, 4, 4, 16)
RANK_BITS = 512
# A segment is closed once it has this many ids; a longer notice is a segment of its own.
SEGMENT_IDS = 1 << 19

_LEVEL = "struct<chunks: binary, continues: binary, ranks: binary>"


def _pack(values: np.ndarray, width: int) -> bytes:
    if width == 4:
        even = np.zeros(len(values) + len(values) % 2, np.uint8)
        even[: len(values)] = values
        return (even[0::2] | (even[1::2] << 4)).tobytes()
    return values.astype("<u1" if width == 8 else "<u2").tobytes()


def _unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width == 4:
        both = np.frombuffer(data, np.uint8)
        return np.column_stack([both & 15, both >> 4]).ravel()[:n].astype(np.uint32)
    return np.frombuffer(data, "<u1" if width == 8 else "<u2").astype(np.uint32)


def encode_levels(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """The levels of a run of unsigned 32-bit ids; ends with the first level that no id leaves."""
    levels, rest = [], ids.astype(np.uint32)
    for width in WIDTHS:
        chunk = rest & np.uint32((1 << width) - 1)
        rest = rest >> np.uint32(width)
        goes_on = rest > 0
        padded = np.zeros(-(-len(goes_on) // RANK_BITS) * RANK_BITS, np.uint8)
        padded[: len(goes_on)] = goes_on
        bits = np.packbits(padded, bitorder="little")
        set_bits = padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(set_bits, dtype=np.uint32)]).astype("<u4")
        levels.append((_pack(chunk, width), bits.tobytes(), ranks.tobytes()))
        rest = rest[goes_on]
        if not len(rest):
            break
    return levels


def decode_levels(levels: list[tuple[bytes, bytes, bytes]], n: int) -> np.ndarray:
    """All ids of a segment, level by level."""
    ids, at, shift = np.zeros(n, np.uint32), np.arange(n), 0
    for width, (chunks, continues, _) in zip(WIDTHS, levels):
        ids[at] |= _unpack(chunks, width, len(at)) << np.uint32(shift)
        goes_on = np.unpackbits(np.frombuffer(continues, np.uint8), count=len(at), bitorder="little").astype(bool)
        at, shift = at[goes_on], shift + width
    return ids


def ids_at(levels: list[tuple[bytes, bytes, bytes]], positions: np.ndarray) -> np.ndarray:
    """The ids at some positions of a segment, each by following its chunks down the rank directories."""
    out = np.zeros(len(positions), np.uint32)
    rows, at, shift = np.arange(len(positions)), np.asarray(positions, np.int64), 0
    for width, (chunks, continues, ranks) in zip(WIDTHS, levels):
        data = np.frombuffer(chunks, "<u2" if width == 16 else np.uint8)
        value = data[at].astype(np.uint32) if width != 4 else ((data[at >> 1] >> ((at & 1) * 4)) & 15).astype(np.uint32)
        out[rows] |= value << np.uint32(shift)
        words = np.frombuffer(continues, "<u8")
        within = np.uint64(1) << (at & 63).astype(np.uint64)
        goes_on = (words[at >> 6] & within) > 0
        rows, at, within, shift = rows[goes_on], at[goes_on], within[goes_on], shift + width
        if not len(at):
            break
        block = at // RANK_BITS
        below = np.frombuffer(ranks, "<u4")[block].astype(np.int64)
        for k in range(RANK_BITS // 64):  # whole words of the block before the bit's own
            word = block * (RANK_BITS // 64) + k
            below += np.where(word < at >> 6, np.bitwise_count(words[np.minimum(word, len(words) - 1)]), 0)
        at = below + np.bitwise_count(words[at >> 6] & (within - np.uint64(1)))
    return out


def write_token_files(
    readings: DataFrame, path: str, tokenizer: str, end_id: int | None = None, key: str = "metric_id", text: str = "construction_notice"
) -> None:
    """Encode every notice and write a file set below ``path``, in ascending order of ``key``.

    ``tokenizer``: path of the word BPE file, readable on every worker.  ``end_id`` is
    appended to each notice.  A null notice is an empty one; null keys come first; rows
    with the same key follow each other by text; an empty table gives a file set without
    segments.  Other columns are ignored.
    """
    rows = keyed(readings, key, text=text)
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    schema = T.StructType([
        field("shard", "int"), field("segment", "int"), field("first", "bigint"), field("n_ids", "bigint"),
        T.StructField("keys", T.ArrayType(key_type(rows))), field("lengths", "array<bigint>"), field("levels", f"array<{_LEVEL}>"),
    ])
    ending = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def encode(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        table, shard = word_ids(tokenizer), TaskContext.get().partitionId()
        keys, parts, segment, first, held = [], [], 0, 0, 0

        def close():
            ids = np.frombuffer(b"".join(parts), "<u4")
            levels = [dict(zip(("chunks", "continues", "ranks"), level)) for level in encode_levels(ids)]
            row = (shard, segment, first, len(ids), keys, [len(p) // 4 for p in parts], levels)
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = table.ids(t) + ending
                    if held and held + len(data) // 4 > SEGMENT_IDS:
                        yield close()
                        keys, parts, segment, first, held = [], [], segment + 1, first + held, 0
                    keys.append(k)
                    parts.append(data)
                    held += len(data) // 4
        if keys:
            yield close()

    segments = f"{path.rstrip('/')}/segments"
    map_batches(ordered, encode, schema).write.parquet(segments)
    spark = readings.sparkSession
    shards = spark.read.schema(schema).parquet(segments).groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    # One row per writing task, not per notice: small enough for one ordered pass.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{path.rstrip('/')}/shards")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    root = path.rstrip("/")
    return spark.read.parquet(f"{root}/segments"), spark.read.parquet(f"{root}/shards").select("shard", "before")


def read_token_files(spark: SparkSession, path: str, key: str = "metric_id") -> DataFrame:
    """The notices of a file set: ``<key>``, start (ids of all notices before it), n_tokens, token_ids.

    ``token_ids`` are little-endian unsigned 32-bit integers.
    """
    segments, shards = _tables(spark, path)
    kind = segments.schema["keys"].dataType.elementType
    schema = T.StructType([
        T.StructField("key", kind), field("start", "bigint"), field("n_tokens", "bigint"), field("token_ids", "binary"),
    ])

    def begin():
        def decode(before, first, n_ids, keys, lengths, levels):
            ids = decode_levels([(v["chunks"], v["continues"], v["ranks"]) for v in levels], n_ids).astype("<u4")
            at = 0
            for k, n in zip(keys, lengths):
                yield k, before + first + at, n, ids[at:at + n].tobytes()
                at += n

        return decode

    rows = segments.join(shards, "shard").select("before", "first", "n_ids", "keys", "lengths", "levels")
    return per_row(rows, begin, schema, lambda r: len(r[3])).withColumnRenamed("key", key)


def tokens_at(positions: DataFrame, path: str, position: str = "position") -> DataFrame:
    """The token id at each asked position of the whole file set: position, token_id.

    Positions outside, null or repeated: no row, no row, one row.  Only the asked
    positions of a segment meet its codes; nothing else of the segment is decoded.
    """
    spark = positions.sparkSession
    segments, shards = _tables(spark, path)
    placed = segments.join(shards, "shard").withColumn("low", F.col("before") + F.col("first")).withColumn("high", F.col("low") + F.col("n_ids"))
    # Ranges meet positions by equi-join on the stretches of SEGMENT_IDS positions that a segment touches.
    cover = placed.filter("n_ids > 0").select(
        "shard", "segment", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") / SEGMENT_IDS), F.floor((F.col("high") - 1) / SEGMENT_IDS))).alias("stretch"),
    )
    asked = positions.select(F.col(position).cast("bigint").alias("position")).distinct().withColumn(
        "stretch", F.floor(F.col("position") / SEGMENT_IDS)
    )
    found = (
        asked.join(cover, "stretch").filter("position >= low and position < high")
        .groupBy("shard", "segment").agg(F.collect_list(F.col("position") - F.col("low")).alias("asked"), F.first("low").alias("low"))
    )
    rows = found.join(segments.select("shard", "segment", "levels"), ["shard", "segment"]).select("low", "asked", "levels")

    def begin():
        def look(low, asked, levels):
            values = ids_at([(v["chunks"], v["continues"], v["ranks"]) for v in levels], np.asarray(asked))
            return zip((low + p for p in asked), map(int, values))

        return look

    return per_row(rows, begin, T.StructType([field("position", "bigint"), field("token_id", "bigint")]))
