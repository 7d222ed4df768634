"""Best-fit packing of token pieces into sequences, by exact complements on a histogram of lengths.

The plan is made on counts per length, so its size depends on the capacity alone and not
on the number of pieces; the pieces themselves are numbered and placed in parallel.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from fairlead.llm.common import column, field, key_type, keyed, map_batches, per_row
from fairlead.llm.words import word_ids
from fairlead.session import stage


def token_pieces(
    readings: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "metric_id", text: str = "construction_notice"
) -> DataFrame:
    """Encoded notices cut into pieces: ``<key>``, piece, start, length, token_ids (little-endian, 32 bits).

    Every notice ends with ``end_id``; only those longer than ``capacity`` are cut, and
    their last piece may be shorter.  A null notice is an empty one: one piece of the end
    id.  Null and repeated keys are kept as they are; other columns are ignored.
    """
    rows = keyed(readings, key, text=text)
    schema = T.StructType([
        T.StructField("key", key_type(rows)), field("piece", "int"), field("start", "bigint"), field("length", "bigint"),
        field("token_ids", "binary"),
    ])
    ending = int(end_id).to_bytes(4, "little")

    def begin():
        table = word_ids(tokenizer)

        def cut(k, t):
            data = table.ids(t) + ending
            for i, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at:at + 4 * capacity]
                yield k, i, at // 4, len(part) // 4, part

        return cut

    return per_row(rows, begin, schema, lambda r: len(r[4])).withColumnRenamed("key", key)


def checked_pieces(
    readings: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "metric_id", text: str = "construction_notice"
) -> DataFrame:
    """``token_pieces`` with ids_crc32 in place of the ids, written down.

    Packing numbers the pieces in Python too; in one stage with the encoding, each core would
    have two workers, and as workers are shared, both would come to hold the word tables.
    """
    pieces = token_pieces(readings, tokenizer, capacity, end_id, key, text)
    return stage(pieces.withColumn("ids_crc32", F.crc32("token_ids")).drop("token_ids"), "checked-pieces")


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in a row, how many such sequences), from the number of pieces of each length.

    First every length, longest first, takes single, pair and triple sums that fill its gap
    exactly, as many at once as the counts allow; each such step uses up a length, so
    there are at most as many steps as lengths.  The rest goes by best fit, longest
    first, over groups of equal sequences.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(left[x]) // n for x, n in need.items())
        if times:
            plan.append((lengths, times))
            for x, n in need.items():
                left[x] -= n * times

    def pairs(total: int) -> np.ndarray:
        """The larger parts of the pair sums present for a total, longest first."""
        if total < 2:
            return np.zeros(0, np.int64)
        small = np.arange(1, total // 2 + 1)
        return (total - small)[(left[small] > 0) & (left[total - small] > 0)]

    if left[capacity]:
        take((capacity,))
    for a in range(capacity - 1, 0, -1):
        if not left[a]:
            continue
        gap = capacity - a
        if left[gap]:
            take((a, gap))
        for b in pairs(gap):
            if not left[a]:
                break
            take((a, int(b), int(gap - b)))
        if left[a]:
            for b in np.flatnonzero(left[: gap - 1])[::-1]:
                if not left[a]:
                    break
                for c in pairs(int(gap - b)):
                    if c <= b:
                        take((a, int(b), int(c), int(gap - b - c)))
                    if not left[a] or not left[b]:
                        break

    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    open_gaps = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fitting = np.flatnonzero(open_gaps[length:])
            if not len(fitting):
                many = capacity // length
                for size, times in ((many, n // many), (n % many, 1)):
                    if size and times:
                        groups[capacity - size * length].append(((length,) * size, times))
                        open_gaps[capacity - size * length] = True
                break
            gap = length + int(fitting[0])
            lengths, times = groups[gap].pop()
            used = min(n, times)
            if used < times:
                groups[gap].append((lengths, times - used))
            open_gaps[gap] = bool(groups[gap])
            groups[gap - length].append((lengths + (length,), used))
            open_gaps[gap - length] = True
            n -= used
    return plan + [g for same in groups.values() for g in same]


def _numbered(pieces: DataFrame, length: str) -> DataFrame:
    """Pieces with the task that saw them and their number among that task's pieces of the same length."""
    schema = T.StructType([*pieces.schema.fields, field("_bucket", "int"), field("_turn", "bigint")])
    at = pieces.columns.index(length)

    def number(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        bucket, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            turns = []
            for n in batch.column(at).to_pylist():
                turns.append(seen[n])
                seen[n] += 1
            buckets = pa.array([bucket] * len(turns), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, buckets, pa.array(turns, pa.int64())], schema=arrow)

    return map_batches(pieces, number, schema)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, length: str = "length") -> DataFrame:
    """Give every piece its sequence and its place there: the input's columns, sequence_id, offset.

    Sequences hold at most ``capacity`` tokens, offsets are gapless from 0.  Pieces of
    equal length are interchangeable, so repeated rows and ties get places of their own.
    Lengths must lie in 1..capacity.  Input columns named like the two new ones give way
    to them; an empty table gives an empty result.
    """
    kept = pieces.drop("sequence_id", "offset", "_bucket", "_turn")
    numbered = stage(_numbered(kept.withColumn(length, column(length).cast("bigint")), length), "pieces")
    per_task = numbered.groupBy(column(length).alias("_length"), "_bucket").agg(F.count("*").alias("_n"))
    counts = {int(r["_length"]): int(r["n"]) for r in per_task.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}
    wrong = [n for n in counts if not 1 <= n <= capacity]
    if wrong:
        raise ValueError(f"piece lengths outside 1..{capacity}: {sorted(wrong)[:5]}")
    before = Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("_length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))

    runs, first = defaultdict(list), 0
    for lengths, times in plan_sequences(counts, capacity):
        offset = 0
        for x in lengths:
            runs[x].append((times, first, offset))
            offset += x
        first += times
    starts, sequences, offsets = [], [], []
    for x in sorted(runs):
        at = 0
        for times, sequence, offset in runs[x]:
            starts.append((x << 42) + at)
            sequences.append(sequence)
            offsets.append(offset)
            at += times
    table = tuple(np.asarray(v, np.int64) for v in (starts, sequences, offsets))

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(lengths, numbers):
        import pandas as pd

        wanted = (lengths.to_numpy(np.int64) << 42) + numbers.to_numpy(np.int64)
        run = np.searchsorted(table[0], wanted, side="right") - 1
        return pd.DataFrame({"sequence_id": table[1][run] + wanted - table[0][run], "offset": table[2][run]})

    joined = numbered.withColumn("_length", column(length)).join(bases, ["_length", "_bucket"])
    placed = joined.withColumn("_place", place(F.col("_length"), F.col("_base") + F.col("_turn")))
    return placed.select(*[column(c) for c in kept.columns], "_place.sequence_id", "_place.offset")


def packed_sequences(placed: DataFrame) -> DataFrame:
    """The ids of each sequence in a row: sequence_id, token_ids.  A sequence is bounded by the capacity."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "token_ids"))), lambda p: p["token_ids"])
    return placed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p)).alias("token_ids"))
