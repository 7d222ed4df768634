"""Compression bands: quality rules over the free-text notice of facility readings."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, types as T

from fairlead.llm.common import column, field, key_type, keyed, map_batches, per_row

_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class BandSettings:
    """Limits of the rules.

    ``bands``: (least UTF-8 bytes, lowest ratio, highest ratio) of compressed to plain
    size of a whole notice, by ascending size; a notice below the first band is judged by
    the base rules only, because a frame header dominates its ratio.  ``chunk_band`` holds
    for each fixed chunk of ``chunk_bytes``; a last chunk shorter than half of that is left
    to the whole-text ratio.  A notice with more than ``chunk_share`` of its chunks
    outside is rejected.
    """

    bands: tuple[tuple[int, float, float], ...] = (
        (128, 0.35, 1.05), (256, 0.30, 0.95), (512, 0.25, 0.88), (1024, 0.22, 0.80), (4096, 0.18, 0.72), (16384, 0.15, 0.70),
    )
    chunk_bytes: int = 4096
    chunk_band: tuple[float, float] = (0.18, 0.75)
    chunk_share: float = 0.25
    level: int = 3
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30


def repeated_words(words: list[str], window: int) -> int:
    """Words that lie in some window of ``window`` words occurring twice or more in the list.

    Windows are named exactly: equal names at width w and w + step mean equal words, by
    doubling, so no hash is trusted.
    """
    n = len(words)
    if n <= window:
        return 0
    table: dict[str, int] = {}
    base = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, n)
    name, width = base, 1
    while width < window:
        step = min(width, window - width)
        left, right = name[: len(name) - step], name[step:]
        _, name = np.unique(left * (int(name.max()) + 1) + right, return_inverse=True)
        width += step
        if int(name.max()) + 1 == len(name):
            return 0
    twice = np.bincount(name)[name] > 1
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def _judge(settings: BandSettings):
    import zstandard

    compressor = zstandard.ZstdCompressor(level=settings.level)

    def ratio(data: bytes) -> float:
        return len(compressor.compress(data)) / len(data)

    def judge(key, text):
        words = [w for w in _SPACE.split(text) if w]
        n_words = len(words)
        word_chars = sum(map(len, words))
        n_symbols = len(_SYMBOL.findall(text))
        lines = [x for x in text.split("\n") if x and not _SPACE.fullmatch(x)]
        n_dup_lines = len(lines) - len(set(lines))
        n_repeat = repeated_words(words, settings.window)
        base_failed = n_words < settings.min_words or 100 * n_repeat > settings.max_repeat_percent * n_words
        data = text.encode("utf-8")
        whole = ratio(data) if data else None
        low, high = None, None
        for least, lowest, highest in settings.bands:
            if len(data) >= least:
                low, high = lowest, highest
        chunks = outside = 0
        if len(data) > settings.chunk_bytes:
            for start in range(0, len(data), settings.chunk_bytes):
                piece = data[start:start + settings.chunk_bytes]
                if 2 * len(piece) >= settings.chunk_bytes:
                    chunks += 1
                    outside += not settings.chunk_band[0] <= ratio(piece) <= settings.chunk_band[1]
        reason = None
        if base_failed:
            reason = "base"
        elif low is not None and whole < low:
            reason = "repetitive"
        elif high is not None and whole > high:
            reason = "incompressible"
        elif outside > settings.chunk_share * chunks:
            reason = "chunks"
        yield (key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, reason is None, reason, whole, chunks, outside)

    return judge


def notice_quality(
    readings: DataFrame, key: str = "metric_id", text: str = "construction_notice", settings: BandSettings = BandSettings()
) -> DataFrame:
    """One verdict per reading from compression ratios of its notice, with the counts behind it.

    Columns: ``<key>``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, reject_reason (null, ``base``, ``repetitive``, ``incompressible`` or
    ``chunks``), ratio, n_chunks, n_chunks_outside.  A ratio is the zstandard size over
    the UTF-8 size; the limits depend on the length (``BandSettings``).

    Each row is judged by itself without a shuffle, over its whole text.  A null notice is
    an empty one: no words, base_failed, ratio null.  Repeated rows get equal verdicts, a
    null key stays null, an empty table gives an empty result, other columns are ignored.
    """
    rows = keyed(readings, key, text=text)
    schema = T.StructType([
        T.StructField("key", key_type(rows)), *[field(n, "bigint") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        field("base_failed", "boolean"), field("kept", "boolean"), field("reject_reason", "string"), field("ratio", "double"),
        field("n_chunks", "bigint"), field("n_chunks_outside", "bigint"),
    ])
    return per_row(rows, lambda: _judge(settings), schema).withColumnRenamed("key", key)


def kept_notices(readings: DataFrame, text: str = "construction_notice", settings: BandSettings = BandSettings()) -> DataFrame:
    """The readings that ``notice_quality`` keeps, with all their columns; decided row by row where they are read."""
    at = readings.columns.index(text)

    def run(batches):
        import pyarrow as pa

        judge = _judge(settings)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                keep = [next(iter(judge(None, t or "")))[7] for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return map_batches(readings.withColumn(text, column(text).cast("string")), run, T.StructType([
        T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in readings.schema
    ]))
