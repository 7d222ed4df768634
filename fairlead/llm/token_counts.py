"""Token counts by field and section: whole records encoded once, token spans joined to the spans of their parts."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, types as T

from fairlead.llm.common import field, key_type, keyed, per_row

# Fields of a facility reading in the order they are rendered; the last may have sections.
FIELDS = ("display_name", "port_status", "construction_notice")
RULES = ("first", "last", "most")


@lru_cache(maxsize=1)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:  # a file of the worker's own installation
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, number in ranks.items():
        lengths[number] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def allocate(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The part of each token span, and whether the span crosses a border.

    ``borders``: start of every part in ascending order and the end of the last.  Spans and
    parts are both sorted, so the join is a search of each end among the borders.  A span
    over several parts goes to the one with its ``first`` or ``last`` character, or to the
    one with ``most`` of its characters, the earlier on a tie.
    """
    first = np.searchsorted(borders, starts, side="right") - 1
    last = np.searchsorted(borders, np.maximum(ends - 1, starts), side="right") - 1
    crossing = first < last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    chosen = first.copy()
    for i in np.flatnonzero(crossing):
        parts = np.arange(first[i], last[i] + 1)
        shares = np.minimum(borders[parts + 1], ends[i]) - np.maximum(borders[parts], starts[i])
        chosen[i] = parts[int(np.argmax(shares))]
    return chosen, crossing


def token_counts(
    readings: DataFrame, ranks: str, pattern: str, key: str = "metric_id", fields: tuple[str, ...] = FIELDS, rule: str = "most",
    sections: bool = True,
) -> DataFrame:
    """Tokens of each field of a record, and of each line of its last field, when the record is encoded as one text.

    A record is its fields in the given order, one below the other.  ``ranks`` and
    ``pattern``: a byte-level vocabulary file, readable on every worker, and its split
    pattern.  The record is encoded once; the character span of a token decides its part by
    ``rule`` (see ``allocate``), so counts of the parts add up to the tokens of the record.
    A line break belongs to the part it ends.

    One row per part: ``<key>``, field, section (line number, 0 without sections), n_chars,
    n_tokens, n_crossing (of its tokens, those that reach into another part).  A part
    without tokens has a row with 0.  Null fields are empty; null and repeated keys are
    kept; an empty table gives an empty result; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = keyed(readings, key, **{f"f{i}": name for i, name in enumerate(fields)})
    schema = T.StructType([
        T.StructField("key", key_type(rows)), field("field", "string"), field("section", "int"), field("n_chars", "bigint"),
        field("n_tokens", "bigint"), field("n_crossing", "bigint"),
    ])

    def begin():
        encoding, lengths = _encoding(ranks, pattern)

        def count(key, *values):
            parts = [(name, 0, value + "\n") for name, value in zip(fields[:-1], values)]
            final = values[-1].split("\n") if sections else [values[-1]]
            parts += [(fields[-1], i, line + "\n" * (i < len(final) - 1)) for i, line in enumerate(final)]
            text = "".join(p[2] for p in parts)
            ids = np.asarray(encoding.encode_ordinary(text), np.int64)
            n_chars = np.asarray([len(p[2]) for p in parts], np.int64)
            borders = np.concatenate([[0], np.cumsum(n_chars)])
            ends = np.cumsum(lengths[ids])
            starts = ends - lengths[ids]
            if not text.isascii():  # from bytes to the characters they lie in
                place = np.cumsum((np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0) != 0x80)
                starts, ends = place[starts] - 1, place[ends - 1]
            part, crossing = allocate(starts, ends, borders, rule)
            tokens = np.bincount(part, minlength=len(parts))
            across = np.bincount(part[crossing], minlength=len(parts))
            return zip([key] * len(parts), (p[0] for p in parts), (p[1] for p in parts), n_chars.tolist(), tokens.tolist(), across.tolist())

        return count

    return per_row(rows, begin, schema).withColumnRenamed("key", key)
