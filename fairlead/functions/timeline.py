"""Exact time arithmetic on microsecond integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

MICROS = 1_000_000


def micros(column: Column | str) -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def seconds_between(earlier: Column, later: Column) -> Column:
    """Seconds (double) between two timestamps, without rounding to seconds."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS))


def plus_micros(column: Column, delta: Column | int) -> Column:
    step = delta if isinstance(delta, Column) else F.lit(delta)
    return F.timestamp_micros(F.unix_micros(column) + step)


def round_half_up(value: Column, digits: int = 0) -> Column:
    """floor(x * 10^n + 0.5) / 10^n: the half-up rule used for labels and keys."""
    scale = float(10**digits)
    rounded = F.floor(value * F.lit(scale) + F.lit(0.5))
    return rounded if digits == 0 else rounded / F.lit(scale)


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to timestamp, null when it is anything else."""
    shaped = text.rlike(r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s?(Z|[+-]\d{2}:?\d{2})?)?)?)?$")
    colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    with_time = text.rlike(r"\d{2}:\d{2}")
    return F.when(shaped, F.when(with_time, colon).otherwise(text).try_cast("timestamp"))


def iso_text(column: Column) -> Column:
    """Timestamp to ISO text in UTC; whole seconds print without a fraction."""
    whole = F.unix_micros(column) % F.lit(MICROS) == 0
    return F.when(whole, F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    )


def with_micros(df: DataFrame) -> DataFrame:
    """Replace every timestamp column ``x`` by a bigint column ``x_us``."""
    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampType):
            out.append(F.unix_micros(F.col(f"`{field.name}`")).alias(f"{field.name}_us"))
        else:
            out.append(F.col(f"`{field.name}`"))
    return df.select(*out)
