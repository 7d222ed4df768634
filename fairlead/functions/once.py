"""Evaluate expensive columns once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def evaluate_once(df: DataFrame, kept: list[str], columns: dict[str, str | Column]) -> DataFrame:
    """``kept`` columns plus the computed ones, behind a one-element ``inline``.

    A plain projection is copied into every filter and expression that uses its
    columns; for long validation rules that means evaluating (and compiling) them
    many times.  Nothing is pushed through a generator, so each is evaluated once.
    """
    fields = [(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return df.select(*kept, F.inline(F.array(F.struct(*fields))))
