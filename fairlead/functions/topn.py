"""Top-n per group without ever gathering a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_n_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    spread_on: list[str],
    salts: int = 64,
) -> DataFrame:
    """Keep the first ``n`` rows of each group in ``order``.

    Two phases: every salt of a group keeps its own first n, then the survivors
    (at most salts * n rows per group) are ranked once more.  The result is exact
    for any group size, and a hot group is spread over ``salts`` tasks.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), F.lit(salts)))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(local))
        .filter(F.col("_rank") <= n)
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= n)
        .drop("_salt", "_rank")
    )
