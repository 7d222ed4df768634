"""Exact grouped median by distributed selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def exact_median(df: DataFrame, keys: list[str], value: str, coarse: int, out: str) -> DataFrame:
    """Median of an integer column per group: the mean of the two middle values.

    Values are first counted (combined map-side), the counts are summed over
    coarse ranges of ``coarse`` units, and only the one or two ranges that hold
    a middle rank are looked at in detail.  No group is gathered as a whole: a
    task sees the coarse counts of a group or the distinct values of one range.
    """
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_bin", F.floor(F.col("_v") / F.lit(coarse)))

    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bin_n"))
    ordered = Window.partitionBy(*keys).orderBy("_bin")
    whole = Window.partitionBy(*keys)
    bins = (
        bins.withColumn("_total", F.sum("_bin_n").over(whole))
        .withColumn(
            "_before",
            F.coalesce(F.sum("_bin_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("_lo", F.floor((F.col("_total") + 1) / 2))
        .withColumn("_hi", F.floor(F.col("_total") / 2) + 1)
        .filter((F.col("_hi") > F.col("_before")) & (F.col("_lo") <= F.col("_before") + F.col("_bin_n")))
    )
    inner = Window.partitionBy(*keys, "_bin").orderBy("_v")
    picked = (
        counts.join(bins, [*keys, "_bin"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inner))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
    )

    def holds(rank: str):
        return (F.col(rank) > F.col("_from")) & (F.col(rank) <= F.col("_upto"))

    middle = picked.filter(holds("_lo") | holds("_hi"))
    return middle.groupBy(*keys).agg(
        (
            (F.max(F.when(holds("_lo"), F.col("_v"))) + F.max(F.when(holds("_hi"), F.col("_v")))) / F.lit(2.0)
        ).alias(out)
    )
