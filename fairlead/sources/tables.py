"""Observation tables on storage: layout, scoped reads and report sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fairlead import schema


def write_observations(obs: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by observation date, clustered by entity inside each file."""
    (
        obs.withColumn("observed_date", F.to_date("observed_at"))
        # Date and a hash of the entity: a busy day is spread over many writers, an entity stays in few files.
        .repartition("observed_date", F.pmod(F.xxhash64("entity_id"), F.lit(64)))
        .sortWithinPartitions("observed_date", "entity_id", "observed_at")
        .write.mode(mode).partitionBy("observed_date").parquet(path)
    )


def read_observations(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
    modes: list[str] | None = None, entity_types: list[str] | None = None,
) -> DataFrame:
    """Scoped read: date partitions are pruned, the remaining filters reach the scan.

    ``observed_date``, the partition column, stays: later windows prune by it too.
    """
    dated = T.StructType([*schema.OBSERVATION.fields, T.StructField("observed_date", T.DateType())])
    df = spark.read.schema(dated).parquet(path)
    if start:
        df = df.filter(F.col("observed_date") >= F.to_date(F.lit(start).cast("timestamp")))
    if end:
        df = df.filter(F.col("observed_date") <= F.to_date(F.lit(end).cast("timestamp")))
    return scoped(df, start, end, modes, entity_types)


def scoped(
    obs: DataFrame, start: str | None = None, end: str | None = None,
    modes: list[str] | None = None, entity_types: list[str] | None = None,
) -> DataFrame:
    """Filter by modes, entity types and a window with both ends included; every part is optional."""
    if modes is not None:
        obs = obs.filter(F.col("mode").isin(modes))
    if entity_types is not None:
        obs = obs.filter(F.col("entity_type").isin(entity_types))
    if start is not None:
        obs = obs.filter(F.col("observed_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        obs = obs.filter(F.col("observed_at") <= F.lit(end).cast("timestamp"))
    return obs


def _committed(spark: SparkSession, root: str, run_id: str, fmt: str) -> bool:
    marks = f"{root}/commits"
    try:
        found = spark.read.schema("run_id string, tables array<string>").format(fmt).load(marks)
        return not found.filter(F.col("run_id") == run_id).isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":  # no report was written here yet
            return False
        raise


def write_report(tables: dict[str, DataFrame], path: str, run_id: str, fmt: str = "json") -> None:
    """Write the tables of one report as a unit below ``path``.

    The tables go to a folder of the run, and a commit row is written last: a reader sees
    all tables of a run or none.  A run that was committed is not written again; one that
    stopped half way is replaced when it is started anew.
    """
    root, spark = path.rstrip("/"), next(iter(tables.values())).sparkSession
    if _committed(spark, root, run_id, fmt):
        return
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{root}/runs/{run_id}/{name}")
    names = F.array(*[F.lit(name) for name in sorted(tables)])
    spark.range(1).select(F.lit(run_id).alias("run_id"), names.alias("tables")).write.mode("append").format(fmt).save(f"{root}/commits")


def read_report(spark: SparkSession, path: str, run_id: str, schemas: dict[str, T.StructType], fmt: str = "json") -> dict[str, DataFrame]:
    """The tables of a committed report; an uncommitted one is an error."""
    root = path.rstrip("/")
    if not _committed(spark, root, run_id, fmt):
        raise ValueError(f"report {run_id} was not committed")
    return {name: spark.read.schema(shape).format(fmt).load(f"{root}/runs/{run_id}/{name}") for name, shape in schemas.items()}
