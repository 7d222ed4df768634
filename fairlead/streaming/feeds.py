"""Feed operators as Structured Streaming queries.

Each function takes and returns a streaming DataFrame; ``run_available`` drives
one to the end of the landed files.

Windowed streams take an optional ``horizon``.  Without one no row is ever late: run them
in ``complete`` mode, which also delivers windows that are still open.  With one the
state is bounded by a watermark and ``append`` mode delivers closed windows only; rows
that arrive later than the horizon are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fairlead.functions.timeline import MICROS
from fairlead.operators.ordering import duplicate_key
from fairlead.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def land_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a landing folder as a stream."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def run_available(stream: DataFrame, label: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process everything that has landed and return the written result.

    ``folder`` keeps result and checkpoint: a query started again with the same one goes on
    where it stopped.  Without it both go to new places in the shared folder.
    """
    spark = stream.sparkSession
    out = f"{folder}/out" if folder else shared_dir(spark, f"{label}-out")
    checkpoint = f"{folder}/state" if folder else shared_dir(spark, f"{label}-state")
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
        query.awaitTermination()
    else:

        marks = f"{out}-complete"

        def replace(batch: DataFrame, epoch: int) -> None:
            # Each epoch has a folder of its own, so a reader never sees a result being replaced.
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
            batch.sparkSession.range(1).select(F.lit(epoch).alias("epoch")).write.mode("append").parquet(marks)

        query = writer.outputMode(mode).foreachBatch(replace).start()
        query.awaitTermination()
        out = f"{out}/epoch={spark.read.parquet(marks).agg(F.max('epoch')).first()[0]}"
    return spark.read.schema(stream.schema).parquet(out)


def dedupe_stream(obs: DataFrame, horizon: str | None = None) -> DataFrame:
    """First arrival per duplicate key.

    Every key is remembered, whenever its rows arrive.  With a ``horizon`` a key is forgotten
    once the watermark has passed it, and rows that arrive later are left out.
    """
    keyed = obs.withColumn("duplicate_key", duplicate_key())
    if horizon is None:
        return keyed.dropDuplicates(["duplicate_key"])
    return keyed.withWatermark("observed_at", horizon).dropDuplicatesWithinWatermark(["duplicate_key"])


def _within(rows: DataFrame, at: str, horizon: str | None) -> DataFrame:
    return rows.withWatermark(at, horizon) if horizon else rows


def session_stream(obs: DataFrame, max_gap_seconds: int, horizon: str | None = None) -> DataFrame:
    """Tracks: a session window splits on gaps strictly above the limit."""
    return (
        _within(obs, "observed_at", horizon)
        .groupBy("entity_id", F.session_window("observed_at", f"{max_gap_seconds} seconds").alias("_s"))
        .agg(
            F.min("observed_at").alias("start_at"),
            F.max("observed_at").alias("end_at"),
            F.count("*").alias("observed_points"),
        )
        .drop("_s")
    )


def rate_stream(rows: DataFrame, at: str, labels: list[str], window: str = "5 minutes", seconds: int = 300,
                horizon: str | None = None) -> DataFrame:
    """Events per second in tumbling windows, by labels."""
    return (
        _within(rows, at, horizon)
        .groupBy(F.window(at, window).alias("_w"), *labels)
        .agg(F.count("*").alias("events"))
        .select(F.col("_w.start").alias("window_start"), *labels, "events",
                (F.col("events") / F.lit(float(seconds))).alias("per_second"))
    )


def frame_counts(frames: DataFrame, horizon: str | None = None, window: str = "1 day") -> DataFrame:
    """Normalized frames counted by kind and arrival day."""
    return (
        _within(frames, "received_at", horizon)
        .groupBy(F.window("received_at", window).alias("_w"), "kind")
        .agg(F.count("*").alias("frames"))
        .select(F.col("_w.start").alias("day"), "kind", "frames")
    )


class _LastStatic(StatefulProcessor):
    """Keeps the latest static report of one vessel and stamps its position reports."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "entity_type string, classification string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._last.get() if self._last.exists() else ("unknown", "unknown")
        batch = pd.concat(list(rows)).sort_values(["received_us", "arrival_seq"])
        static = (batch["kind"] == "static").to_numpy()
        # Place of the last static report up to each row; before the first one the state holds.
        last = np.maximum.accumulate(np.where(static, np.arange(1, len(batch) + 1), 0))
        types = np.array([known[0], *batch["entity_type"]], object)[last]
        classes = np.array([known[1], *batch["classification"]], object)[last]
        self._last.update((types[-1], classes[-1]))
        yield pd.DataFrame({"mmsi": key[0], "arrival_seq": batch["arrival_seq"].to_numpy(), "entity_type": types, "classification": classes})[~static]

    def close(self) -> None:
        pass


def asof_stream(frames: DataFrame) -> DataFrame:
    """Stateful form of ``asof_classification``: one small record per vessel."""
    slim = frames.select(
        "mmsi", "arrival_seq", "kind", "entity_type", "classification",
        F.unix_micros("received_at").alias("received_us"),
    )
    return slim.groupBy("mmsi").transformWithStateInPandas(
        statefulProcessor=_LastStatic(),
        outputStructType="mmsi bigint, arrival_seq bigint, entity_type string, classification string",
        outputMode="append",
        timeMode="none",
    )


class _RunningHealth(StatefulProcessor):
    """Keeps the newest observation time of one source and derives the state of each refresh."""

    def __init__(self, fresh_within_us: int):
        self._limit = fresh_within_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._newest = handle.getValueState("newest", "at_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._newest.get()[0] if self._newest.exists() else None
        batch = pd.concat(list(rows)).sort_values(["now_us", "seq"])
        status = batch["status"].to_numpy()
        seen = np.where(status == "failure", np.nan, batch["seen_us"].to_numpy(float))  # microseconds are exact in doubles
        newest = np.fmax.accumulate(np.concatenate([[np.nan if known is None else known], seen]))[1:]
        fresh = batch["now_us"].to_numpy(float) - newest <= self._limit
        state = np.select(
            [status == "failure", status == "partial", np.isnan(newest), fresh], ["UNAVAILABLE", "DEGRADED", "UNAVAILABLE", "FRESH"], "STALE"
        )
        if not np.isnan(newest[-1]):
            self._newest.update((int(newest[-1]),))
        yield pd.DataFrame({
            "source_id": key[0], "seq": batch["seq"].to_numpy(), "status": status,
            "last_observation_us": pd.array([None if np.isnan(v) else int(v) for v in newest], "Int64"), "state": state,
        })

    def close(self) -> None:
        pass


def health_stream(refreshes: DataFrame, fresh_within_seconds: int) -> DataFrame:
    """Stateful form of ``source_health``."""
    slim = refreshes.select(
        "source_id", "seq", "status",
        F.unix_micros("now").alias("now_us"),
        F.unix_micros("last_observation_at").alias("seen_us"),
    )
    return slim.groupBy("source_id").transformWithStateInPandas(
        statefulProcessor=_RunningHealth(fresh_within_seconds * MICROS),
        outputStructType="source_id string, seq bigint, status string, last_observation_us bigint, state string",
        outputMode="append",
        timeMode="none",
    )


class _Buffer(StatefulProcessor):
    """Keeps the newest arrivals of one provider, never more than the bound, and shows them after every batch."""

    def __init__(self, most: int):
        self._most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._rows = handle.getValueState("rows", "received_us array<bigint>, ids array<string>, version bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, version = pd.DataFrame({"received_us": [], "observation_id": []}), 0
        if self._rows.exists():
            times, ids, version = self._rows.get()
            held = pd.DataFrame({"received_us": times, "observation_id": ids})
        for part in rows:  # part by part, so that a batch of any size is reduced as it comes
            both = pd.concat([held, part[["received_us", "observation_id"]]]) if len(held) else part[["received_us", "observation_id"]]
            held = both.sort_values(["received_us", "observation_id"], ascending=False).head(self._most)
        version += 1
        self._rows.update(([int(v) for v in held["received_us"]], list(held["observation_id"]), version))
        yield pd.DataFrame({
            "provider_id": key[0], "version": version, "received_us": held["received_us"].astype("int64").to_numpy(),
            "observation_id": held["observation_id"].to_numpy(),
        })

    def close(self) -> None:
        pass


def retention_stream(obs: DataFrame, max_records: int) -> DataFrame:
    """Bounded buffer per provider: its last ``max_records`` arrivals, whatever order the batches come in.

    Each batch appends the buffers it touched under a new version; ``retained`` reads the
    newest one of each provider.
    """
    slim = obs.select("provider_id", "observation_id", F.unix_micros("received_at").alias("received_us"))
    return slim.groupBy("provider_id").transformWithStateInPandas(
        statefulProcessor=_Buffer(max_records),
        outputStructType="provider_id string, version bigint, received_us bigint, observation_id string",
        outputMode="append",
        timeMode="none",
    )


def retained(buffers: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """The newest buffer of each provider without what is older than the time to live at ``now``."""
    newest = buffers.groupBy("provider_id").agg(F.max("version").alias("version"))
    at = F.timestamp_micros("received_us")
    return buffers.join(newest, ["provider_id", "version"]).withColumn("received_at", at).filter(
        F.unix_micros("received_at") >= F.unix_micros(now) - F.lit(ttl_seconds * MICROS)
    ).drop("version", "received_us")


def snapshot_each_batch(obs_stream: DataFrame, landing: str, compute, checkpoint: str):
    """Add each micro-batch to the observation table, then recompute what depends on it.

    ``compute(spark, landing)`` is a batch job such as the snapshot over the windows
    that are still open.  A batch has a folder of its own and replaces it when it is
    run again, so a restart with the same ``checkpoint`` adds nothing twice.
    """
    from fairlead.sources.tables import write_observations

    def step(batch: DataFrame, epoch: int) -> None:
        write_observations(batch, f"{landing.rstrip('/')}/batch={epoch}", mode="overwrite")
        compute(batch.sparkSession, landing)

    return (
        obs_stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(step).start()
    )


def snapshot_stream(obs_stream: DataFrame, wins: DataFrame, compute, folder: str):
    """Keep the results of windows up to date, batch by batch, recomputing only what a batch touches.

    A batch goes to a folder of its own in the observation table.  The windows that its rows
    fall into, themselves or their preceding windows, are found by a range join with the
    windows table; ``compute(observations, windows)`` is run for those alone, and since it
    prunes to the windows it is given, other date partitions are not read.  Results are
    written per epoch and merged by window when they are read (``snapshot_results``): the
    newest epoch of a window stands.  A batch that runs again replaces its own folders.
    """
    from fairlead.operators.windows import assign_windows, with_baseline
    from fairlead.sources.tables import read_observations, write_observations

    landing, out = f"{folder.rstrip('/')}/observations", f"{folder.rstrip('/')}/results"
    spans = with_baseline(wins)

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        write_observations(batch, f"{landing}/batch={epoch}", mode="overwrite")
        own = read_observations(spark, f"{landing}/batch={epoch}").select("observed_at")
        touched = assign_windows(own, spans, "window_start", "window_end").select("window_id").distinct()
        names = [r["window_id"] for r in touched.collect()]  # at most the windows asked for
        if names:
            result = compute(read_observations(spark, landing), wins.filter(F.col("window_id").isin(names)))
            result.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return (
        obs_stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder.rstrip('/')}/state")
        .foreachBatch(step).start()
    )


def snapshot_results(spark: SparkSession, folder: str) -> DataFrame:
    """The newest result of each window of a ``snapshot_stream``."""
    results = spark.read.parquet(f"{folder.rstrip('/')}/results")
    newest = results.groupBy("window_id").agg(F.max("epoch").alias("epoch"))
    return results.join(newest, ["window_id", "epoch"]).drop("epoch")
