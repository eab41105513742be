"""Structured Streaming on an operations log (ts, user_id, mode, ms, success, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, sf_dir: str, schema, files: int | None = 4) -> DataFrame:
    """The events table as a stream of files, so many a batch (None: all that are there), with its time as an event time."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files:
        stream = stream.option("maxFilesPerTrigger", files)
    return stream.parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(log: DataFrame, by: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, mean and largest latency of each window and group; rows later than the watermark are left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = log.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"), F.count_if(~F.col("success")).alias("failed"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), by, "n", "mean_ms", "max_ms", "failed")


def sessions(log: DataFrame, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Operations of a group with less than a gap between them as one session."""
    out = log.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), by, "n")


def without_repeats(log: DataFrame, keys: list[str], ttl: str = "1 hour") -> DataFrame:
    """The first row of each key within a time to live; the state is dropped after it."""
    return log.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def _pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    started = state.get[0] if state.exists else None
    if state.hasTimedOut:
        state.remove()
        return
    out = []
    rows = pd.concat(list(frames), ignore_index=True)  # a key's rows of a batch come in several frames, in no order
    rows = rows.iloc[np.lexsort((rows["kind"].to_numpy() != "start", rows["ts"].to_numpy()))]  # at one time, starts first
    for ts, kind in zip(rows["ts"], rows["kind"], strict=True):
        at = ts.value // 1_000_000
        if kind == "start":
            started = at
        elif started is not None and at >= started:
            out.append((key[0], pd.Timestamp(started, unit="ms"), ts, float(at - started)))
            started = None
    if started is None:
        if state.exists:
            state.remove()
    else:
        state.update((started,))
        state.setTimeoutTimestamp(max(started, state.getCurrentWatermarkMs()) + 24 * 3600 * 1000)
    yield pd.DataFrame(out, columns=["id", "started", "completed", "ms"])


def pairs(operations: DataFrame, late: str = "1 hour") -> DataFrame:
    """Latency of each operation (id, ts, kind: start or complete): a start stays open until its completion, a day at most."""
    return operations.withWatermark("ts", late).groupBy("id").applyInPandasWithState(_pair, "id long, started timestamp, completed timestamp, ms double", "started long", "append", GroupStateTimeout.EventTimeTimeout)


def _batch(size: int, wait_ms: int):
    def flush(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, since = (state.get[0], state.get[1]) if state.exists else (0, None)
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], held, "timeout")], columns=["tier", "size", "reason"])
            return
        for rows in frames:
            for at in sorted(t.value // 1_000_000 for t in rows["ts"]):
                if held and at - since > wait_ms:
                    out.append((key[0], held, "timeout"))
                    held = 0
                since = at if not held else since
                held += 1
                if held >= size:
                    out.append((key[0], held, "full"))
                    held = 0
        if held:
            state.update((held, since))
            state.setTimeoutTimestamp(max(since, state.getCurrentWatermarkMs()) + wait_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["tier", "size", "reason"])

    return flush


def batches(requests: DataFrame, size: int, wait_ms: int, late: str = "1 second") -> DataFrame:
    """Sizes of batches by tier (tier, ts): flushed when full or when the first request has waited so long."""
    return requests.withWatermark("ts", late).groupBy("tier").applyInPandasWithState(_batch(size, wait_ms), "tier string, size int, reason string", "held int, since long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, as a table in memory: for reports of bounded size and for tests."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """All that is there now, as Parquet files: the driver gathers no rows. In mode complete the last batch holds all.

    Files and the state lie below a path that driver and executors share.
    """
    written = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/{batch}")
        if batch not in written:
            written.append(batch)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    spark, kept = stream.sparkSession, written[-1:] if mode == "complete" else written
    return spark.read.schema(stream.schema).parquet(*[f"{path}/{batch}" for batch in kept]) if kept else spark.createDataFrame([], stream.schema)


def to_files(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream to Parquet files, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
