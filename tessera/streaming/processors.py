"""Structured Streaming versions of the sequential operators on an event stream.

Event time is watermarked. Stateful operators keep one small state a key; timers are event-time, so a pending write leaves
when the watermark passes its due time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str, *, files: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder.

    files bounds a batch; files must then come in time order within the watermark, as rows behind it are late. Without a
    bound, what is there makes one batch, whatever the order and overlap of its files: nothing in it is late.
    """
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def tumbling(stream: DataFrame, *, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums of tumbling windows."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(stream: DataFrame, *, time: str, width: str, step: str, late: str, keys: list[str]) -> DataFrame:
    """Counts of sliding windows."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width, step), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, *, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Sessions that end after a gap."""
    w = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def first_seen(stream: DataFrame, *, time: str, late: str, keys: list[str]) -> DataFrame:
    """Each key once, within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_dedup(stream: DataFrame) -> DataFrame:
    """stream of (key string, id long, t long, value string), in time order from batch to batch, without a key's repeats.

    State: the last value of each key.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(["t", "id"], kind="stable")
        before = state.get[0] if state.exists else None
        changed = frame["value"].ne(frame["value"].shift(1))
        changed.iloc[0] = before is None or frame["value"].iloc[0] != before
        state.update((frame["value"].iloc[-1],))
        out = frame[changed.to_numpy()]
        yield pd.DataFrame({"key": [key[0]] * len(out), "id": out["id"].to_numpy(), "t": out["t"].to_numpy(), "value": out["value"].to_numpy()})

    return stream.groupBy("key").applyInPandasWithState(step, "key string, id long, t long, value string", "value string", "append", "NoTimeout")


def _limit(frame: pd.DataFrame, state: tuple, timeout_ms: int | None, gap: int) -> tuple[list[tuple], tuple]:
    """One pass of the defer-latest limiter over ordered rows; state is (due, pending value) with None for none."""
    due, wait = state
    out = []
    for t, v in zip(frame["t"], frame["value"]):
        if wait is not None and t >= due:
            out.append((due, wait))
            due, wait = due + gap, None
        if due is None or t >= due:
            out.append((t, v))
            due, wait = t + gap, None
        else:
            wait = v
    if timeout_ms is not None and wait is not None:
        out.append((due, wait))
        due, wait = due + gap, None
    return out, (due, wait)


def limiter(stream: DataFrame, *, gap: int, late: str) -> DataFrame:
    """At most one write of a key in `gap` microseconds; the latest waiting write leaves when event time passes its due time.

    stream: (key string, ts timestamp, t long microseconds, value double).
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else (None, None)
        kept = tuple(None if x is None or pd.isna(x) else x for x in kept)
        if state.hasTimedOut:
            out, kept = _limit(pd.DataFrame({"t": [], "value": []}), kept, 0, gap)
        else:
            frame = pd.concat(list(frames)).sort_values("t", kind="stable")
            out, kept = _limit(frame, kept, None, gap)
        state.update(kept)
        if kept[1] is not None:
            state.setTimeoutTimestamp(max(int(kept[0] // 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]] * len(out), "at": [int(a) for a, _ in out], "value": [float(v) for _, v in out]}).astype({"at": "int64", "value": "float64"})

    return stream.withWatermark("ts", late).groupBy("key").applyInPandasWithState(step, "key string, at long, value double", "due long, wait double", "append", "EventTimeTimeout")


def drain(result: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet under the checkpoint folder and read the rows.

    A further call with the same name goes on where the last one stopped.
    """
    spark = result.sparkSession
    out = f"{checkpoint}/{name}-out"
    query = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/{name}-state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def drain_complete(result: DataFrame, checkpoint: str) -> DataFrame:
    """Run an aggregate in complete mode over what is there now; each batch writes its whole result as Parquet, the last is read."""
    spark = result.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{checkpoint}/batch-{batch}")
        latest[0] = batch

    latest = [None]
    query = result.writeStream.foreachBatch(keep).option("checkpointLocation", f"{checkpoint}/state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.createDataFrame([], result.schema) if latest[0] is None else spark.read.schema(result.schema).parquet(f"{checkpoint}/batch-{latest[0]}")
