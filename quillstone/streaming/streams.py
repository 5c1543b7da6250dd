"""Structured Streaming: windowed probe aggregates, keyed upserts, and entries that expire.

An extension: the engine's model has no event time of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quillstone.operators.ranking import latest

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, calls, total, largest per event-time window; later rows than the watermark are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("total"), F.max("value").alias("largest"))
    return out.select(F.col("w.start").alias("start"), "event_type", "calls", "total", "largest")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("events"))
    return out.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "user_id", "events")


def first_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Every event once, as far as the watermark remembers."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert_into(path: str):
    """A foreachBatch writer that keeps the newest version of every key in a Parquet table.

    Each batch writes the merged table under a name of its own number, so a batch that is run
    again after a failure starts from its predecessor and gives the same table."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number - 1}")
        merged = batch
        if fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            merged = spark.read.parquet(f"{path}/batch={number - 1}").unionByName(batch)
        latest(merged, ["key"], F.col("version")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def expiring(changes: DataFrame, late: str = "1 minute") -> DataFrame:
    """key, value, live for a stream of changes (key, value, ttl_ms, ts): a row when a value is set, and one
    with live false when its time is over and nothing renewed it."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (value,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "value": [value], "live": [False]})
            return
        rows = pd.concat(list(frames)).sort_values("ts")
        last = rows.iloc[-1]
        state.update((last["value"],))
        if last["ttl_ms"] > 0:
            due = int(last["ts"].timestamp() * 1000) + int(last["ttl_ms"])
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "value": [last["value"]], "live": [True]})

    timed = changes.withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(update, "key string, value string, live boolean", "value string", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns its result table as of the last batch.

    Every batch overwrites a folder of its own number, so a batch that runs twice counts once."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result/batch={number}")

    running = stream.writeStream.outputMode(mode).foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").start()
    running.awaitTermination()
    last = (running.lastProgress or {}).get("batchId", 0)
    return stream.sparkSession.read.parquet(f"{path}/result/batch={last}")
