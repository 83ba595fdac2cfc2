"""Structured Streaming: event-time windows with watermarks, and stateful smoothing.

Every job runs over what is there and stops (availableNow), with its own checkpoint, into
Parquet; started again with the same checkpoint it goes on where it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.market import smooth

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-marketloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events with ``ts`` as an instant of the session's time zone, which watermarks need.

    A pattern that matches only ``path`` lets the source take a folder as well as a single file.
    """
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, folder: str | None = None, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is available and returns what it wrote."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def tumbling(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    w = F.window("ts", size)
    rows = events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", size, step), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def smoothed_stream(days: DataFrame, alpha: float = 0.5, bypass: float = -0.25) -> DataFrame:
    """Recursive smoothing of (series, date, raw) rows, each series' last value kept as state.

    Days of a series come in order from batch to batch, in any order within one; a job that goes on from its
    checkpoint goes on from these values.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("date")
        last = state.get[0] if state.exists else None
        out = []
        for date, raw in zip(rows["date"], rows["raw"], strict=True):
            last = smooth(last, raw, alpha, bypass)
            out.append((key[0], date, raw, last))
        state.update((last,))
        yield pd.DataFrame(out, columns=["series", "date", "raw", "smoothed"])

    return days.groupBy("series").applyInPandasWithState(step, "series string, date date, raw double, smoothed double", "last double", "append", GroupStateTimeout.NoTimeout)
