"""Structured Streaming forms of the event queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """``events`` files in ``path`` as a stream, with ``ts`` as an event time.

    The stored time has no zone and a watermark needs one; the session must run in UTC.
    """
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str) -> DataFrame:
    """Count and value per window and type; rows later than ``late`` are dropped."""
    return _summed(events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type"), "event_type")


def sliding(events: DataFrame, size: str, slide: str, late: str) -> DataFrame:
    """The same over overlapping windows."""
    return _summed(events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type"), "event_type")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Count and value per user session, closed by ``gap`` without events."""
    return _summed(events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id"), "user_id")


def first_seen(events: DataFrame, late: str) -> DataFrame:
    """Events with repeats of the same ``event_id`` dropped within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _summed(groups, key: str) -> DataFrame:
    out = groups.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), key, "n", "total"
    )


def totals_by_user(events: DataFrame) -> DataFrame:
    """For each batch, the number and value of all events so far of each user that had some: state that Spark keeps between batches."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)]})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there into Parquet files, and reads them. What was read before isn't read again."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
