"""Structured Streaming over an event log: windows, late data, deduplication, keyed state."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.storage import shared_folder

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """The folder's event files as a stream, with a zoned event time that can carry a watermark."""
    stream = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files_at_once)
    return stream.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def work_folder(spark: SparkSession) -> str:
    """A new folder for a query's checkpoint and output, in the shared folder that the session names."""
    return os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")


def drained(stream: DataFrame, mode: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame] | None = None, folder: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its table.

    Each batch writes a folder of its own by batch number, so that a batch that is run
    again replaces its output, and a batch that merges reads what the batch before it left.
    A folder given again resumes where its last run ended; without one, a new one is taken.
    Batches are found by their folders, so a restarted driver needs no memory of them.
    """
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    out = f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        if merge is not None:
            batch = merge(spark.read.parquet(f"{out}/batch={number - 1}") if number else None, batch)
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    try:
        found = spark.read.parquet(out)
    except AnalysisException:  # no batch has run
        return spark.createDataFrame([], stream.schema)
    if mode == "append" and merge is None:
        return found.drop("batch")
    last = found.agg(F.max("batch")).first()[0]
    return spark.createDataFrame([], stream.schema) if last is None else spark.read.parquet(f"{out}/batch={last}")


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "7 days") -> DataFrame:
    """Counts by event type and tumbling or sliding window."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "7 days") -> DataFrame:
    """Counts by user and session; a session ends after a gap without events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Keys once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys).select(*keys)


def _settle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Running sums of a user's cents and events; the state is two numbers whatever the log's length."""
    cents, n = state.get if state.exists else (0, 0)
    for rows in batches:
        cents += int((rows["value"] * 100).round().sum())
        n += len(rows)
    state.update((cents, n))
    yield pd.DataFrame({"user_id": [key[0]], "cents": [cents], "n": [n]})


def balances(events: DataFrame) -> DataFrame:
    """A user's running balance, emitted whenever it changes."""
    return events.groupBy("user_id").applyInPandasWithState(_settle, "user_id long, cents long, n long", "cents long, n long", "update", GroupStateTimeout.NoTimeout)
