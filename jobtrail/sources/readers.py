"""Streams and bounded reads of event messages.

Kafka needs the public spark-sql-kafka connector on the class path; JSON-lines files work
anywhere. Both give ``value`` (text) and ``source_time`` (when the source recorded the message),
so the steps after them do not differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.operators.timerange import instant
from jobtrail.sources.messages import decode_events, replayable_events

# Topic names per kind of event.
JOB_TOPIC = "job.events"
WORKER_TOPIC = "worker.events"
SCHEDULER_TOPIC = "scheduler.events"
EVENT_TOPICS = [JOB_TOPIC, WORKER_TOPIC, SCHEDULER_TOPIC]


def _shape(df: DataFrame, time_col: str, *more: str) -> DataFrame:
    return df.select(F.col("value").cast("string").alias("value"), F.col(time_col).alias("source_time"), *more)


def stream_kafka(
    spark: SparkSession, servers: str, topics: Sequence[str] = EVENT_TOPICS, max_per_trigger: int | None = None
) -> DataFrame:
    """Continuous read of the event topics; a new query starts at the earliest offset."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
    )
    if max_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return _shape(reader.load(), "timestamp", "topic")


def stream_files(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Continuous read of a folder of JSON lines."""
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.load(folder)
    return df.select("value", F.col("_metadata.file_modification_time").alias("source_time"))


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Everything a topic holds now."""
    df = (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("endingOffsets", "latest")
        .load()
    )
    return _shape(df, "timestamp", "topic", "partition", "offset")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.text(folder)
    return df.select("value", F.col("_metadata.file_modification_time").alias("source_time"))


def replay(messages: DataFrame, max_events: int | None = None, until: datetime | None = None) -> DataFrame:
    """Bounded replay: decoded events recorded before ``until``, the earliest ``max_events`` of them (0: all).

    The order is that of the topic partition's offsets where the source has them, within equal source times.
    """
    if until is not None:
        messages = messages.filter(F.col("source_time") < instant(until))
    events = replayable_events(decode_events(messages))
    if not max_events:
        return events
    place = [c for c in ("source_time", "topic", "partition", "offset", "event_time", "event_id") if c in events.columns]
    return events.orderBy(*place).limit(max_events)
