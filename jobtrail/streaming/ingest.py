"""Message stream to event log."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from jobtrail.operators.timerange import UTC
from jobtrail.sinks.event_log import append_events, normalise
from jobtrail.sources.messages import decode_events, rejected_events, valid_events

# Fixed value: how often a stream looks for new messages.
INTERVAL = "500 milliseconds"

Clock = Callable[[], datetime]


def utc_now() -> datetime:
    return datetime.now(UTC)


def start(writer: DataStreamWriter, checkpoint: str, interval: str | None) -> StreamingQuery:
    """Start with a trigger interval, or (None) work off what is there and stop."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def adaptive(spark: SparkSession) -> SparkSession:
    """The session of a stream's batch has adaptive execution switched off; splitting large days needs it."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def ingest_batch(
    messages: DataFrame,
    log_path: str,
    rejects_path: str,
    now: datetime,
    also: Callable[[DataFrame], None] | None = None,
) -> None:
    """Append one batch of messages to the log, and what cannot be decoded to the quarantine.

    ``also`` gets the appended rows while they are at hand, so that nothing is decoded twice. A batch that is
    retried appends copies; they carry the same keys and are removed on read.
    """
    adaptive(messages.sparkSession)
    decoded = decode_events(messages).persist(StorageLevel.DISK_ONLY)
    try:
        rows = normalise(valid_events(decoded), now)
        append_events(rows, log_path)
        rejected_events(decoded).write.mode("append").parquet(rejects_path)
        if also is not None:
            also(rows)
    finally:
        decoded.unpersist()


def start_ingest(
    messages: DataFrame,
    log_path: str,
    rejects_path: str,
    checkpoint: str,
    interval: str | None = INTERVAL,
    clock: Clock = utc_now,
) -> StreamingQuery:
    """Ingest continuously. Offsets advance only after a batch is in the log."""

    def run(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, log_path, rejects_path, clock())

    return start(messages.writeStream.foreachBatch(run), checkpoint, interval)
