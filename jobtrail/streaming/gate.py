"""The gate in front of streams that close their books: events behind the watermark are kept apart.

A windowed aggregate in append mode and a duplicate filter drop what is behind the watermark without a word. The gate
follows the same watermark (newest event time of all batches before, less the delay) and hands on what is ahead of it;
the rest is listed and merged on read. A batch becomes visible as a whole, by one rename of its folder, so a stream behind
the gate never has a later watermark than the gate had for the same rows, and drops nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobtrail.operators.dedupe import final_events
from jobtrail.schema import EVENT, EVENT_COLUMNS, EVENT_KEY
from jobtrail.streaming.ingest import adaptive, start
from jobtrail.streaming.storage import exists, move


def _copies_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each key per Arrow batch: an event delivered over and over is no hot task further on."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).append_column("_row", pa.array(range(batch.num_rows), pa.int64()))
        first = table.group_by(EVENT_KEY, use_threads=False).aggregate([("_row", "min")]).column("_row_min")
        yield batch.take(first.combine_chunks().sort())


def start_gate(
    events: DataFrame, root: str, checkpoint: str, delay: timedelta, interval: str | None = "10 seconds"
) -> StreamingQuery:
    """Deal events of a stream to ``root``/on_time and ``root``/late. A retried batch gives the same rows.

    The newest time before each batch is kept below ``root``/seen, a row for each batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = adaptive(batch.sparkSession)
        done = f"{root}/on_time/batch-{batch_id}"
        if exists(spark, done):
            return
        newest = None
        if exists(spark, f"{root}/seen"):
            before = spark.read.schema("newest timestamp, batch_id bigint").parquet(f"{root}/seen").filter(F.col("batch_id") < batch_id)
            newest = before.agg(F.unix_micros(F.max("newest"))).first()[0]
        rows = batch.select(*EVENT_COLUMNS).mapInArrow(_copies_once, EVENT).persist(StorageLevel.DISK_ONLY)
        try:
            micros = F.unix_micros("event_time")
            behind = F.lit(False) if newest is None else micros <= newest - round(delay.total_seconds() * 1_000_000)
            rows.filter(behind).write.mode("overwrite").parquet(f"{root}/late/batch_id={batch_id}")
            latest = rows.agg(F.greatest(F.max("event_time"), F.timestamp_micros(F.lit(newest).cast("long"))).alias("newest"))
            latest.write.mode("overwrite").parquet(f"{root}/seen/batch_id={batch_id}")
            rows.filter(~behind).write.mode("overwrite").parquet(f"{root}/arriving")
            move(spark, f"{root}/arriving", done)
        finally:
            rows.unpersist()

    return start(events.writeStream.foreachBatch(run), checkpoint, interval)


def dedupe_stream(events: DataFrame, delay: str) -> DataFrame:
    """Each event once: copies of any age within ``delay`` of the newest event are found.

    Keys are shuffled once and kept in one store until the watermark passes their event time. Events behind the watermark
    are dropped, so ``events`` has to come from a gate of this delay, which lists them.
    """
    return events.withWatermark("event_time", delay).dropDuplicates(EVENT_KEY)


def stream_on_time(spark: SparkSession, root: str) -> DataFrame:
    """What the gate let through, as a stream. A batch of the gate is never split over two batches."""
    return spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(f"{root}/on_time")


def read_on_time(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(EVENT).option("recursiveFileLookup", "true").parquet(f"{root}/on_time")


def read_late(spark: SparkSession, root: str) -> DataFrame:
    """Events that came behind the watermark, each once. Copies of events that were on time are not among them."""
    late = final_events(spark.read.schema(EVENT).parquet(f"{root}/late"))
    known = read_on_time(spark, root).select(*EVENT_KEY)
    return late.join(known, EVENT_KEY, "left_anti").select(*EVENT_COLUMNS)


def closed_until(spark: SparkSession, root: str, delay: timedelta) -> DataFrame:
    """One row (closed_until): what lies before it is closed; null before the first event."""
    seen = spark.read.schema("newest timestamp, batch_id bigint").parquet(f"{root}/seen")
    return seen.agg((F.max("newest") - F.expr(f"INTERVAL {round(delay.total_seconds() * 1000)} MILLISECOND")).alias("closed_until"))
