"""Figures that are ready soon after the fact: minute rows as minutes close, queue waits as jobs start."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobtrail.functions.scalar import is_type, millis_between
from jobtrail.operators import rollups as ru
from jobtrail.operators.timerange import instant
from jobtrail.streaming.gate import dedupe_stream, read_late
from jobtrail.streaming.ingest import start

MINUTES = "minute timestamp, event_type string, cnt bigint, duration_sum bigint, duration_count bigint"
WAITS = "job_id string, attempt bigint, queued_at timestamp, started_at timestamp"


def start_live_minutes(
    on_time: DataFrame, path: str, checkpoint: str, delay: str, interval: str | None = "10 seconds"
) -> StreamingQuery:
    """Write each minute's rows once, as soon as the watermark has passed the minute.

    ``on_time`` is the stream behind a gate of the same delay.
    """
    once = dedupe_stream(ru.rollup_input(on_time, dedupe=False), delay)
    minutes = once.groupBy(F.window("event_time", "1 minute").alias("_window"), "event_type").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.coalesce(F.sum("ms"), F.lit(0)).alias("duration_sum"),
        F.count_if(F.col("ms") > 0).alias("duration_count"),
    )
    rows = minutes.select(F.col("_window.start").alias("minute"), "event_type", "cnt", "duration_sum", "duration_count")
    return start(rows.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, interval)


def read_live_minutes(spark: SparkSession, path: str, root: str) -> DataFrame:
    """The counters of closed minutes, with the events that the gate below ``root`` found late added."""
    late = ru.job_minute_stats(ru.rollup_input(read_late(spark, root)), sketches=False)
    closed = spark.read.schema(MINUTES).parquet(path)
    return ru.merge_counters(closed.unionByName(late), ["minute", "event_type"], ["cnt", "duration_sum", "duration_count"])


def start_queue_waits(
    queued: DataFrame,
    started: DataFrame,
    path: str,
    checkpoint: str,
    delay: str = "1 minute",
    longest: str = "1 day",
    interval: str | None = "10 seconds",
) -> StreamingQuery:
    """Pair QUEUED with STARTED of the same job and attempt while jobs run.

    ``queued`` and ``started`` are two streams of the log. A pair is written when both are in; what finds no partner
    within ``longest`` is written alone once the watermark has passed: jobs that never started, starts that were never
    queued. The time bound lets the state of both sides end.
    """
    q = queued.filter(is_type("JOB_QUEUED") & (F.col("job_id") != "")).select(
        "job_id", F.coalesce("attempt", F.lit(0)).alias("attempt"), F.col("event_time").alias("queued_at")
    )
    s = started.filter(is_type("JOB_STARTED") & (F.col("job_id") != "")).select(
        F.col("job_id").alias("_job"), F.coalesce("attempt", F.lit(0)).alias("_attempt"), F.col("event_time").alias("started_at")
    )
    met = (
        (F.col("job_id") == F.col("_job"))
        & (F.col("attempt") == F.col("_attempt"))
        & (F.col("started_at") >= F.col("queued_at"))
        & (F.col("started_at") <= F.col("queued_at") + F.expr(f"INTERVAL {longest}"))
    )
    joined = q.withWatermark("queued_at", delay).join(s.withWatermark("started_at", delay), met, "full_outer")
    rows = joined.select(
        F.coalesce("job_id", "_job").alias("job_id"), F.coalesce("attempt", "_attempt").alias("attempt"), "queued_at", "started_at"
    )
    return start(rows.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint, interval)


def read_queue_waits(spark: SparkSession, path: str, until: datetime) -> DataFrame:
    """(job_id, queued_at, started_at, wait_ms): the rows of ``analytics.queue_waits`` over all events before ``until``.

    ``until`` has to lie at least the longest wait behind the watermark; everything before it is written then.
    """
    before = lambda c: F.when(F.col(c) < instant(until), F.col(c))
    rows = spark.read.schema(WAITS).parquet(path)
    firsts = rows.groupBy("job_id").agg(F.min(before("queued_at")).alias("queued_at"), F.min(before("started_at")).alias("started_at"))
    return firsts.filter("started_at >= queued_at").withColumn("wait_ms", millis_between("queued_at", "started_at"))


def read_never_started(spark: SparkSession, path: str, until: datetime) -> DataFrame:
    """(job_id, attempt, queued_at) of jobs queued before ``until`` that did not start within the longest wait."""
    rows = spark.read.schema(WAITS).parquet(path).filter(F.col("queued_at") < instant(until)).filter("started_at IS NULL")
    return rows.select("job_id", "attempt", "queued_at").distinct()
