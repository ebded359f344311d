"""Rollup tables kept up to date.

The exact path recomputes the days a batch touches from the deduplicated log, so duplicates, late
events and replays cannot spoil a figure. Events of days the log no longer keeps as a whole change
nothing; they are listed in a table of their own. The delta path stands behind a gate, writes what
each batch adds and merges on read; its cost depends on the batch only.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobtrail.functions.scalar import day
from jobtrail.operators import rollups as ru
from jobtrail.operators.retention import RETENTION_DAYS
from jobtrail.operators.timerange import UTC
from jobtrail.schema import EVENT_KEY
from jobtrail.sinks.event_log import read_events
from jobtrail.streaming.gate import dedupe_stream, read_late
from jobtrail.streaming.ingest import Clock, adaptive, ingest_batch, start, utc_now
from jobtrail.streaming.parts import fold, read_parts
from jobtrail.streaming.storage import exists


def kept_days(now: datetime, keep: int = RETENTION_DAYS["events"]) -> tuple[date, date]:
    """First and last day that may be rebuilt: the log holds them as a whole, and none is after tomorrow."""
    today = now.astimezone(UTC)
    return (today - timedelta(days=keep)).date() + timedelta(days=1), (today + timedelta(days=1)).date()


def _write(df: DataFrame, path: str, at: str) -> None:
    """Replace the days that occur in ``df``, and no others."""
    (
        df.withColumn("event_day", day(at))
        .hint("rebalance", "event_day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_day")
        .parquet(path)
    )


def refresh(spark: SparkSession, log_path: str, root: str, days: list[date] | None = None) -> None:
    """Recompute the rollups of some days, or of the whole log.

    A day is rebuilt from the log as a whole, so a refresh that breaks off leaves nothing that a
    second one does not put right. Days the log has dropped must not be named (``kept_days``). The
    log is read, deduplicated and shuffled once; everything coarser comes from the minute table.
    """
    adaptive(spark)
    of_days = (lambda df: df) if days is None else (lambda df: df.filter(F.col("event_day").isin(days)))
    if days is not None and not days:
        return
    rows = ru.rollup_input(of_days(read_events(spark, log_path))).persist(StorageLevel.DISK_ONLY)
    try:
        _write(ru.job_minute_stats(rows), f"{root}/job_minute_stats", "minute")
        _write(ru.worker_minute_stats(rows), f"{root}/worker_minute_stats", "minute")
    finally:
        rows.unpersist()
    minutes = of_days(spark.read.parquet(f"{root}/job_minute_stats"))
    plain = minutes.select("minute", "event_type", "cnt", "duration_sum", "duration_count")
    _write(ru.failure_minute_stats(plain), f"{root}/failure_minute_stats", "minute")
    _write(ru.job_hourly_stats(plain), f"{root}/job_hourly_stats", "hour")
    _write(ru.job_daily_stats(plain), f"{root}/job_daily_stats", "day")


def backfill(spark: SparkSession, log_path: str, root: str) -> None:
    """All rollups of the days in the log."""
    refresh(spark, log_path, root)


def read_rollup(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def start_exact(
    spark: SparkSession,
    messages: DataFrame,
    log_path: str,
    rejects_path: str,
    root: str,
    checkpoint: str,
    interval: str | None = "1 minute",
    clock: Clock = utc_now,
    keep: int = RETENTION_DAYS["events"],
) -> StreamingQuery:
    """Ingest and keep the rollups exact. The cost of a batch is that of the days it touches, so a
    longer interval saves work.

    Events of days the log has dropped are in the log, but the rollups of their days stay as they are; the
    events are listed in ``late_events`` below ``root``, once per batch. Events of days after tomorrow (a clock
    that is wrong, say) wait in the log; their days are noted and rebuilt when they come.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        now, days = clock(), set()
        spark = adaptive(batch.sparkSession)
        first, last = kept_days(now, keep)

        def take(rows: DataFrame) -> None:
            rows.filter(day() < F.lit(first)).write.mode("overwrite").parquet(f"{root}/late_events/batch_id={batch_id}")
            # At most the days that the log keeps, and days ahead that some event names.
            named = [r.d for r in rows.filter(day() >= F.lit(first)).select(day().alias("d")).distinct().collect()]
            days.update(d for d in named if d <= last)
            if ahead := [(d,) for d in named if d > last]:
                spark.createDataFrame(ahead, "day date").coalesce(1).write.mode("overwrite").parquet(f"{root}/days_ahead/batch_id={batch_id}")

        ingest_batch(batch, log_path, rejects_path, now, take)
        come = {d for d in days_ahead(spark, root) if d <= last}
        refresh(spark, log_path, root, sorted(days | {d for d in come if d >= first}))
        if come:
            # Only now: a batch that breaks off before finds its days waiting again.
            done = spark.createDataFrame([(d,) for d in sorted(come)], "day date").coalesce(1)
            done.write.mode("overwrite").parquet(f"{root}/days_come/batch_id={batch_id}")

    return start(messages.writeStream.foreachBatch(run), checkpoint, interval)


def days_ahead(spark: SparkSession, root: str) -> list[date]:
    """Days after tomorrow that events are waiting for. A day that came is rebuilt once; from then on its events touch it."""
    listed = {}
    for name in ("days_ahead", "days_come"):
        listed[name] = spark.read.schema("day date").parquet(f"{root}/{name}").distinct().collect() if exists(spark, f"{root}/{name}") else []
    come = {r.day for r in listed["days_come"]}
    return sorted(r.day for r in listed["days_ahead"] if r.day not in come)


def late_events(spark: SparkSession, root: str) -> DataFrame:
    """Events that came too late for the rollups, each once."""
    rows = spark.read.option("basePath", f"{root}/late_events").parquet(f"{root}/late_events").drop("batch_id")
    return ru.final_events(rows, [c for c in rows.columns if c not in EVENT_KEY])


# --- deltas -----------------------------------------------------------------------------------


def start_deltas(
    on_time: DataFrame, parts_path: str, checkpoint: str, delay: str = "1 hour", interval: str | None = "10 seconds"
) -> StreamingQuery:
    """Write the minute rows each batch adds. A retried batch replaces its own part.

    ``on_time`` is the stream behind a gate of the same delay (``gate.stream_on_time``): each event counts once, and
    what came behind the watermark is listed by the gate.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        adaptive(batch.sparkSession)
        rows = ru.rollup_input(batch, dedupe=False)
        ru.job_minute_stats(rows).write.mode("overwrite").parquet(f"{parts_path}/batch_id={batch_id}")

    return start(dedupe_stream(on_time, delay).writeStream.foreachBatch(run), checkpoint, interval)


def read_deltas(spark: SparkSession, parts_path: str, gate_root: str | None = None) -> DataFrame:
    """The minute table, merged from all parts and, with ``gate_root``, from the events the gate found late."""
    parts = read_parts(spark, parts_path)
    if gate_root is not None:
        late = ru.job_minute_stats(ru.rollup_input(read_late(spark, gate_root), dedupe=False))
        parts = parts.unionByName(late)
    return ru.merge_minute_parts(parts)


def fold_deltas(spark: SparkSession, parts_path: str) -> int:
    """Merge the parts written so far; may run while the stream writes and others read."""
    return fold(spark, parts_path, ru.merge_minute_parts)
