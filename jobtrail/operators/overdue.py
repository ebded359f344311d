"""What did not happen in time: runs past their limit and workers that fell silent, from the log.

Both are the same question. A mark of a key either opens a wait (a run starts, a worker shows life) or only ends one
(a result, a sign-off). A wait is overdue at each of its limits that passes before the next mark of the key.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.functions.scalar import is_type
from jobtrail.operators.jobs import HEARTBEAT_TIMEOUT, SUSPECT_GRACE
from jobtrail.operators.lifecycle import DEFAULT_TIMEOUT_SECONDS, EVENT_STATE, event_rank
from jobtrail.operators.timerange import instant

# Place of a mark: milliseconds * 16 + rank. Marks with one place are copies.
MARKS = "key string, at bigint, label string, due bigint"
ALIVE = ("WORKER_REGISTERED", "WORKER_HEARTBEAT", "WORKER_RECOVERED", "WORKER_CAPACITY_CHANGED")
GONE = ("WORKER_DEREGISTERED", "WORKER_UNAVAILABLE")


def _limit_ms(limit: timedelta):
    return F.lit(round(limit.total_seconds() * 1000)).cast("long")


def run_marks(events: DataFrame, limit: timedelta = timedelta(seconds=DEFAULT_TIMEOUT_SECONDS), jobs: DataFrame | None = None) -> DataFrame:
    """Marks of jobs: a start opens a run, any other state but ASSIGNED ends it. One row per mark.

    ``jobs`` (job_id, timeout_ms) gives jobs a limit of their own; where it is unknown or not positive ``limit`` holds.
    """
    neutral = ["JOB_ASSIGNED"]
    rows = events.filter(F.col("event_type").isin([kind for kind, _ in EVENT_STATE if kind not in neutral]) & (F.col("job_id") != ""))
    own = _limit_ms(limit)
    if jobs is not None:
        limits = jobs.filter("timeout_ms > 0").groupBy("job_id").agg(F.max("timeout_ms").alias("_limit"))
        rows = rows.join(limits, "job_id", "left")
        own = F.coalesce("_limit", own)
    at, opens = F.unix_millis("event_time"), is_type("JOB_STARTED")
    return rows.select(
        F.col("job_id").alias("key"),
        (at * 16 + event_rank()).alias("at"),
        F.when(opens, "TIMEOUT").alias("label"),
        F.when(opens, at + own).alias("due"),
    )


def life_marks(
    events: DataFrame,
    heartbeat: timedelta = HEARTBEAT_TIMEOUT,
    grace: timedelta = SUSPECT_GRACE,
    alive: tuple[str, ...] = ALIVE,
) -> DataFrame:
    """Marks of workers: signs of life open a wait with two limits, a sign-off only ends one. A row for each limit."""
    at, opens = F.unix_millis("event_time"), is_type(*alive)
    rows = events.filter(is_type(*alive, *GONE) & (F.col("worker_id") != ""))
    limits = F.array(
        F.struct(F.lit("SUSPECTED").alias("label"), (at + _limit_ms(heartbeat)).alias("due")),
        F.struct(F.lit("UNAVAILABLE").alias("label"), (at + _limit_ms(heartbeat + grace)).alias("due")),
    )
    none = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("long").alias("due")))
    return rows.select(
        F.col("worker_id").alias("key"), (at * 16 + F.when(opens, 0).otherwise(1)).alias("at"), F.inline(F.when(opens, limits).otherwise(none))
    )


def shown(found: DataFrame) -> DataFrame:
    """Times of the rows (key, at, label, due) as timestamps."""
    return found.select("key", F.timestamp_millis(F.shiftright("at", 4)).alias("since"), F.timestamp_millis("due").alias("due"), "label")


def overdue(marks: DataFrame, now: datetime) -> DataFrame:
    """(key, since, due, label) of all waits whose limit passed before ``now`` without a mark of the key after ``since``.

    A mark at the very limit is in time. Copies of a mark count once.
    """
    once = marks.groupBy("key", "at").agg(F.collect_set(F.when(F.col("label").isNotNull(), F.struct("label", "due"))).alias("_limits"))
    after = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
    waits = once.withColumn("_next", after).select("key", "at", "_next", F.inline("_limits"))
    late = (F.col("due") < F.unix_millis(instant(now))) & (F.col("_next").isNull() | (F.shiftright("_next", 4) > F.col("due")))
    return shown(waits.filter(late))
