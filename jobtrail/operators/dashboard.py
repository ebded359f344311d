"""Dashboard panels.

Panels read the raw log: copies count unless ``dedupe`` is set. Their window is closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.functions.percentiles import approx_percentiles, exact_percentiles
from jobtrail.functions.scalar import count_of, duration_ms, is_type, minute
from jobtrail.operators.dedupe import final_events, final_keys
from jobtrail.operators.timerange import TimeRange, within_closed

TOP_WORKERS = 20


def _source(events: DataFrame, tr: TimeRange | None, dedupe: bool, columns: list[str] | None) -> DataFrame:
    rows = events if tr is None else within_closed(events, tr)
    if not dedupe:
        return rows
    return final_keys(rows) if columns is None else final_events(rows, columns)


def completed_per_minute(events: DataFrame, tr: TimeRange | None = None, dedupe: bool = False) -> DataFrame:
    return (
        _source(events, tr, dedupe, None)
        .groupBy(minute().alias("time"))
        .agg(count_of(is_type("JOB_COMPLETED")).alias("completed"))
        .orderBy("time")
    )


def failures_per_minute(events: DataFrame, tr: TimeRange | None = None, dedupe: bool = False) -> DataFrame:
    return (
        _source(events, tr, dedupe, None)
        .groupBy(minute().alias("time"))
        .agg(
            count_of(is_type("JOB_FAILED")).alias("failed"),
            count_of(is_type("JOB_TIMEOUT")).alias("timeout"),
            count_of(is_type("JOB_RETRY_SCHEDULED")).alias("retry"),
        )
        .orderBy("time")
    )


def p95_per_minute(
    events: DataFrame, tr: TimeRange | None = None, dedupe: bool = False, approx: bool = False
) -> DataFrame:
    done = events.filter(is_type("JOB_COMPLETED")).withColumn("_ms", duration_ms())
    rows = _source(done, tr, dedupe, ["_ms"]).filter("_ms > 0").withColumn("time", minute())
    percentiles = approx_percentiles if approx else exact_percentiles
    return percentiles(rows, ["time"], "_ms", {"p95": 0.95}).orderBy("time")


def events_by_type(events: DataFrame, tr: TimeRange | None = None, dedupe: bool = False) -> DataFrame:
    return (
        _source(events, tr, dedupe, None)
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "event_type")
    )


def completed_by_worker(
    events: DataFrame, tr: TimeRange | None = None, dedupe: bool = False, top: int = TOP_WORKERS
) -> DataFrame:
    return (
        _source(events, tr, dedupe, ["worker_id"])
        .filter("worker_id != ''")
        .groupBy("worker_id")
        .agg(count_of(is_type("JOB_COMPLETED")).alias("completed"))
        .orderBy(F.desc("completed"), "worker_id")
        .limit(top)
    )
