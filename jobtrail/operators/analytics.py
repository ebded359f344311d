"""Analytics over the deduplicated event log.

Every function takes the raw log (copies included) and a window, and gives a lazy DataFrame.
Questions that only need the event type and time work on distinct keys; the others dedupe the
few columns they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.functions.percentiles import approx_percentiles, exact_percentiles
from jobtrail.functions.scalar import (
    count_of,
    duration_ms,
    finite,
    hour,
    is_type,
    millis_between,
    minute,
    ratio,
)
from jobtrail.operators.dedupe import final_events, final_keys
from jobtrail.operators.timerange import TimeRange, instant, within
from jobtrail.schema import OUTCOME_TYPES

# Planning rate and the number of workers a report shows.
JOBS_PER_WORKER_PER_MINUTE = 30.0
TOP_WORKERS = 100

LATENCY_SUMMARY = {"p50_ms": 0.5, "p90_ms": 0.9, "p95_ms": 0.95, "p99_ms": 0.99}
LATENCY_SERIES = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}


def _keys(events: DataFrame, tr: TimeRange) -> DataFrame:
    return final_keys(within(events, tr))


# --- throughput -------------------------------------------------------------------------------


def throughput_points(events: DataFrame, tr: TimeRange, grain: str = "minute") -> DataFrame:
    """Completed, failed and created per bucket; a bucket is there if it holds any event."""
    by_hour = grain == "hour"
    bucket, seconds = (hour(), 3600.0) if by_hour else (minute(), 60.0)
    return (
        _keys(events, tr)
        .groupBy(bucket.alias("bucket"))
        .agg(
            count_of(is_type("JOB_COMPLETED")).alias("completed"),
            count_of(is_type("JOB_FAILED")).alias("failed"),
            count_of(is_type("JOB_CREATED")).alias("created"),
        )
        .withColumn("rate_per_sec", F.col("completed").cast("double") / F.lit(seconds))
        .orderBy("bucket")
    )


def throughput_totals(events: DataFrame, tr: TimeRange) -> DataFrame:
    """Counts over the whole window and completed per second."""
    # The sums of the points do not depend on the grain, so they are counted directly.
    return _totals(
        _keys(events, tr).agg(
            count_of(is_type("JOB_COMPLETED")).alias("completed"),
            count_of(is_type("JOB_FAILED")).alias("failed"),
            count_of(is_type("JOB_CREATED")).alias("created"),
        ),
        tr,
    )


def _totals(counts: DataFrame, tr: TimeRange) -> DataFrame:
    return counts.withColumn("avg_rate", ratio(F.col("completed"), F.lit(tr.seconds)))


# --- latency ----------------------------------------------------------------------------------


def _durations(events: DataFrame, tr: TimeRange, keep_zero: bool = False) -> DataFrame:
    """(event_time, duration) of completed jobs."""
    done = within(events, tr).filter(is_type("JOB_COMPLETED")).withColumn("_ms", duration_ms())
    done = final_events(done, ["_ms"]).select("event_time", "_ms")
    return done if keep_zero else done.filter("_ms > 0")


def latency_summary(events: DataFrame, tr: TimeRange, approx: bool = False) -> DataFrame:
    """Percentiles, average and count of positive durations; one row, zeros when there are none."""
    durations = _durations(events, tr)
    percentiles = approx_percentiles if approx else exact_percentiles
    out = percentiles(durations, [], "_ms", LATENCY_SUMMARY, "count", "avg_ms")
    return out.select(*[finite(F.col(c)).alias(c) for c in (*LATENCY_SUMMARY, "avg_ms")], "count")


def latency_series(events: DataFrame, tr: TimeRange, approx: bool = False) -> DataFrame:
    """Percentiles and count of positive durations per minute."""
    percentiles = approx_percentiles if approx else exact_percentiles
    durations = _durations(events, tr).withColumn("bucket", minute())
    return percentiles(durations, ["bucket"], "_ms", LATENCY_SERIES, "count").orderBy("bucket")


# --- outcomes ---------------------------------------------------------------------------------


def outcome_counts(events: DataFrame, tr: TimeRange) -> DataFrame:
    """Events per outcome type; absent types have no row."""
    return (
        final_keys(within(events, tr).filter(is_type(*OUTCOME_TYPES)))
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def outcome_rates(events: DataFrame, tr: TimeRange) -> DataFrame:
    """Success, failure, timeout and cancel shares of all ends, and the share of retries."""
    keys = final_keys(within(events, tr).filter(is_type(*OUTCOME_TYPES)))
    counts = keys.agg(
        count_of(is_type("JOB_COMPLETED")).alias("completed"),
        count_of(is_type("JOB_FAILED")).alias("failed"),
        count_of(is_type("JOB_TIMEOUT")).alias("timeout"),
        count_of(is_type("JOB_CANCELLED")).alias("cancelled"),
        count_of(is_type("JOB_RETRY_SCHEDULED")).alias("retry"),
    )
    return _rates(counts)


def _rates(counts: DataFrame) -> DataFrame:
    attempts = F.col("completed") + F.col("failed") + F.col("timeout")
    ends = attempts + F.col("cancelled")
    return counts.select(
        ratio(F.col("completed"), ends).alias("success_rate"),
        ratio(F.col("failed"), ends).alias("failure_rate"),
        ratio(F.col("timeout"), ends).alias("timeout_rate"),
        ratio(F.col("cancelled"), ends).alias("cancel_rate"),
        F.when(attempts > 0, ratio(F.col("retry"), attempts + F.col("retry")))
        .otherwise(F.lit(0.0))
        .alias("retry_rate"),
    )


def failure_series(events: DataFrame, tr: TimeRange) -> DataFrame:
    """Failures, timeouts and retries per minute; minutes with any event are kept."""
    return (
        _keys(events, tr)
        .groupBy(minute().alias("bucket"))
        .agg(
            count_of(is_type("JOB_FAILED")).alias("failed"),
            count_of(is_type("JOB_TIMEOUT")).alias("timeout"),
            count_of(is_type("JOB_RETRY_SCHEDULED")).alias("retry"),
        )
        .orderBy("bucket")
    )


# Retries are reported with the same figures as failures.
retry_counts, retry_rates, retry_series = outcome_counts, outcome_rates, failure_series


# --- workers ----------------------------------------------------------------------------------


def worker_stats(events: DataFrame, tr: TimeRange, top: int = TOP_WORKERS) -> DataFrame:
    """Busiest workers by completed jobs, their average duration and share among those shown."""
    rows = final_events(
        within(events, tr).withColumn("_ms", F.when(is_type("JOB_COMPLETED"), duration_ms())),
        ["worker_id", "_ms"],
    ).filter("worker_id != ''")
    per_worker = rows.groupBy("worker_id").agg(
        count_of(is_type("JOB_COMPLETED")).alias("completed"),
        count_of(is_type("JOB_FAILED")).alias("failed"),
        F.avg(F.when(F.col("_ms") > 0, F.col("_ms"))).alias("avg_ms"),
    )
    shown = per_worker.orderBy(F.desc("completed"), "worker_id").limit(top)
    everyone = Window.partitionBy(F.lit(0))  # over the rows shown only
    return shown.select(
        "worker_id",
        "completed",
        "failed",
        finite(F.col("avg_ms")).alias("avg_ms"),
        ratio(F.col("completed"), F.sum("completed").over(everyone)).alias("share"),
    )


# --- queue ------------------------------------------------------------------------------------


def queue_waits(events: DataFrame, tr: TimeRange) -> DataFrame:
    """First QUEUED to first STARTED per job, for jobs that started after they were queued."""
    rows = final_events(
        within(events, tr).filter(is_type("JOB_QUEUED", "JOB_STARTED")), ["job_id"]
    ).filter("job_id != ''")
    firsts = rows.groupBy("job_id").agg(
        F.min(F.when(is_type("JOB_QUEUED"), F.col("event_time"))).alias("queued_at"),
        F.min(F.when(is_type("JOB_STARTED"), F.col("event_time"))).alias("started_at"),
    )
    return firsts.filter("started_at >= queued_at").select(
        "job_id", "queued_at", "started_at", millis_between("queued_at", "started_at").alias("wait_ms")
    )


def queue_wait(events: DataFrame, tr: TimeRange) -> DataFrame:
    """Average and 95th percentile of the wait, and the number of jobs paired."""
    out = exact_percentiles(queue_waits(events, tr), [], "wait_ms", {"p95_wait_ms": 0.95}, "pairs", "avg_wait_ms")
    return out.select(
        finite(F.col("avg_wait_ms")).alias("avg_wait_ms"), finite(F.col("p95_wait_ms")).alias("p95_wait_ms"), "pairs"
    )


def queue_depth(events: DataFrame, tr: TimeRange) -> DataFrame:
    """Queued and started events and the estimate of what is still waiting."""
    return (
        final_keys(within(events, tr).filter(is_type("JOB_QUEUED", "JOB_STARTED")))
        .agg(
            count_of(is_type("JOB_QUEUED")).alias("queued"),
            count_of(is_type("JOB_STARTED")).alias("started"),
        )
        .withColumn("depth_estimate", F.greatest(F.lit(0.0), (F.col("queued") - F.col("started")).cast("double")))
    )


# --- capacity ---------------------------------------------------------------------------------


def completed_per_minute(events: DataFrame, tr: TimeRange) -> DataFrame:
    """Total, peak and average of completed jobs per minute with any event."""
    per_minute = _keys(events, tr).groupBy(minute().alias("m")).agg(count_of(is_type("JOB_COMPLETED")).alias("c"))
    return _peaks(per_minute)


def _peaks(per_minute: DataFrame) -> DataFrame:
    return per_minute.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("completed"),
        F.coalesce(F.max("c"), F.lit(0)).alias("peak_per_minute"),
        finite(F.avg("c")).alias("avg_per_minute"),
    )


def active_workers(events: DataFrame, tr: TimeRange) -> DataFrame:
    """Workers that completed at least one job."""
    done = final_events(within(events, tr).filter(is_type("JOB_COMPLETED")), ["worker_id"])
    return (
        done.filter("worker_id != ''").select("worker_id").distinct().agg(F.count(F.lit(1)).alias("active_workers"))
    )


def recommended_workers(peaks: DataFrame, target: float = JOBS_PER_WORKER_PER_MINUTE) -> DataFrame:
    """Workers needed for the peak at ``target`` jobs per worker and minute."""
    target = float(target) if target > 0 else JOBS_PER_WORKER_PER_MINUTE
    need = F.ceil(F.col("peak_per_minute").cast("double") / F.lit(target)).cast("int")
    return peaks.withColumn("target_per_worker", F.lit(target)).withColumn("recommended_workers", need)


def capacity(events: DataFrame, tr: TimeRange, target: float = JOBS_PER_WORKER_PER_MINUTE) -> DataFrame:
    """Load per minute, active workers and the recommended number of workers, in one row."""
    # One removal of copies, one count per minute and worker; sums by minute and by worker in one aggregate over it.
    rows = final_events(within(events, tr), ["worker_id"])
    done = is_type("JOB_COMPLETED")
    cells = rows.groupBy(minute().alias("m"), F.when(done, F.col("worker_id")).alias("w")).agg(count_of(done).alias("c"))
    sums = cells.groupingSets([[F.col("m")], [F.col("w")]], "m", "w").agg(F.sum("c").alias("_c"), F.grouping("m").alias("_by_worker"))
    per_minute = F.when(F.col("_by_worker") == 0, F.col("_c"))
    one = sums.agg(
        F.coalesce(F.sum(per_minute), F.lit(0)).alias("completed"),
        F.coalesce(F.max(per_minute), F.lit(0)).alias("peak_per_minute"),
        finite(F.avg(per_minute)).alias("avg_per_minute"),
        count_of((F.col("_by_worker") == 1) & (F.col("w") != "") & (F.col("_c") > 0)).alias("active_workers"),
    )
    measures = ["completed", "peak_per_minute", "avg_per_minute"]
    return recommended_workers(one, target).select(*measures, "target_per_worker", "recommended_workers", "active_workers")


def parse_target(text: str | None) -> float:
    """``target_per_worker`` as given by a user; the default when unreadable or not positive."""
    try:
        value = float(text) if text else JOBS_PER_WORKER_PER_MINUTE
    except ValueError:
        return JOBS_PER_WORKER_PER_MINUTE
    return value if value > 0 else JOBS_PER_WORKER_PER_MINUTE


# --- anomalies --------------------------------------------------------------------------------

# Metric, warn factor, critical factor, whether high values are bad.
ANOMALY_CHECKS = [
    ("p95_latency_ms", 2.0, 4.0, True),
    ("failure_rate", 2.0, 5.0, True),
    ("throughput_per_sec", 2.0, 4.0, False),
]


def snapshots(events: DataFrame, windows: dict[str, TimeRange]) -> DataFrame:
    """p95 of the duration (missing ones count as 0), failure rate and throughput per window.

    All windows are answered in one pass; a row belongs to each window that covers it. Every
    window has a row, with zeros when it holds no event.
    """
    lo, hi = min(w.start for w in windows.values()), max(w.end for w in windows.values())
    rows = final_events(
        within(events, TimeRange(lo, hi))
        .filter(is_type("JOB_COMPLETED", "JOB_FAILED"))
        .withColumn("_ms", F.when(is_type("JOB_COMPLETED"), duration_ms())),
        ["_ms"],
    )
    t = F.col("event_time")
    tags = [
        F.when((t >= instant(w.start)) & (t < instant(w.end)), F.lit(tag)) for tag, w in windows.items()
    ]
    rows = rows.withColumn("win", F.explode(F.array_compact(F.array(*tags))))
    # Completed jobs have a duration, failed ones have none: the counts come with the percentile.
    found = exact_percentiles(rows, ["win"], "_ms", {"p95": 0.95}, count_name="completed", null_name="failed")

    spark = events.sparkSession
    frame = spark.range(1).select(
        F.inline(
            F.array(
                *[F.struct(F.lit(t).alias("win"), F.lit(w.seconds).alias("seconds")) for t, w in windows.items()]
            )
        )
    )
    out = frame.join(found, "win", "left")
    done, failed = F.coalesce("completed", F.lit(0)), F.coalesce("failed", F.lit(0))
    return out.select(
        "win",
        finite(F.col("p95")).alias("p95_latency_ms"),
        ratio(failed, done + failed).alias("failure_rate"),
        ratio(done, F.col("seconds")).alias("throughput_per_sec"),
    )


def anomalies(events: DataFrame, current: TimeRange, baseline: TimeRange) -> DataFrame:
    """Metrics of the current window that are far off the baseline window."""
    return check_anomalies(snapshots(events, {"current": current, "baseline": baseline}))


def check_anomalies(snaps: DataFrame) -> DataFrame:
    """Compare the rows ``current`` and ``baseline`` of :func:`snapshots`."""
    names = [c[0] for c in ANOMALY_CHECKS]
    pick = lambda name, win: F.max(F.when(F.col("win") == win, F.col(name)))
    one = snaps.agg(*[pick(n, w).alias(f"{n}_{w[0]}") for n in names for w in ("baseline", "current")])
    checks = [
        F.struct(
            F.lit(n).alias("metric"),
            F.col(f"{n}_b").alias("baseline"),
            F.col(f"{n}_c").alias("current"),
            F.lit(warn).alias("_warn"),
            F.lit(crit).alias("_crit"),
            F.lit(high_bad).alias("_high_bad"),
        )
        for n, warn, crit, high_bad in ANOMALY_CHECKS
    ]
    long = one.select(F.explode(F.array(*checks)).alias("c")).select("c.*")

    b, c, warn, crit = F.col("baseline"), F.col("current"), F.col("_warn"), F.col("_crit")
    rel = F.when(b > 0, c / b).when(c > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    rise = F.when(F.col("ratio") >= crit, "critical").when(F.col("ratio") >= warn, "warn")
    drop = F.when((b > 0) & (F.col("ratio") <= 1 / crit), "critical").when(
        (b > 0) & (F.col("ratio") <= 1 / warn), "warn"
    )
    return (
        long.filter((b > 0) | (c > 0))
        .withColumn("ratio", rel)
        .withColumn("severity", F.when(F.col("_high_bad"), rise).otherwise(drop))
        .filter("severity IS NOT NULL")
        .select("metric", "baseline", "current", "ratio", "severity")
    )


def with_message(found: DataFrame) -> DataFrame:
    """Add the readable sentence to the rows of :func:`anomalies`."""
    # Fixed value: the format of the sentence.
    text = F.format_string(
        "%s baseline=%.2f current=%.2f ratio=%s",
        F.col("metric"),
        F.col("baseline"),
        F.col("current"),
        F.when(F.col("ratio") == float("inf"), "+Inf").otherwise(F.format_string("%.2f", F.col("ratio"))),
    )
    return found.withColumn("message", text)


# --- scheduler --------------------------------------------------------------------------------


def scheduler_events(events: DataFrame, tr: TimeRange) -> DataFrame:
    """Scheduler events per type."""
    return (
        final_keys(within(events, tr).filter(F.col("event_type").startswith("SCHEDULER_")))
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
