"""Rollups of the event log: counters that add up and mergeable sketches.

They are built from the deduplicated log (``dedupe=False`` counts copies). The two fine tables
read events; the failure, hourly and daily tables are sums over the minute table and never touch
the log again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.functions.percentiles import ALL, bin_of, percentiles_in, pick_bins
from jobtrail.functions.scalar import count_of, day, duration_ms, finite, hour, is_type, minute
from jobtrail.operators.analytics import LATENCY_SUMMARY, _durations, _peaks, _rates, _totals
from jobtrail.operators.dedupe import final_events
from jobtrail.operators.timerange import TimeRange, within
from jobtrail.schema import FAILURE_TYPES, OUTCOME_TYPES

HLL_LG_K = 12
KLL_K = 200

COUNTERS = {
    "job_minute_stats": (["minute", "event_type"], ["cnt", "duration_sum", "duration_count"]),
    "worker_minute_stats": (["minute", "worker_id", "event_type"], ["cnt", "duration_sum", "duration_count"]),
    "failure_minute_stats": (["minute", "event_type"], ["cnt"]),
    "job_hourly_stats": (["hour", "event_type"], ["cnt", "duration_sum", "duration_count"]),
    "job_daily_stats": (["day", "event_type"], ["cnt"]),
}


def rollup_input(events: DataFrame, dedupe: bool = True) -> DataFrame:
    """The columns the rollups read, one row per event. ``ms`` is the duration of completed jobs."""
    rows = events.withColumn("ms", F.when(is_type("JOB_COMPLETED"), duration_ms()))
    if dedupe:
        return final_events(rows, ["job_id", "worker_id", "ms"])
    return rows.select("event_type", "event_time", "event_id", "job_id", "worker_id", "ms")


def _counters() -> list:
    return [
        F.count(F.lit(1)).alias("cnt"),
        F.coalesce(F.sum("ms"), F.lit(0)).alias("duration_sum"),
        count_of(F.col("ms") > 0).alias("duration_count"),
    ]


def job_minute_stats(rows: DataFrame, sketches: bool = True) -> DataFrame:
    """Per minute and type: counters, distinct-job sketch and duration sketch.

    ``rows`` comes from :func:`rollup_input`.
    """
    aggs = _counters()
    if sketches:
        aggs += [
            F.hll_sketch_agg("job_id", F.lit(HLL_LG_K)).alias("uniq_jobs"),
            F.kll_sketch_agg_double(F.when(F.col("ms") > 0, F.col("ms").cast("double")), F.lit(KLL_K)).alias(
                "durations"
            ),
        ]
    return rows.groupBy(minute().alias("minute"), "event_type").agg(*aggs)


def minute_duration_bins(rows: DataFrame) -> DataFrame:
    """(minute, bin, n, total): positive durations per minute and logarithmic bin, counts that add up.

    A bin is about a thousandth of its values wide; a minute has at most as many rows as it has durations.
    """
    timed = rows.filter(F.col("ms") > 0).select(minute().alias("minute"), bin_of(F.col("ms")).alias("bin"), "ms")
    return timed.groupBy("minute", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total"))


def worker_minute_stats(rows: DataFrame) -> DataFrame:
    """Per minute, worker and type."""
    return (
        rows.filter("worker_id != ''").groupBy(minute().alias("minute"), "worker_id", "event_type").agg(*_counters())
    )


def failure_minute_stats(minutes: DataFrame) -> DataFrame:
    """The failure types of the minute table."""
    rows = minutes.filter(is_type(*FAILURE_TYPES)).groupBy("minute", "event_type")
    return rows.agg(F.sum("cnt").alias("cnt"))


def job_hourly_stats(minutes: DataFrame) -> DataFrame:
    """The minute table per hour."""
    return merge_counters(
        minutes.withColumn("hour", hour("minute")), ["hour", "event_type"], ["cnt", "duration_sum", "duration_count"]
    )


def job_daily_stats(minutes: DataFrame) -> DataFrame:
    """The minute (or hourly) table per day."""
    at = "minute" if "minute" in minutes.columns else "hour"
    return merge_counters(minutes.withColumn("day", day(at)), ["day", "event_type"], ["cnt"])


def merge_counters(parts: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Add up the counters of rows with equal keys."""
    return parts.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def merge_minute_parts(parts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Merge partial rows of the minute table, sketches included. ``keys`` may be coarser."""
    keys = ["minute", "event_type"] if keys is None else keys
    grouped = parts.groupBy(*keys) if keys else parts
    return grouped.agg(
        *[F.sum(m).alias(m) for m in ("cnt", "duration_sum", "duration_count")],
        F.hll_union_agg("uniq_jobs").alias("uniq_jobs"),
        F.kll_merge_agg_double("durations").alias("durations"),
    )


def finalise(minutes: DataFrame) -> DataFrame:
    """Read the sketches: estimated distinct jobs and duration percentiles (NULL without durations)."""
    q = lambda p: F.when(
        F.col("duration_count") > 0, F.kll_sketch_get_quantile_double("durations", F.lit(p))
    )
    return minutes.select(
        *[c for c in minutes.columns if c not in ("uniq_jobs", "durations")],
        F.hll_sketch_estimate("uniq_jobs").alias("uniq_jobs"),
        q(0.5).alias("p50_ms"),
        q(0.9).alias("p90_ms"),
        q(0.95).alias("p95_ms"),
        q(0.99).alias("p99_ms"),
    )


# --- answers from the rollups -----------------------------------------------------------------
# Same figures as the event-log queries for windows on minute (or hour) borders, from tables
# that are smaller by orders of magnitude.


def _sum_if(*types: str):
    return F.coalesce(F.sum(F.when(is_type(*types), F.col("cnt"))), F.lit(0))


def throughput_points(stats: DataFrame, tr: TimeRange, grain: str = "minute") -> DataFrame:
    """Throughput from the minute or (grain ``hour``) the hourly table."""
    by_hour = grain == "hour"
    at = "hour" if "hour" in stats.columns else "minute"
    bucket = hour(at) if by_hour else F.col(at)
    return (
        within(stats, tr, at)
        .groupBy(bucket.alias("bucket"))
        .agg(
            _sum_if("JOB_COMPLETED").alias("completed"),
            _sum_if("JOB_FAILED").alias("failed"),
            _sum_if("JOB_CREATED").alias("created"),
        )
        .withColumn("rate_per_sec", F.col("completed").cast("double") / F.lit(3600.0 if by_hour else 60.0))
        .orderBy("bucket")
    )


def throughput_totals(stats: DataFrame, tr: TimeRange) -> DataFrame:
    counts = within(stats, tr, "minute").agg(
        _sum_if("JOB_COMPLETED").alias("completed"),
        _sum_if("JOB_FAILED").alias("failed"),
        _sum_if("JOB_CREATED").alias("created"),
    )
    return _totals(counts, tr)


def outcome_rates(stats: DataFrame, tr: TimeRange) -> DataFrame:
    counts = within(stats, tr, "minute").agg(
        _sum_if("JOB_COMPLETED").alias("completed"),
        _sum_if("JOB_FAILED").alias("failed"),
        _sum_if("JOB_TIMEOUT").alias("timeout"),
        _sum_if("JOB_CANCELLED").alias("cancelled"),
        _sum_if("JOB_RETRY_SCHEDULED").alias("retry"),
    )
    return _rates(counts)


def outcome_counts(stats: DataFrame, tr: TimeRange) -> DataFrame:
    return (
        within(stats, tr, "minute").filter(is_type(*OUTCOME_TYPES)).groupBy("event_type").agg(F.sum("cnt").alias("cnt"))
    )


def failure_series(stats: DataFrame, tr: TimeRange) -> DataFrame:
    return (
        within(stats, tr, "minute")
        .groupBy(F.col("minute").alias("bucket"))
        .agg(
            _sum_if("JOB_FAILED").alias("failed"),
            _sum_if("JOB_TIMEOUT").alias("timeout"),
            _sum_if("JOB_RETRY_SCHEDULED").alias("retry"),
        )
        .orderBy("bucket")
    )


def latency_summary(bins: DataFrame, events: DataFrame, tr: TimeRange) -> DataFrame:
    """``analytics.latency_summary`` of a range on minutes, exact, from ``minute_duration_bins``.

    The bins say in which of them the wanted ranks lie. Only the values of these few bins are read from the log, and of
    the log only the days on which they occur.
    """
    inside = within(bins, tr, "minute")
    merged = inside.groupBy(F.lit(0).alias(ALL), F.col("bin").alias("_bin")).agg(
        F.sum("n").alias("_bn"), F.sum(F.col("total").cast("double")).alias("_bs")
    )
    picked = pick_bins(merged, [ALL], LATENCY_SUMMARY)
    chosen = [r._bin for r in picked.select("_bin").collect()]  # two for each percentile at most
    days = days_of_bins(inside, chosen)
    near = events.filter(day().isin(days)) if "event_day" not in events.columns else events.filter(F.col("event_day").isin(days))
    values = _durations(near, tr).select(F.lit(0).alias(ALL), F.col("_ms").alias("_v")).filter(bin_of(F.col("_v")).isin(chosen))
    hist = values.groupBy(ALL, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_bin", bin_of(F.col("_v")))
    out = percentiles_in(hist, picked, [], LATENCY_SUMMARY, "count", "avg_ms")
    return out.select(*[finite(F.col(c)).alias(c) for c in (*LATENCY_SUMMARY, "avg_ms")], "count")


def days_of_bins(bins: DataFrame, chosen: list[int]) -> list:
    """Days on which durations fall in some of the bins: at most the days that the table keeps."""
    return [r.d for r in bins.filter(F.col("bin").isin(chosen)).select(day("minute").alias("d")).distinct().collect()]


def completed_per_minute(stats: DataFrame, tr: TimeRange) -> DataFrame:
    return _peaks(within(stats, tr, "minute").groupBy("minute").agg(_sum_if("JOB_COMPLETED").alias("c")))
