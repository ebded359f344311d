"""Every operator as a named query over the generated tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.functions.scalar import month
from jobtrail.operators import analytics as aq
from jobtrail.operators import dashboard as db
from jobtrail.operators import jobs as jb
from jobtrail.operators import lifecycle as lc
from jobtrail.operators import rollups as ru
from jobtrail.operators.dedupe import count_events, create_final_view, final_events
from jobtrail.operators.distinct import distinct_jobs, minute_jobs, number_jobs
from jobtrail.operators.retention import RETENTION_DAYS, expired_days, retain
from jobtrail.operators.schedules import with_next_run
from jobtrail.operators.timerange import UTC, TimeRange
from jobtrail.schema import JOB, OUTBOX, WORKER
from jobtrail.session import work_folder
from jobtrail.sinks import event_log, outbox, snapshot
from jobtrail.sources import messages as msg
from jobtrail.sources import readers, tables
from jobtrail.sources import testdata as td
from jobtrail.streaming import queries as st

Query = Callable[[SparkSession, str], DataFrame]

# Windows that cover the whole of the generated events.
WHOLE = TimeRange(datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 2, 1, tzinfo=UTC))
CURRENT = TimeRange(datetime(2024, 1, 16, tzinfo=UTC), datetime(2024, 1, 31, tzinfo=UTC))
BASELINE = TimeRange(datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 16, tzinfo=UTC))
# "Now" of the log, of the jobs and of the workers.
LOG_NOW = datetime(2024, 2, 10, 12, tzinfo=UTC)
JOBS_NOW = datetime(1998, 1, 1, 0, 0, 30, tzinfo=UTC)
WORKERS_NOW = datetime(1998, 1, 1, tzinfo=UTC)


def _over_log(fn: Callable, *args, **kw) -> Query:
    return lambda s, d: fn(td.events(s, d), *args, **kw)


def _over_minutes(fn: Callable, *args, **kw) -> Query:
    """A query answered from the minute rollup."""
    return lambda s, d: fn(_minutes(s, d), *args, **kw)


def _minutes(s: SparkSession, d: str, sketches: bool = False, dedupe: bool = True) -> DataFrame:
    return ru.job_minute_stats(ru.rollup_input(td.events(s, d), dedupe), sketches)


def _decoded(s: SparkSession, d: str) -> DataFrame:
    return msg.decode_events(td.event_messages(s, d))


# --- sources and sinks ------------------------------------------------------------------------


def decoded_events(s: SparkSession, d: str) -> DataFrame:
    return msg.valid_events(_decoded(s, d)).select(
        "event_id", "event_type", "event_time", "job_id", "worker_id", "attempt", "payload"
    )


def reject_counts(s: SparkSession, d: str) -> DataFrame:
    return msg.rejected_events(_decoded(s, d)).groupBy("reason").agg(F.count(F.lit(1)).alias("cnt"))


def rejects(s: SparkSession, d: str) -> DataFrame:
    return msg.rejected_events(_decoded(s, d))


def replayed(s: SparkSession, d: str) -> DataFrame:
    rows = readers.replay(td.event_messages(s, d), until=LOG_NOW)
    return rows.select("event_id", "event_type", "event_time", "source_time", "job_id")


def unpublished(s: SparkSession, d: str) -> DataFrame:
    return tables.unpublished(td.outbox(s, d), limit=None).select("id", "event_type", "aggregate_id", "created_at")


def stored_jobs(s: SparkSession, d: str) -> DataFrame:
    """Jobs written the way the operational store keeps them, then decoded."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    stored = td.jobs(s, d).withColumns(
        {c: F.to_json(c) for c in ("schedule", "retry_policy", "metadata")}
        | {c: blank(c) for c in ("idempotency_key", "worker_id", "execution_id", "last_error")}
    )
    return tables.decode_jobs(stored).select(
        "job_id",
        "idempotency_key",
        "worker_id",
        F.col("schedule.type").alias("schedule_type"),
        F.col("schedule.delay").alias("delay"),
        F.col("schedule.run_at").alias("run_at"),
        F.col("retry_policy.initial_delay").alias("initial_delay"),
        F.element_at("metadata", "source").alias("source"),
    )


def work_messages(s: SparkSession, d: str) -> DataFrame:
    rows = msg.decode_queued_jobs(td.work_messages(s, d))
    return rows.filter("reject_reason IS NULL").select(
        "job_id", "type", "payload", "priority", "attempt", "timeout", "enqueued_at"
    )


def normalised(s: SparkSession, d: str) -> DataFrame:
    rows = event_log.normalise(msg.valid_events(_decoded(s, d)), LOG_NOW)
    return rows.select("event_id", "event_type", "event_time", "ingested_at", "job_id", "attempt", "payload")


def routed(s: SparkSession, d: str) -> DataFrame:
    return outbox.route(td.outbox(s, d)).select("id", "topic", "key", "timestamp")


# A range on minutes inside the log.
SOME_DAYS = TimeRange(datetime(2024, 1, 5, 3, tzinfo=UTC), datetime(2024, 1, 20, 15, 30, tzinfo=UTC))


def exact_jobs(s: SparkSession, d: str) -> DataFrame:
    """Distinct jobs per type in a range, from the minute table of jobs."""
    log = td.events(s, d)
    return distinct_jobs(minute_jobs(log, number_jobs(log)), SOME_DAYS, "event_type")


def latency_from_bins(s: SparkSession, d: str) -> DataFrame:
    log = td.events(s, d)
    return ru.latency_summary(ru.minute_duration_bins(ru.rollup_input(log)), log, WHOLE)


def _to_publish(box: DataFrame) -> DataFrame:
    return tables.unpublished(box, limit=None).filter("event_type LIKE 'JOB\\_%'")


def published(s: SparkSession, d: str) -> DataFrame:
    box = td.outbox(s, d)
    return outbox.mark_published(box, _to_publish(box), LOG_NOW).select("id", "published_at")


# Buckets of the small tables that the written queries change in place.
WRITTEN_BUCKETS = 16


def _written(rows: DataFrame, changes: DataFrame, schema: str, key: str, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A table written, changed in place and read again."""
    s, root = rows.sparkSession, work_folder(rows.sparkSession, "snapshot")
    snapshot.create(rows, root, key, WRITTEN_BUCKETS)
    snapshot.update(changes, root, schema, key, apply, WRITTEN_BUCKETS)
    return snapshot.read(s, root, schema)


def written_published(s: SparkSession, d: str) -> DataFrame:
    box = td.outbox(s, d)
    done = _written(box, _to_publish(box), OUTBOX, "id", lambda rows, ids: outbox.mark_published(rows, ids, LOG_NOW))
    return done.select("id", "published_at")


def emitted(s: SparkSession, d: str) -> DataFrame:
    """Events of promoting the due jobs, as outbox rows."""
    due = lc.promote_due(td.jobs(s, d), JOBS_NOW).events
    return outbox.to_outbox(outbox.to_events(due, JOBS_NOW, "scheduler-1")).select(
        "id", "event_type", "aggregate_id", F.get_json_object("payload", "$.attempt").alias("attempt"), "created_at"
    )


def replay_lines(s: SparkSession, d: str) -> DataFrame:
    return outbox.replay_lines(readers.replay(td.event_messages(s, d)))


# --- log --------------------------------------------------------------------------------------


def final_view(s: SparkSession, d: str) -> DataFrame:
    create_final_view(td.events(s, d), "events_final")
    return s.sql("SELECT event_type, count(*) AS cnt, max(ingested_at) AS newest FROM events_final GROUP BY event_type")


def retained(s: SparkSession, d: str) -> DataFrame:
    rows = retain(td.events(s, d), "event_time", RETENTION_DAYS["events"], LOG_NOW)
    return rows.select("event_id", "event_type", "event_time", "ingested_at")


def retained_rollup(name: str, at: str, now: datetime) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        minutes = _minutes(s, d)
        table = {
            "job_minute_stats": lambda: minutes,
            "failure_minute_stats": lambda: ru.failure_minute_stats(minutes),
            "job_hourly_stats": lambda: ru.job_hourly_stats(minutes),
            "job_daily_stats": lambda: ru.job_daily_stats(minutes),
        }[name]()
        return retain(table, at, RETENTION_DAYS[name], now).select(at, "event_type", "cnt")

    return run


def expired(s: SparkSession, d: str) -> DataFrame:
    return expired_days(event_log.with_day(td.events(s, d)), RETENTION_DAYS["events"], LOG_NOW)


def partitions(s: SparkSession, d: str) -> DataFrame:
    rows = event_log.with_day(td.events(s, d))
    return rows.groupBy(month("event_time").alias("month"), "event_day").agg(F.count(F.lit(1)).alias("cnt"))


# --- rollups ----------------------------------------------------------------------------------


# How far the rank of an estimated quantile, and an estimated number of distinct values, may be off.
RANK_ERROR, DISTINCT_ERROR = 0.03, 0.05


def _ranks_hold(value: Column, estimate: Column, q: float) -> Column:
    """Whether the values at or below an estimate are about the share q of all; true without values."""
    n = F.count(value)
    below, upto = F.count(F.when(value < estimate, 1)), F.count(F.when(value <= estimate, 1))
    return (n == 0) | ((below <= (q + RANK_ERROR) * n) & (upto >= (q - RANK_ERROR) * n))


def _sketches_hold(s: SparkSession, d: str, estimated: DataFrame, keys: list[str]) -> DataFrame:
    """The counters of rows with sketches, and whether each sketch is as near to the log as it promises."""
    rows = ru.rollup_input(td.events(s, d)).withColumn("minute", F.date_trunc("minute", "event_time"))
    rows = rows.select(*keys, "job_id", F.when(F.col("ms") > 0, F.col("ms")).alias("_ms")).join(estimated, keys)
    counters = ["cnt", "duration_sum", "duration_count"]
    jobs, near = F.count_distinct("job_id"), F.first("uniq_jobs")
    quantiles = {"p50_ms": 0.5, "p90_ms": 0.9, "p95_ms": 0.95, "p99_ms": 0.99}
    held = [_ranks_hold(F.col("_ms"), F.col(c), q) for c, q in quantiles.items()]
    return rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in counters],
        (F.abs(near - jobs) <= F.greatest(F.lit(1.0), DISTINCT_ERROR * jobs)).alias("jobs_hold"),
        reduce(lambda a, b: a & b, held).alias("quantiles_hold"),
    )


def minute_sketches(s: SparkSession, d: str) -> DataFrame:
    return _sketches_hold(s, d, ru.finalise(_minutes(s, d, sketches=True)), ["minute", "event_type"])


def merged_sketches(s: SparkSession, d: str) -> DataFrame:
    """The whole month from the minute sketches."""
    merged = ru.merge_minute_parts(_minutes(s, d, sketches=True), ["event_type"])
    return _sketches_hold(s, d, ru.finalise(merged), ["event_type"])


def approximate_latency(s: SparkSession, d: str) -> DataFrame:
    """Count and average, and whether the ranks of the approximate percentiles are right."""
    log = td.events(s, d)
    near = aq.latency_summary(log, WHOLE, approx=True)
    rows = aq._durations(log, WHOLE).select("_ms").join(near, F.lit(True))  # one row of figures
    held = [_ranks_hold(F.col("_ms"), F.col(c), q) for c, q in aq.LATENCY_SUMMARY.items()]
    return rows.agg(F.first("count").alias("count"), F.first("avg_ms").alias("avg_ms"), reduce(lambda a, b: a & b, held).alias("percentiles_hold"))


def merged_parts(s: SparkSession, d: str) -> DataFrame:
    """Parts written per hour of ingestion, added up again."""
    rows = ru.rollup_input(td.events(s, d))
    parts = rows.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(4))).groupBy(
        F.date_trunc("hour", "event_time").alias("hour"), "event_type", "part"
    ).agg(*ru._counters())
    return ru.merge_counters(parts, ["hour", "event_type"], ["cnt", "duration_sum", "duration_count"])


# --- windows inside the log -------------------------------------------------------------------


def _inside(fn: Callable) -> Query:
    """A query over the written log, for a window that begins and ends at events: the first one counts, the last not."""

    def run(s: SparkSession, d: str) -> DataFrame:
        path = f"{work_folder(s, 'inside')}/log"
        event_log.write_sorted(td.events(s, d), path)
        log = event_log.read_events(s, path)
        first = lambda at: F.min(F.when(F.col("event_time") >= F.lit(at).cast("timestamp"), F.unix_micros("event_time")))
        ends = log.agg(first("2024-01-05 03:00:00"), first("2024-01-09 15:30:00")).first()
        begin, end = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us) for us in ends)
        return fn(log, TimeRange(begin, end))

    return run


# --- lifecycle --------------------------------------------------------------------------------


def idempotent_insert(which: int) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        jobs = td.jobs(s, d)
        asked = td.jobs(s, d).select(
            F.substring("job_id", 2, 20).cast("bigint").alias("request_no"),
            F.concat(F.lit("n"), F.substring("job_id", 2, 20)).alias("job_id"),
            F.when(F.col("attempt") == 0, "").otherwise(F.regexp_replace("name", "^job-", "k")).alias(
                "idempotency_key"
            ),
            F.when(F.col("attempt") == 1, 0).otherwise(F.col("priority")).alias("priority"),
            F.when(F.col("attempt") == 2, "").otherwise("SCHEDULED").alias("state"),
            F.when(F.col("attempt") != 3, F.col("payload")).alias("payload"),
        )
        new_rows, mapping = jb.create_jobs(asked, jobs, JOBS_NOW)
        return mapping if which else new_rows.select("job_id", "idempotency_key", "priority", "state", "payload")

    return run


def _wanted_transitions(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "job_id",
        F.lit("QUEUED").alias("new_state"),
        F.when(F.col("priority") > 1, F.array(F.lit("SCHEDULED"), F.lit("RETRYING"))).alias("only_from"),
        F.lit("").alias("worker_id"),
        F.when(F.col("attempt") > 0, F.lit("again")).alias("last_error"),
    ).filter("attempt < 3")


def transitions(s: SparkSession, d: str) -> DataFrame:
    jobs = td.jobs(s, d)
    return jb.apply_transitions(jobs, _wanted_transitions(jobs), JOBS_NOW).select(
        "job_id", "state", "worker_id", "last_error", "updated_at"
    )


def written_transitions(s: SparkSession, d: str) -> DataFrame:
    jobs = td.jobs(s, d)
    done = _written(jobs, _wanted_transitions(jobs), JOB, "job_id", lambda rows, u: jb.apply_transitions(rows, u, JOBS_NOW))
    return done.select("job_id", "state", "worker_id", "last_error", "updated_at")


def finished_executions(s: SparkSession, d: str) -> DataFrame:
    ended = lc.result_executions(lc.decide_results(td.results(s, d), td.jobs(s, d), JOBS_NOW))
    return jb.finish_executions(td.executions(s, d), ended, JOBS_NOW).select(
        "execution_id", "state", "duration_ms", "error", "retryable", "finished_at"
    )


def created_executions(s: SparkSession, d: str) -> DataFrame:
    pairs = td.jobs(s, d).filter("state = 'QUEUED' AND worker_id != ''").select("job_id", "worker_id", "attempt")
    made = jb.new_executions(lc.assign(pairs, JOBS_NOW).executions, JOBS_NOW)
    return made.select("job_id", "worker_id", "attempt", "state", "created_at")


def _reports(s: SparkSession, d: str) -> DataFrame:
    """The reports that heartbeats make."""
    return td.heartbeats(s, d).select(
        "worker_id",
        F.concat("worker_id", F.lit(":9000")).alias("address"),
        F.lit("HEALTHY").alias("status"),
        "capacity",
        F.col("active").alias("active_jobs"),
        F.lit(None).cast("struct<builtin:boolean,webhook:boolean>").alias("capabilities"),
        F.lit(None).cast("map<string,string>").alias("labels"),
        F.col("ts").alias("last_heartbeat"),
        F.col("ts").alias("registered_at"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def upserted_workers(s: SparkSession, d: str) -> DataFrame:
    """Workers after their reports."""
    rows = jb.upsert_workers(td.workers(s, d), _reports(s, d))
    return rows.select("worker_id", "address", "last_heartbeat", "registered_at")


def written_workers(s: SparkSession, d: str) -> DataFrame:
    done = _written(td.workers(s, d), _reports(s, d), WORKER, "worker_id", jb.upsert_workers)
    return done.select("worker_id", "address", "last_heartbeat", "registered_at")


def validated(s: SparkSession, d: str) -> DataFrame:
    rows = lc.validate_requests(td.requests(s, d), JOBS_NOW)
    return rows.select("request_id", "type", "priority", "timeout_ms", "error")


def planned(s: SparkSession, d: str) -> DataFrame:
    rows = lc.plan_requests(lc.validate_requests(td.requests(s, d), JOBS_NOW), JOBS_NOW)
    return rows.select("request_id", "state", "scheduled_at", "queued_at", "max_attempts")


def planned_events(s: SparkSession, d: str) -> DataFrame:
    rows = lc.plan_requests(lc.validate_requests(td.requests(s, d), JOBS_NOW), JOBS_NOW)
    events = lc.request_events(rows)
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt"), F.countDistinct("job_id").alias("jobs"))


def promoted(part: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        out = lc.promote_due(td.jobs(s, d), JOBS_NOW)
        if part == "events":
            return out.events.select("event_type", "job_id", "attempt")
        return out.messages.select("job_id", "type", "priority", "attempt", "timeout_ms", "enqueued_at")

    return run


def promoted_table(s: SparkSession, d: str) -> DataFrame:
    """The job table after the due jobs were queued."""
    jobs = td.jobs(s, d)
    after = jb.apply_transitions(jobs, lc.promote_due(jobs, JOBS_NOW).updates, JOBS_NOW)
    return after.select("job_id", "state", "queued_at")


def decided(s: SparkSession, d: str) -> DataFrame:
    rows = lc.decide_results(td.results(s, d), td.jobs(s, d), JOBS_NOW)
    return rows.select("execution_id", "job_id", "action", "job_state", "execution_state", "delay_ms", "next_retry_at")


def decided_updates(s: SparkSession, d: str) -> DataFrame:
    return lc.resolve_results(td.results(s, d), td.jobs(s, d), JOBS_NOW).updates


def decided_events(s: SparkSession, d: str) -> DataFrame:
    events = lc.resolve_results(td.results(s, d), td.jobs(s, d), JOBS_NOW).events
    return events.select("event_type", "execution_id", "attempt", "seq", "payload")


def delays(s: SparkSession, d: str) -> DataFrame:
    return lc.backoff(td.jobs(s, d)).select("job_id", "attempt", "delay_ms", "delay_min_ms", "delay_max_ms")


def timeout_outcomes(s: SparkSession, d: str) -> DataFrame:
    jobs = td.jobs(s, d)
    late = lc.timeouts_as_results(jobs, JOBS_NOW)
    rows = lc.decide_results(late, jobs, JOBS_NOW)
    return rows.select("job_id", "duration_ms", "action", "job_state", "next_retry_at")


def recovered(part: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        lost = jb.stale_workers(td.workers(s, d), WORKERS_NOW).filter("new_status = 'UNAVAILABLE'")
        out = lc.recover_jobs(td.jobs(s, d), lost, JOBS_NOW)
        if part == "updates":
            return out.updates
        if part == "executions":
            return out.executions.select("execution_id", "state", "error")
        return out.events.select("event_type", "job_id", "worker_id", "attempt", "payload")

    return run


def next_runs(s: SparkSession, d: str) -> DataFrame:
    seconds = F.pmod(F.substring("job_id", 2, 20).cast("bigint") * 7919, F.lit(86400))
    rows = td.jobs(s, d).withColumn("from_time", F.timestamp_seconds(F.unix_seconds("created_at") + seconds))
    return with_next_run(rows).select(
        "job_id", F.col("schedule.type").alias("schedule_type"), "from_time", "next_run_at", "schedule_error"
    )


def children(s: SparkSession, d: str) -> DataFrame:
    jobs = td.jobs(s, d)
    out = lc.recurring_children(jobs.filter("state = 'COMPLETED'"), jobs, JOBS_NOW)
    return out.updates.select("parent_job_id", "name", "state", "attempt", "idempotency_key", "scheduled_at")


def child_events(s: SparkSession, d: str) -> DataFrame:
    jobs = td.jobs(s, d)
    out = lc.recurring_children(jobs.filter("state = 'COMPLETED'"), jobs, JOBS_NOW)
    return out.events.select(
        "event_type",
        F.get_json_object("payload", "$.parent_job_id").alias("parent_job_id"),
        F.get_json_object("payload", "$.scheduled_at").alias("scheduled_at"),
    )


def cancelled(part: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        outcome = lc.cancel_jobs(td.deliveries(s, d), td.jobs(s, d), JOBS_NOW)
        if part == "outcomes":
            return outcome.select("job_id", "status", "completed_at")
        return lc.cancel_decision(outcome).events.select("event_type", "job_id", "execution_id", "worker_id")

    return run


def confirmed(s: SparkSession, d: str) -> DataFrame:
    return lc.confirm_unassigned(td.jobs(s, d), JOBS_NOW).updates


def dispatch(s: SparkSession, d: str) -> DataFrame:
    queue = td.jobs(s, d).select("job_id", "type", "priority", F.col("created_at").alias("enqueued_at"))
    return lc.dispatch_order(queue, "type")


def assigned(s: SparkSession, d: str) -> DataFrame:
    pairs = td.jobs(s, d).filter("state = 'QUEUED' AND worker_id != ''").select("job_id", "worker_id", "attempt")
    return lc.assign(pairs, JOBS_NOW).events.select("event_type", "job_id", "worker_id", "attempt", "seq")


def registered(part: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        workers = td.workers(s, d)
        known = workers.filter("status = 'HEALTHY'")
        asking = workers.withColumn("registered_at", F.lit(None).cast("timestamp"))
        rows, events = lc.register_workers(known, asking, WORKERS_NOW)
        if part == "rows":
            return rows.select("worker_id", "status", "last_heartbeat", "registered_at")
        gone = lc.deregister_workers(workers.filter("active_jobs = 0"))
        return events.unionByName(gone).select("event_type", "worker_id", "payload")

    return run


QUERIES: dict[str, Query] = {
    # sources
    "src2_decode_events": decoded_events,
    "src3_reject_counts": reject_counts,
    "src3_rejects": rejects,
    "src4_replay": replayed,
    "src5_unpublished": unpublished,
    "src6_stored_jobs": stored_jobs,
    "src7_work_messages": work_messages,
    # sinks
    "snk1_normalised": normalised,
    "snk4_routes": routed,
    "snk5_published": published,
    "snk5_written_published": written_published,
    "ru1_exact_jobs": exact_jobs,
    "aq2a_latency_from_bins": latency_from_bins,
    "snk6_emitted": emitted,
    "snk7_replay_lines": replay_lines,
    # log
    "ded1_final_events": lambda s, d: final_events(td.events(s, d)),
    "view1_final_view": final_view,
    "cnt1_events": _over_log(count_events),
    "cnt2_completed": _over_log(count_events, "JOB_COMPLETED"),
    "ttl1_events": retained,
    "ttl1_expired_days": expired,
    "ttl2_minute_stats": retained_rollup("job_minute_stats", "minute", datetime(2024, 4, 10, 12, tzinfo=UTC)),
    "ttl2_failure_minutes": retained_rollup("failure_minute_stats", "minute", datetime(2024, 4, 10, 12, tzinfo=UTC)),
    "ttl3_hourly_stats": retained_rollup("job_hourly_stats", "hour", datetime(2025, 1, 10, 12, tzinfo=UTC)),
    "ttl4_daily_stats": retained_rollup("job_daily_stats", "day", datetime(2030, 1, 1, tzinfo=UTC)),
    "lay1_partitions": partitions,
    # rollups
    "ru1_job_minute_stats": _minutes,
    "ru1_with_copies": lambda s, d: _minutes(s, d, dedupe=False),
    "ru2_worker_minute_stats": lambda s, d: ru.worker_minute_stats(ru.rollup_input(td.events(s, d))),
    "ru3_failure_minute_stats": _over_minutes(ru.failure_minute_stats),
    "ru4_job_hourly_stats": _over_minutes(ru.job_hourly_stats),
    "ru5_job_daily_stats": _over_minutes(ru.job_daily_stats),
    "ru6_minute_sketches": minute_sketches,
    "ru6_merged_sketches": merged_sketches,
    "ru8_merged_parts": merged_parts,
    # analytics
    "aq1a_throughput_minutes": _over_log(aq.throughput_points, WHOLE),
    "aq1a_throughput_hours": _over_log(aq.throughput_points, WHOLE, "hour"),
    "aq1b_throughput_totals": _over_log(aq.throughput_totals, WHOLE),
    "aq1a_throughput_inside": _inside(aq.throughput_points),
    "aq2a_latency_inside": _inside(aq.latency_summary),
    "aq2a_latency_summary": _over_log(aq.latency_summary, WHOLE),
    "aq2a_latency_approx": approximate_latency,
    "aq2b_latency_series": _over_log(aq.latency_series, WHOLE),
    "aq3a_outcome_counts": _over_log(aq.outcome_counts, WHOLE),
    "aq3b_outcome_rates": _over_log(aq.outcome_rates, WHOLE),
    "aq3c_failure_series": _over_log(aq.failure_series, WHOLE),
    "aq3d_retry_rates": _over_log(aq.retry_rates, WHOLE),
    "aq4_workers": _over_log(aq.worker_stats, WHOLE),
    "aq5a_queue_wait": _over_log(aq.queue_wait, WHOLE),
    "aq5a_queue_pairs": _over_log(aq.queue_waits, WHOLE),
    "aq5b_queue_depth": _over_log(aq.queue_depth, WHOLE),
    "aq6a_completed_per_minute": _over_log(aq.completed_per_minute, WHOLE),
    "aq6b_active_workers": _over_log(aq.active_workers, WHOLE),
    "aq6c_capacity": _over_log(aq.capacity, WHOLE, 0.5),
    "aq7a_snapshots": _over_log(aq.snapshots, {"current": CURRENT, "baseline": BASELINE}),
    "aq7b_anomalies": _over_log(
        aq.anomalies,
        TimeRange(datetime(2024, 1, 30, tzinfo=UTC), datetime(2024, 2, 28, tzinfo=UTC)),
        TimeRange(datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 1, 30, tzinfo=UTC)),
    ),
    "aq8_scheduler": _over_log(aq.scheduler_events, WHOLE),
    # the same answers from the minute rollup
    "aq1a_from_rollup": _over_minutes(ru.throughput_points, WHOLE),
    "aq1b_from_rollup": _over_minutes(ru.throughput_totals, WHOLE),
    "aq3a_from_rollup": _over_minutes(ru.outcome_counts, WHOLE),
    "aq3b_from_rollup": _over_minutes(ru.outcome_rates, WHOLE),
    "aq3c_from_rollup": _over_minutes(ru.failure_series, WHOLE),
    "aq6a_from_rollup": _over_minutes(ru.completed_per_minute, WHOLE),
    # dashboard
    "db1_completed_per_minute": _over_log(db.completed_per_minute),
    "db2_failures_per_minute": _over_log(db.failures_per_minute),
    "db3_p95_per_minute": _over_log(db.p95_per_minute),
    "db4_events_by_type": _over_log(db.events_by_type),
    "db5_completed_by_worker": _over_log(db.completed_by_worker),
    # operational tables
    "store1_jobs_by_id": lambda s, d: jb.jobs_by_id(td.jobs(s, d), td.deliveries(s, d)).select("job_id", "state"),
    "store2_jobs_by_key": lambda s, d: jb.jobs_by_key(td.jobs(s, d), td.requests(s, d)).select(
        "job_id", "idempotency_key"
    ),
    "store3_list_jobs": lambda s, d: jb.list_jobs(td.jobs(s, d), "RUNNING").select("job_id", "state", "created_at"),
    "store4_due_jobs": lambda s, d: jb.due_jobs(td.jobs(s, d), JOBS_NOW).select(
        "job_id", "state", "priority", "scheduled_at"
    ),
    "store5_cancel_requested": lambda s, d: jb.cancel_requested(td.jobs(s, d)).select("job_id", "updated_at"),
    "store6_timed_out": lambda s, d: jb.timed_out(td.jobs(s, d), JOBS_NOW).select(
        "job_id", "state", "started_at", "timeout_ms"
    ),
    "store7_healthy_workers": lambda s, d: jb.healthy_workers(td.workers(s, d)).select("worker_id", "active_jobs"),
    "store8_workers": lambda s, d: jb.list_workers(td.workers(s, d)).select("worker_id", "status", "registered_at"),
    "store9_stale_workers": lambda s, d: jb.stale_workers(td.workers(s, d), WORKERS_NOW),
    "store10_new_jobs": idempotent_insert(0),
    "store10_request_jobs": idempotent_insert(1),
    "store11_transitions": transitions,
    "store11_written_transitions": written_transitions,
    "store12_new_executions": created_executions,
    "store12_finished_executions": finished_executions,
    "store13_upserted_workers": upserted_workers,
    "store13_written_workers": written_workers,
    # lifecycle
    "lc1_validated_requests": validated,
    "lc2_planned_requests": planned,
    "lc2_request_events": planned_events,
    "lc3_promoted_events": promoted("events"),
    "lc3_promoted_messages": promoted("messages"),
    "lc3_promoted_jobs": promoted_table,
    "lc4_gated_messages": lambda s, d: lc.gate_messages(td.deliveries(s, d), td.jobs(s, d)),
    "lc5_decided_results": decided,
    "lc5_job_updates": decided_updates,
    "lc5_events": decided_events,
    "lc6_backoff": delays,
    "lc7_timeout_results": timeout_outcomes,
    "lc8_recovered_jobs": recovered("updates"),
    "lc8_recovered_executions": recovered("executions"),
    "lc8_recovery_events": recovered("events"),
    "lc9_next_runs": next_runs,
    "lc10_recurring_children": children,
    "lc10_child_events": child_events,
    "lc11_cancel_outcomes": cancelled("outcomes"),
    "lc11_cancel_events": cancelled("events"),
    "lc12_confirmed_cancels": confirmed,
    "lc13_dispatch_order": dispatch,
    "lc14_worker_capacity": lambda s, d: lc.worker_capacity(td.workers(s, d)),
    "lc14_pick_worker": lambda s, d: lc.pick_worker(td.workers(s, d)),
    "lc15_heartbeats": lambda s, d: lc.fold_heartbeats(td.workers(s, d), td.heartbeats(s, d)).select(
        "worker_id", "status", "active_jobs", "capacity", "last_heartbeat"
    ),
    "lc16_http_outcomes": lambda s, d: lc.http_outcomes(td.executions(s, d)),
    "lc17_states_from_log": _over_log(lc.states_from_log),
    "lc18_assignment_events": assigned,
    "lc19_registered_workers": registered("rows"),
    "lc19_worker_events": registered("events"),
    "lc20_precheck": lambda s, d: lc.precheck_payloads(td.jobs(s, d)),
    # streams, run to the end of what is there
    **st.QUERIES,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throughput per hour over the deduplicated log."""
    return aq.throughput_points(td.events(spark, sf_dir), WHOLE, "hour")


