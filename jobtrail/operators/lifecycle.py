"""Job-lifecycle decisions as set-based transforms.

Each takes tables and gives rows: job transitions (for ``jobs.apply_transitions``), execution rows
and emitted events (for ``sinks.outbox.to_events``). ``now`` is always a parameter, so a decision
can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.functions.scalar import settle
from jobtrail.operators.jobs import DEFAULT_PRIORITY, due_jobs, timed_out
from jobtrail.operators.ranking import rank_rows
from jobtrail.operators.schedules import with_next_run
from jobtrail.operators.timerange import instant
from jobtrail.schema import BUILTIN_HANDLERS, JOB_TYPES, TERMINAL_JOB_STATES
from jobtrail.sinks.outbox import rfc3339

# The retry policy and time limit of a request that names none.
DEFAULT_RETRY = {
    "max_attempts": ("int", 3),
    "backoff_strategy": ("string", "exponential"),
    "initial_delay": ("bigint", 1_000_000_000),
    "max_delay": ("bigint", 300_000_000_000),
    "multiplier": ("double", 2.0),
    "jitter": ("boolean", True),
}
DEFAULT_TIMEOUT_SECONDS = 30


@dataclass(frozen=True)
class Decision:
    """Rows a decision gives: job transitions and emitted events, others where they apply."""

    updates: DataFrame
    events: DataFrame
    executions: DataFrame | None = None
    messages: DataFrame | None = None


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _event(kind: Column | str, seq: int = 0, payload: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(
        kind.alias("event_type"),
        F.lit(seq).alias("seq"),
        (F.lit("{}") if payload is None else payload).alias("payload"),
    )


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


# --- requests ---------------------------------------------------------------------------------


def _default_retry() -> Column:
    return F.struct(*[F.lit(v).cast(t).alias(n) for n, (t, v) in DEFAULT_RETRY.items()])


def validate_requests(requests: DataFrame, now: datetime) -> DataFrame:
    """Requests with defaults filled in, ``next_run_at`` and ``error``: the first rule broken, or
    NULL."""
    kind = F.coalesce("type", F.lit(""))
    sched = F.col("schedule")
    sched_type = F.coalesce(sched["type"], F.lit(""))
    filled = requests.withColumns(
        {
            "type": F.when(kind == "", "builtin").otherwise(kind),
            "priority": F.when(F.coalesce("priority", F.lit(0)) == 0, DEFAULT_PRIORITY).otherwise(F.col("priority")),
            "schedule": F.struct(
                F.when(sched_type == "", "immediate").otherwise(sched_type).alias("type"),
                sched["run_at"].alias("run_at"),
                F.coalesce(sched["delay"], F.lit(0).cast("bigint")).alias("delay"),
                F.coalesce(sched["cron_expr"], F.lit("")).alias("cron_expr"),
                F.coalesce(sched["timezone"], F.lit("")).alias("timezone"),
            ),
            "retry_policy": F.coalesce("retry_policy", _default_retry()),
            "timeout_ms": F.when(F.col("timeout_seconds") > 0, F.col("timeout_seconds"))
            .otherwise(F.lit(DEFAULT_TIMEOUT_SECONDS))
            .cast("bigint")
            * 1000,
            "payload": F.coalesce("payload", F.lit("{}")),
            "_now": instant(now),
        }
    )
    timed = with_next_run(filled, "schedule", "_now", "next_run_at", "_schedule_error").drop("_now")
    error = (
        F.when(F.coalesce("name", F.lit("")) == "", "name required")
        .when(~F.col("type").isin(JOB_TYPES), "type must be builtin or webhook")
        .when(~F.col("priority").between(1, 10), "priority must be 1-10")
        .otherwise(F.col("_schedule_error"))
    )
    return timed.withColumn("error", error).drop("_schedule_error", "timeout_seconds")


def rejected_requests(validated: DataFrame) -> DataFrame:
    return validated.filter("error IS NOT NULL").select("request_id", "error")


def plan_requests(validated: DataFrame, now: datetime) -> DataFrame:
    """Valid requests as job rows with their first run; due ones are queued at once.

    A delay may be negative here. A schedule that never fires is due at once, as an unset time is.
    """
    at = instant(now)
    sched = F.col("schedule")
    delayed = F.timestamp_micros(F.unix_micros(at) + F.floor(sched["delay"] / 1000))
    first = F.when(sched["type"] == "delayed", delayed).otherwise(F.col("next_run_at"))
    due = F.coalesce(F.col("scheduled_at") <= at, F.lit(True))
    digest = F.regexp_replace(
        F.md5(F.concat_ws("|", F.lit("job"), "request_id", F.unix_micros(at))),
        r"^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "$1-$2-$3-$4-$5",
    )
    return (
        validated.filter("error IS NULL")
        .withColumn("scheduled_at", first)
        .select(
            "request_id",
            digest.alias("job_id"),
            "name",
            "type",
            "payload",
            "priority",
            F.when(due, "QUEUED").otherwise("SCHEDULED").alias("state"),
            "schedule",
            "retry_policy",
            "timeout_ms",
            F.coalesce("idempotency_key", F.lit("")).alias("idempotency_key"),
            F.lit(0).alias("attempt"),
            F.col("retry_policy.max_attempts").alias("max_attempts"),
            F.lit("").alias("worker_id"),
            F.lit("").alias("execution_id"),
            F.lit("").alias("last_error"),
            "scheduled_at",
            F.when(due, at).alias("queued_at"),
            _null("timestamp").alias("started_at"),
            _null("timestamp").alias("completed_at"),
            _null("timestamp").alias("next_retry_at"),
            at.alias("created_at"),
            at.alias("updated_at"),
            "metadata",
        )
    )


def request_events(planned: DataFrame) -> DataFrame:
    """CREATED and SCHEDULED of new jobs, and QUEUED of those due at once."""
    created = _event("JOB_CREATED", 0, _json(name=F.col("name"), type=F.col("type"), priority=F.col("priority")))
    scheduled = _event("JOB_SCHEDULED", 1, _json(scheduled_at=rfc3339(F.col("scheduled_at"))))
    queued = F.when(F.col("state") == "QUEUED", _event("JOB_QUEUED", 2))
    return _explode_events(planned.withColumn("_events", F.array(created, scheduled, queued)))


def _explode_events(rows: DataFrame) -> DataFrame:
    """One row per emitted event of ``_events`` (NULL entries are none)."""
    has = set(rows.columns)
    ids = [F.col(c) if c in has else F.lit("").alias(c) for c in ("job_id", "execution_id", "worker_id")]
    attempt = F.col("attempt").cast("int").alias("attempt") if "attempt" in has else F.lit(0).alias("attempt")
    return rows.select(*ids, attempt, F.explode(F.array_compact("_events")).alias("_e")).select(
        F.col("_e.event_type"), "job_id", "execution_id", "worker_id", "attempt", F.col("_e.seq"), F.col("_e.payload")
    )


def queue_messages(jobs: DataFrame, now: datetime) -> DataFrame:
    """Work messages for jobs that enter the queue."""
    return jobs.select(
        "job_id", "name", "type", "payload", "priority", "attempt", "timeout_ms", instant(now).alias("enqueued_at")
    )


# --- queueing ---------------------------------------------------------------------------------


def promote_due(jobs: DataFrame, now: datetime, limit: int | None = None) -> Decision:
    """Due jobs enter the queue."""
    due = due_jobs(jobs, now, limit)
    updates = due.select(
        "job_id",
        F.lit("QUEUED").alias("new_state"),
        F.array(F.lit("SCHEDULED"), F.lit("RETRYING")).alias("only_from"),
        instant(now).alias("queued_at"),
    )
    events = due.select("job_id", "attempt", F.array(_event("JOB_QUEUED")).alias("_events"))
    return Decision(updates, _explode_events(events), messages=queue_messages(due, now))


def gate_messages(messages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each message with its ``route``: only jobs still waiting proceed."""
    state = F.col("_state")
    route = (
        F.when(state.isNull(), "not_found")
        .when(state.isin("QUEUED", "SCHEDULED", "RETRYING"), "proceed")
        .when(state.isin("CANCEL_REQUESTED", "CANCELLED"), "skip_cancelled")
        .otherwise("skip_not_queueable")
    )
    states = jobs.select("job_id", F.col("state").alias("_state"))
    return messages.join(states, "job_id", "left").withColumn("route", route).drop("_state")


def dispatch_order(messages: DataFrame, queue: str | None = None, tie: str = "job_id") -> DataFrame:
    """Messages with their place in the queue: priority first, then time of entry.

    ``queue`` names a column that tells queues apart; without it there is one queue.
    """
    order = [F.desc("priority"), F.asc("enqueued_at"), F.asc(tie)]
    if queue:
        return rank_rows(messages, [queue], order, "position")
    return rank_rows(messages.withColumn("_queue", F.lit(0)), ["_queue"], order, "position").drop("_queue")


def assign(pairs: DataFrame, now: datetime) -> Decision:
    """Effects of giving messages to workers.

    ``pairs`` has job_id, worker_id and attempt (of the message). The job runs its next attempt.
    """
    at = instant(now)
    digest = F.md5(F.concat_ws("|", F.lit("execution"), "job_id", "worker_id", "attempt", F.unix_micros(at)))
    rows = pairs.select(
        "job_id",
        "worker_id",
        (F.col("attempt") + 1).cast("int").alias("attempt"),
        F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5").alias("execution_id"),
    )
    updates = rows.select(
        "job_id",
        F.lit("RUNNING").alias("new_state"),
        "worker_id",
        "execution_id",
        "attempt",
        at.alias("started_at"),
    )
    events = rows.withColumn("_events", F.array(_event("JOB_ASSIGNED", 0), _event("JOB_STARTED", 1)))
    return Decision(updates, _explode_events(events), executions=rows)


# --- retries ----------------------------------------------------------------------------------


def backoff_nanos(policy: Column, attempt: Column) -> Column:
    """Delay before the next attempt, without jitter."""
    first = F.when(policy["initial_delay"] > 0, policy["initial_delay"]).otherwise(F.lit(1_000_000_000))
    factor = F.when(policy["multiplier"] >= 1, policy["multiplier"]).otherwise(F.lit(2.0))
    grown = first.cast("double") * F.pow(factor, (attempt - 1).cast("double"))
    # Beyond the range of bigint the delay stays at its largest value.
    grown = F.least(grown, F.lit(9.2e18)).cast("bigint")
    delay = F.when(policy["backoff_strategy"] == "exponential", grown).otherwise(first)
    cap = policy["max_delay"]
    return F.when((cap > 0) & (delay > cap), cap).otherwise(delay).cast("bigint")


def jitter_factor(seed: int, *identity: str) -> Column:
    """A factor in [0.5, 1.5) drawn from the row's identity, so a retried task draws it again."""
    steps = 1 << 30
    return F.lit(0.5) + F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(steps)) / F.lit(float(steps))


def backoff(df: DataFrame, policy: str = "retry_policy", attempt: str = "attempt") -> DataFrame:
    """Add delay_ms and the range a jittered delay falls into."""
    nanos = backoff_nanos(F.col(policy), F.col(attempt))
    jittered = F.col(f"{policy}.jitter")
    ms = lambda c: F.floor(c / 1_000_000).cast("bigint")
    low = F.when(jittered, (F.col("_d").cast("double") * 0.5).cast("bigint")).otherwise(F.col("_d"))
    high = F.when(jittered, (F.col("_d").cast("double") * 1.5).cast("bigint")).otherwise(F.col("_d"))
    return (
        df.withColumn("_d", nanos)
        .withColumns({"delay_ms": ms(F.col("_d")), "delay_min_ms": ms(low), "delay_max_ms": ms(high)})
        .drop("_d")
    )


# --- results ----------------------------------------------------------------------------------

RETRYING_ACTIONS = ["timeout_retry", "failure_retry"]
ENDING_ACTIONS = ["cancelled", "completed", "timeout", "failure"]


def decide_results(
    results: DataFrame,
    jobs: DataFrame,
    now: datetime,
    order: Sequence[str] = ("attempt", "execution_id"),
    jitter_seed: int | None = None,
) -> DataFrame:
    """What each reported result does to its job.

    Adds ``action`` (unknown_job, ignored, cancelled, completed, timeout_retry, timeout,
    failure_retry, failure), the new ``job_state`` and ``execution_state``, ``delay_ms`` and
    ``next_retry_at``. Several results of a job are taken in ``order``; after one that ends the
    job the rest are ignored. Delivery is at least once: copies of a result (same job and order) are
    reduced to one row first, on the map side. Persist the rows where updates, events and executions
    are all made from them.
    """
    rest = [c for c in results.columns if c != "job_id" and c not in order]
    results = (
        results.groupBy("job_id", *order)
        .agg(F.min(F.struct(*rest)).alias("_row"))
        .select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in results.columns])
    )
    reason = F.coalesce(F.nullif("reason", F.lit("")), F.when(F.col("success"), "success").otherwise("failed"))
    known = jobs.select(
        "job_id",
        F.col("state").alias("_state"),
        F.col("max_attempts").alias("_max"),
        F.col("retry_policy").alias("_policy"),
    )
    rows = results.withColumn("reason", reason).join(known, "job_id", "left")
    again = F.col("attempt") < F.col("_max")
    action = (
        F.when(F.col("_state").isNull(), "unknown_job")
        .when(F.col("_state").isin(TERMINAL_JOB_STATES), "ignored")
        .when((F.col("reason") == "cancelled") | (F.col("_state") == "CANCEL_REQUESTED"), "cancelled")
        .when(F.col("success"), "completed")
        .when(F.col("reason") == "timeout", F.when(again, "timeout_retry").otherwise("timeout"))
        .when(F.col("retryable") & again, "failure_retry")
        .otherwise("failure")
    )
    rows = rows.withColumn("action", action)

    # A known job has at most as many results as attempts; results of unknown jobs may share one id and are spread.
    place, unknown = F.struct(*order), F.col("action") == "unknown_job"
    of_job = Window.partitionBy("job_id", F.when(unknown, F.xxhash64(*order)))
    end = F.min(F.when(F.col("action").isin(ENDING_ACTIONS), place)).over(of_job)
    late = F.col("_end").isNotNull() & (place > F.col("_end")) & ~unknown
    rows = rows.withColumn("_end", end).withColumn("action", F.when(late, "ignored").otherwise(F.col("action")))

    retry = F.col("action").isin(RETRYING_ACTIONS)
    nanos = F.when(retry, backoff_nanos(F.col("_policy"), F.col("attempt")))
    if jitter_seed is not None:
        shaken = (nanos.cast("double") * jitter_factor(jitter_seed, "job_id", "attempt")).cast("bigint")
        nanos = F.when(F.col("_policy.jitter"), shaken).otherwise(nanos)
    states = {
        "cancelled": ("CANCELLED", "CANCELLED"),
        "completed": ("COMPLETED", "COMPLETED"),
        "timeout_retry": ("RETRYING", "TIMEOUT"),
        "timeout": ("TIMEOUT", "TIMEOUT"),
        "failure_retry": ("RETRYING", "FAILED"),
        "failure": ("FAILED", "FAILED"),
    }
    job_state, execution_state = _null("string"), _null("string")
    for name, (job, execution) in states.items():
        job_state = F.when(F.col("action") == name, job).otherwise(job_state)
        execution_state = F.when(F.col("action") == name, execution).otherwise(execution_state)
    return (
        rows.withColumn("_nanos", nanos)
        .withColumns(
            {
                "job_state": job_state,
                "execution_state": execution_state,
                "delay_ms": F.floor(F.col("_nanos") / 1_000_000).cast("bigint"),
                "next_retry_at": F.timestamp_micros(
                    F.unix_micros(instant(now)) + F.floor(F.col("_nanos") / 1000).cast("bigint")
                ),
            }
        )
        .drop("_state", "_max", "_policy", "_end", "_nanos")
    )


def effective(decided: DataFrame) -> DataFrame:
    return decided.filter(F.col("job_state").isNotNull())


def result_updates(
    decided: DataFrame, now: datetime, order: Sequence[str] = ("attempt", "execution_id")
) -> DataFrame:
    """One transition per job: the effects of its results, later ones over earlier ones."""
    rows = effective(decided)
    retry = F.col("action").isin(RETRYING_ACTIONS)
    text = F.when(F.col("action").isin("timeout", "timeout_retry"), F.lit("timeout")).when(
        F.col("action") != "completed", F.coalesce("error", F.lit(""))
    )
    place = F.struct(*order)
    last = lambda value, cond: F.max_by(value, F.when(cond, place))
    return rows.groupBy("job_id").agg(
        F.max_by("job_state", place).alias("new_state"),
        last(text, F.col("action") != "completed").alias("last_error"),
        F.max(F.when(retry, F.lit(""))).alias("worker_id"),
        F.max(F.when(retry, F.lit(""))).alias("execution_id"),
        last(F.col("next_retry_at"), retry).alias("next_retry_at"),
        F.max(F.when(~retry, instant(now))).alias("completed_at"),
    )


def result_executions(decided: DataFrame) -> DataFrame:
    """Executions that end, for ``jobs.finish_executions``."""
    return effective(decided).filter("execution_id != ''").select(
        "execution_id", F.col("execution_state").alias("state"), "duration_ms", "error", "output", "retryable"
    )


def result_events(decided: DataFrame) -> DataFrame:
    """Events of the results: the outcome, then a retry where one is due."""
    a = F.col("action")
    err = F.coalesce("error", F.lit(""))
    next_at = rfc3339(F.col("next_retry_at"))
    outcome = (
        F.when(a == "cancelled", _event("JOB_CANCELLED", 0, _json(reason=F.col("reason"))))
        .when(a == "completed", _event("JOB_COMPLETED", 0, _json(duration_ms=F.coalesce("duration_ms", F.lit(0)))))
        .when(a.startswith("timeout"), _event("JOB_TIMEOUT", 0, _json(error=err)))
        .otherwise(
            _event("JOB_FAILED", 0, _json(error=err, retryable=F.coalesce("retryable", F.lit(False))))
        )
    )
    again = F.when(
        a == "timeout_retry", _event("JOB_RETRY_SCHEDULED", 1, _json(next_retry_at=next_at, reason=F.lit("timeout")))
    ).when(
        a == "failure_retry",
        _event("JOB_RETRY_SCHEDULED", 1, _json(next_retry_at=next_at, delay_ms=F.col("delay_ms"))),
    )
    return _explode_events(effective(decided).withColumn("_events", F.array(outcome, again)))


def resolve_results(
    results: DataFrame,
    jobs: DataFrame,
    now: datetime,
    order: Sequence[str] = ("attempt", "execution_id"),
    jitter_seed: int | None = None,
) -> Decision:
    """Transitions, finished executions and events of a batch of results."""
    decided = decide_results(results, jobs, now, order, jitter_seed)
    return Decision(
        result_updates(decided, now, order), result_events(decided), executions=result_executions(decided)
    )


def timeouts_as_results(
    jobs: DataFrame, now: datetime, limit: int | None = None, zero_timeout_default_ms: int | None = None
) -> DataFrame:
    """Jobs past their limit as retryable timeout results."""
    return timed_out(jobs, now, limit, zero_timeout_default_ms).select(
        "job_id",
        "execution_id",
        "worker_id",
        "attempt",
        F.lit(False).alias("success"),
        _null("string").alias("output"),
        F.lit("timeout").alias("error"),
        F.lit(True).alias("retryable"),
        F.col("timeout_ms").alias("duration_ms"),
        F.lit("timeout").alias("reason"),
    )


def recurring_children(completed: DataFrame, jobs: DataFrame, now: datetime) -> Decision:
    """The next occurrence of recurring jobs that completed. ``completed`` has job_id."""
    at = instant(now)
    done = completed.select("job_id").distinct()
    parents = jobs.filter(F.col("schedule.type") == "recurring").join(done, "job_id", "left_semi")
    timed = with_next_run(parents.withColumn("_now", at), "schedule", "_now", "_next", "_error").filter(
        "_error IS NULL AND _next IS NOT NULL"
    )
    digest = F.md5(F.concat_ws("|", F.lit("child"), "job_id", F.unix_micros("_next")))
    child_id = F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    fresh = {
        "job_id": child_id,
        "state": F.lit("SCHEDULED"),
        "idempotency_key": F.lit(""),
        "attempt": F.lit(0),
        "worker_id": F.lit(""),
        "execution_id": F.lit(""),
        "last_error": F.lit(""),
        "scheduled_at": F.col("_next"),
        "created_at": at,
        "updated_at": at,
    } | {c: _null("timestamp") for c in ("queued_at", "started_at", "completed_at", "next_retry_at")}
    children = timed.select(
        F.col("job_id").alias("parent_job_id"),
        *[fresh[c].alias(c) if c in fresh else F.col(c) for c in jobs.columns],
    )
    note = _json(
        parent_job_id=F.col("parent_job_id"), scheduled_at=rfc3339(F.col("scheduled_at")), recurring=F.lit(True)
    )
    events = children.select("job_id", "attempt", F.array(_event("JOB_SCHEDULED", 0, note)).alias("_events"))
    return Decision(children, _explode_events(events))


# --- losing workers ---------------------------------------------------------------------------


def recover_jobs(jobs: DataFrame, lost: DataFrame, now: datetime) -> Decision:
    """Jobs of lost workers: cancelled where that was asked for, else retried or failed.

    ``lost`` has worker_id.
    """
    at = instant(now)
    active = ["RUNNING", "ASSIGNED", "CANCEL_REQUESTED"]
    rows = jobs.filter(F.col("state").isin(active))
    held = rows.filter("worker_id != ''")  # jobs no worker holds share one key and are not lost
    rows = held.join(lost.select("worker_id").distinct(), "worker_id", "left_semi")
    new_state = (
        F.when(F.col("state") == "CANCEL_REQUESTED", "CANCELLED")
        .when(F.col("attempt") < F.col("max_attempts"), "RETRYING")
        .otherwise("FAILED")
    )
    rows = rows.withColumn("new_state", new_state)
    s = F.col("new_state")
    retry = s == "RETRYING"
    updates = rows.select(
        "job_id",
        "new_state",
        F.when(s == "CANCELLED", "worker lost during cancel")
        .when(retry, "worker lost")
        .otherwise("worker lost, max attempts exceeded")
        .alias("last_error"),
        F.when(retry, F.lit("")).alias("worker_id"),
        F.when(retry, F.lit("")).alias("execution_id"),
        F.when(retry, at).alias("next_retry_at"),
        F.when(~retry, at).alias("completed_at"),
    )
    kind = F.when(s == "CANCELLED", "JOB_CANCELLED").when(retry, "JOB_RETRY_SCHEDULED").otherwise("JOB_FAILED")
    events = rows.withColumn("_events", F.array(_event(kind, 0, _json(reason=F.lit("worker_lost")))))
    executions = rows.filter("execution_id != ''").select(
        "execution_id",
        F.lit("FAILED").alias("state"),
        F.lit(0).cast("bigint").alias("duration_ms"),
        F.lit("worker lost").alias("error"),
        _null("string").alias("output"),
        F.lit(False).alias("retryable"),
    )
    return Decision(updates, _explode_events(events), executions=executions)


def unavailable_events(stale: DataFrame) -> DataFrame:
    """Events for workers that became unavailable (rows of ``jobs.stale_workers``)."""
    rows = stale.filter("new_status = 'UNAVAILABLE'")
    return _explode_events(rows.select("worker_id", F.array(_event("WORKER_UNAVAILABLE")).alias("_events")))


# --- cancelling -------------------------------------------------------------------------------


def cancel_jobs(requests: DataFrame, jobs: DataFrame, now: datetime) -> DataFrame:
    """Outcome per cancelled job id: ``status`` not_found, conflict, CANCEL_REQUESTED or CANCELLED."""
    asked = requests.select("job_id").distinct()
    known = jobs.select("job_id", "state", "execution_id", "worker_id", "attempt")
    status = (
        F.when(F.col("state").isNull(), "not_found")
        .when(F.col("state").isin("COMPLETED", "CANCELLED", "EXPIRED"), "conflict")
        .when(F.col("state").isin("RUNNING", "ASSIGNED"), "CANCEL_REQUESTED")
        .otherwise("CANCELLED")
    )
    return (
        asked.join(known, "job_id", "left")
        .withColumn("status", status)
        .withColumn("completed_at", F.when(F.col("status") == "CANCELLED", instant(now)))
    )


def cancel_decision(outcomes: DataFrame) -> Decision:
    """Transitions and events of :func:`cancel_jobs`."""
    rows = outcomes.filter(F.col("status").isin("CANCEL_REQUESTED", "CANCELLED"))
    updates = rows.select("job_id", F.col("status").alias("new_state"), "completed_at")
    running = F.col("status") == "CANCEL_REQUESTED"
    kind = F.when(running, "JOB_CANCEL_REQUESTED").otherwise("JOB_CANCELLED")
    events = rows.select(
        "job_id",
        F.when(running, F.col("execution_id")).otherwise("").alias("execution_id"),
        F.when(running, F.col("worker_id")).otherwise("").alias("worker_id"),
        "attempt",
        F.array(_event(kind)).alias("_events"),
    )
    return Decision(updates, _explode_events(events))


def confirm_unassigned(jobs: DataFrame, now: datetime) -> Decision:
    """Cancel requests for jobs no worker holds are confirmed."""
    rows = jobs.filter("state = 'CANCEL_REQUESTED' AND worker_id = ''")
    updates = rows.select("job_id", F.lit("CANCELLED").alias("new_state"), instant(now).alias("completed_at"))
    events = rows.select("job_id", "execution_id", "attempt", F.array(_event("JOB_CANCELLED")).alias("_events"))
    return Decision(updates, _explode_events(events))


# --- workers ----------------------------------------------------------------------------------


def worker_capacity(workers: DataFrame) -> DataFrame:
    """Free slots per worker and whether it takes work."""
    slots = F.greatest(F.lit(0), F.col("capacity") - F.col("active_jobs"))
    return workers.select(
        "worker_id",
        "status",
        "active_jobs",
        slots.alias("slots"),
        ((F.col("status") == "HEALTHY") & (slots > 0)).alias("assignable"),
    )


def pick_worker(workers: DataFrame) -> DataFrame:
    """The assignable worker with the fewest active jobs."""
    free = worker_capacity(workers).filter("assignable")
    return free.orderBy("active_jobs", "worker_id").limit(1).select("worker_id", "active_jobs", "slots")


def fold_heartbeats(workers: DataFrame, beats: DataFrame) -> DataFrame:
    """The worker table after heartbeats (worker_id, active, capacity, ts); unknown ones are ignored."""
    # Reduced on the map side: a worker may send very many.
    latest = beats.groupBy("worker_id").agg(F.max(F.struct("ts", "active", "capacity")).alias("_b"))
    rows = workers.join(latest, "worker_id", "left")
    hit = F.col("_b").isNotNull()
    new = {
        "active_jobs": F.col("_b.active").cast("int"),
        "capacity": F.col("_b.capacity").cast("int"),
        "last_heartbeat": F.col("_b.ts"),
        "status": F.lit("HEALTHY"),
    }
    return rows.select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in workers.columns]
    )


def register_workers(workers: DataFrame, registrations: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(worker rows to upsert, events). A first registration is dated now."""
    at = instant(now)
    old = workers.select("worker_id", F.col("registered_at").alias("_since"))
    rows = (
        registrations.join(old, "worker_id", "left")
        .withColumns(
            {
                "status": F.lit("HEALTHY"),
                "last_heartbeat": at,
                "registered_at": F.coalesce("_since", "registered_at", at),
            }
        )
        .drop("_since")
    )
    note = _json(address=F.col("address"), capacity=F.col("capacity"))
    events = rows.select("worker_id", F.array(_event("WORKER_REGISTERED", 0, note)).alias("_events"))
    return rows.select(*workers.columns), _explode_events(events)


def deregister_workers(ids: DataFrame) -> DataFrame:
    """Events of workers that sign off; their rows stay as they are."""
    return _explode_events(ids.select("worker_id", F.array(_event("WORKER_DEREGISTERED")).alias("_events")))


# --- outcomes and payloads --------------------------------------------------------------------


def http_outcomes(executions: DataFrame) -> DataFrame:
    """Webhook executions by the status code in their output."""
    code = F.get_json_object("output", "$.status_code").try_cast("int")
    ok = F.col("status_code").between(200, 299)
    retry = ~ok & ((F.col("status_code") >= 500) | (F.col("status_code") == 429))
    return (
        executions.withColumn("status_code", code)
        .filter("status_code IS NOT NULL")
        .select(
            "execution_id",
            "status_code",
            ok.alias("success"),
            retry.alias("retryable"),
            F.when(~ok, F.concat(F.lit("webhook status "), F.col("status_code"))).alias("error"),
        )
    )


def precheck_payloads(jobs: DataFrame) -> DataFrame:
    """Jobs with ``precheck_error``: why their payload cannot run, or NULL; and the HTTP method."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    text = F.when(F.ltrim("payload").startswith("{"), F.col("payload"))
    p = F.from_json(text, "handler string, url string, method string, _bad string", opts)
    rows = settle(jobs, {"_p": p})
    broken = F.col("_p").isNull() | F.col("_p._bad").isNotNull()
    handler, url = F.coalesce("_p.handler", F.lit("")), F.coalesce("_p.url", F.lit(""))
    builtin = F.when(broken, "invalid builtin payload").when(
        ~handler.isin(BUILTIN_HANDLERS), F.concat(F.lit('unknown builtin handler "'), handler, F.lit('"'))
    )
    webhook = (
        F.when(broken, "invalid webhook payload")
        .when(url == "", "webhook url required")
        .when(~(url.startswith("http://") | url.startswith("https://")), "webhook url must be http(s)")
    )
    error = (
        F.when(F.col("type") == "builtin", builtin)
        .when(F.col("type") == "webhook", webhook)
        .otherwise(F.concat(F.lit('unsupported job type "'), F.col("type"), F.lit('"')))
    )
    method = F.when(
        (F.col("type") == "webhook") & error.isNull(), F.coalesce(F.nullif("_p.method", F.lit("")), F.lit("POST"))
    )
    return rows.select("job_id", "type", error.alias("precheck_error"), method.alias("method"))


# --- state from the log -----------------------------------------------------------------------

# The state an event leads to, in the order events of one millisecond happen.
EVENT_STATE = [
    ("JOB_CREATED", "CREATED"),
    ("JOB_SCHEDULED", "SCHEDULED"),
    ("JOB_QUEUED", "QUEUED"),
    ("JOB_ASSIGNED", "ASSIGNED"),
    ("JOB_STARTED", "RUNNING"),
    ("JOB_CANCEL_REQUESTED", "CANCEL_REQUESTED"),
    ("JOB_FAILED", "FAILED"),
    ("JOB_TIMEOUT", "TIMEOUT"),
    ("JOB_RETRY_SCHEDULED", "RETRYING"),
    ("JOB_COMPLETED", "COMPLETED"),
    ("JOB_CANCELLED", "CANCELLED"),
    ("JOB_EXPIRED", "EXPIRED"),
]


def event_rank() -> Column:
    """Place of a job event in EVENT_STATE; NULL for other events."""
    rank = _null("bigint")
    for i, (event, _) in enumerate(EVENT_STATE):
        rank = F.when(F.col("event_type") == event, F.lit(i).cast("bigint")).otherwise(rank)
    return rank


def state_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(state) for _, state in EVENT_STATE]), (rank + 1).cast("int"))


def states_from_log(events: DataFrame) -> DataFrame:
    """Current state, attempts and times per job, folded from its events.

    Copies of an event change no minimum or maximum, so they need not be removed. Time and order
    are packed into one number, which keeps the fold in a hash aggregate.
    """
    packed = F.unix_millis("event_time") * 16 + event_rank()
    at = lambda kind: F.when(F.col("event_type") == kind, F.col("event_time"))
    return (
        events.filter("job_id != ''")
        .withColumn("_packed", packed)
        .filter("_packed IS NOT NULL")
        .groupBy("job_id")
        .agg(
            F.max("_packed").alias("_last"),
            F.max("attempt").alias("attempts"),
            F.min(at("JOB_CREATED")).alias("created_at"),
            F.max(at("JOB_QUEUED")).alias("queued_at"),
            F.max(at("JOB_STARTED")).alias("started_at"),
            F.max("event_time").alias("updated_at"),
        )
        .select(
            "job_id",
            state_of_rank(F.pmod("_last", F.lit(16))).alias("state"),
            "attempts",
            "created_at",
            "queued_at",
            "started_at",
            "updated_at",
        )
    )
