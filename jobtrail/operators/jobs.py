"""Queries and updates over the operational tables.

Updates give the new table (or the rows that change) instead of changing anything in place.
``now`` is always a parameter.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.operators.timerange import instant

# Fixed values.
LIST_LIMIT = 50
DEFAULT_PRIORITY = 5
DEFAULT_TIMEOUT_MS = 30_000
HEARTBEAT_TIMEOUT = timedelta(seconds=15)
SUSPECT_GRACE = timedelta(seconds=10)


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


# --- reads ------------------------------------------------------------------------------------


def job_by_id(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("job_id") == job_id)


def jobs_by_id(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The jobs whose ids occur in ``wanted.job_id``; unknown ids give no row."""
    return jobs.join(wanted.select("job_id").distinct(), "job_id", "left_semi")


def job_by_key(jobs: DataFrame, key: str) -> DataFrame:
    return jobs.filter(F.col("idempotency_key") == key)


def jobs_by_key(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The jobs whose idempotency keys occur in ``wanted.idempotency_key``."""
    # Jobs without a key all share the empty one; they stay out of the join.
    keys = wanted.select("idempotency_key").filter("idempotency_key != ''").distinct()
    return jobs.filter("idempotency_key != ''").join(keys, "idempotency_key", "left_semi").select(*jobs.columns)


def list_jobs(jobs: DataFrame, state: str | None = None, limit: int = 0) -> DataFrame:
    """Newest jobs, optionally of one state."""
    rows = jobs.filter(F.col("state") == state) if state else jobs
    return rows.orderBy(F.desc("created_at"), "job_id").limit(limit if limit > 0 else LIST_LIMIT)


def is_due(now: datetime) -> Column:
    at = instant(now)
    return ((F.col("state") == "SCHEDULED") & (F.col("scheduled_at") <= at)) | (
        (F.col("state") == "RETRYING") & (F.col("next_retry_at") <= at)
    )


def due_jobs(jobs: DataFrame, now: datetime, limit: int | None = None) -> DataFrame:
    """Jobs to run now: highest priority first, then oldest schedule, unset schedules first."""
    ordered = jobs.filter(is_due(now)).orderBy(F.desc("priority"), F.asc_nulls_first("scheduled_at"), "job_id")
    return _limited(ordered, limit)


def cancel_requested(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    rows = jobs.filter("state = 'CANCEL_REQUESTED'").orderBy("updated_at", "job_id")
    return _limited(rows, limit)


def timed_out(
    jobs: DataFrame, now: datetime, limit: int | None = None, zero_timeout_default_ms: int | None = None
) -> DataFrame:
    """Running or assigned jobs past their time limit, oldest start first.

    ``zero_timeout_default_ms`` replaces time limits that are not positive.
    """
    ms = F.col("timeout_ms")
    if zero_timeout_default_ms is not None:
        ms = F.when(ms > 0, ms).otherwise(F.lit(zero_timeout_default_ms))
    ends = F.timestamp_add("MILLISECOND", ms, F.col("started_at"))
    rows = jobs.filter(
        F.col("state").isin("RUNNING", "ASSIGNED") & F.col("started_at").isNotNull() & (ends < instant(now))
    ).orderBy("started_at", "job_id")
    return _limited(rows, limit)


def healthy_workers(workers: DataFrame) -> DataFrame:
    return workers.filter("status = 'HEALTHY'").orderBy("active_jobs", "worker_id")


def list_workers(workers: DataFrame) -> DataFrame:
    return workers.orderBy("registered_at", "worker_id")


# --- updates ----------------------------------------------------------------------------------


def stale_workers(
    workers: DataFrame, now: datetime, heartbeat: timedelta = HEARTBEAT_TIMEOUT, grace: timedelta = SUSPECT_GRACE
) -> DataFrame:
    """Workers whose status changes because their heartbeat is late: (worker_id, old, new)."""
    status, beat = F.col("status"), F.col("last_heartbeat")
    suspect, dead = instant(now - heartbeat), instant(now - heartbeat - grace)
    new = F.when(status.isin("HEALTHY", "SUSPECTED") & (beat < dead), "UNAVAILABLE").when(
        (status == "HEALTHY") & (beat < suspect) & (beat >= dead), "SUSPECTED"
    )
    return (
        workers.withColumn("new_status", new)
        .filter("new_status IS NOT NULL")
        .select("worker_id", F.col("status").alias("old_status"), "new_status")
    )


def create_jobs(requests: DataFrame, jobs: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Idempotent insert.

    ``requests`` are job rows in the job schema plus ``request_no`` (arrival order). Gives the job
    rows to add and a mapping (request_no, job_id, created): a request whose non-empty key already
    exists, in the table or earlier in the batch, maps to the job that holds the key.
    """
    stamp = instant(now)
    key = F.col("idempotency_key")
    has_key = F.coalesce(key, F.lit("")) != ""
    filled = requests.withColumns(
        {
            "state": F.when(F.coalesce("state", F.lit("")) == "", "CREATED").otherwise(F.col("state")),
            "priority": F.when(F.coalesce("priority", F.lit(0)) == 0, DEFAULT_PRIORITY).otherwise(F.col("priority")),
            "payload": F.coalesce("payload", F.lit("{}")),
            "created_at": stamp,
            "updated_at": stamp,
        }
    )
    # Requests without a key all share the empty one, so they stay out of the join.
    free, keyed = filled.filter(~has_key), filled.filter(has_key)
    # The winner per key is reduced on the map side: one key may be asked for very often.
    first = keyed.groupBy("idempotency_key").agg(
        F.min(F.struct("request_no", "job_id")).alias("_first")
    )
    held = jobs.filter(has_key).select("idempotency_key", F.col("job_id").alias("_held_id"))
    owner = first.join(held, "idempotency_key", "left").select(
        "idempotency_key",
        F.coalesce("_held_id", "_first.job_id").alias("_owner_id"),
        F.when(F.col("_held_id").isNull(), F.col("_first.request_no")).alias("_winner_no"),
    )
    marked = keyed.join(owner, "idempotency_key").withColumn(
        "_wins", F.coalesce(F.col("request_no") == F.col("_winner_no"), F.lit(False))
    )
    rows = [c for c in filled.columns if c != "request_no"]
    new_rows = free.select(*rows).unionByName(marked.filter("_wins").select(*rows))
    mapping = free.select("request_no", "job_id", F.lit(True).alias("created")).unionByName(
        marked.select("request_no", F.col("_owner_id").alias("job_id"), F.col("_wins").alias("created"))
    )
    return new_rows, mapping


# Columns a transition may set; NULL in an update leaves a column as it is.
TRANSITION_COLUMNS = [
    "worker_id",
    "execution_id",
    "last_error",
    "attempt",
    "queued_at",
    "started_at",
    "completed_at",
    "next_retry_at",
    "scheduled_at",
]


def apply_transitions(jobs: DataFrame, updates: DataFrame, now: datetime) -> DataFrame:
    """The job table after conditional transitions.

    ``updates`` has job_id, new_state, optionally only_from (allowed current states; NULL or empty
    allows any) and any of the transition columns. Transitions whose current state is not allowed are
    ignored. Of several updates of one job the largest is applied, so that rows never multiply.
    """
    sets = [c for c in TRANSITION_COLUMNS if c in updates.columns]
    allowed = F.col("only_from") if "only_from" in updates.columns else F.lit(None).cast("array<string>")
    u = updates.select(
        "job_id",
        F.col("new_state").alias("_state"),
        allowed.alias("_from"),
        *[F.col(c).alias(f"_{c}") for c in sets],
    )
    u = u.groupBy("job_id").agg(F.max(F.struct(*u.columns[1:])).alias("_u")).select("job_id", "_u.*")
    rows = jobs.join(u, "job_id", "left")
    free = F.col("_from").isNull() | (F.size("_from") == 0)
    go = F.col("_state").isNotNull() & (free | F.array_contains("_from", F.col("state")))
    new = {
        "state": F.when(go, F.col("_state")).otherwise(F.col("state")),
        "updated_at": F.when(go, instant(now)).otherwise(F.col("updated_at")),
    }
    new |= {c: F.when(go, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in sets}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])


def finish_executions(executions: DataFrame, finished: DataFrame, now: datetime) -> DataFrame:
    """The execution table after results came in.

    ``finished`` has execution_id, state, duration_ms, error, output and retryable. Results are delivered
    at least once: of several rows of an execution the largest is taken. An empty error is stored as NULL.
    """
    cols = ["state", "duration_ms", "error", "output", "retryable"]
    f = finished.select("execution_id", *[F.nullif("error", F.lit("")).alias("_error") if c == "error" else F.col(c).alias(f"_{c}") for c in cols])
    f = f.groupBy("execution_id").agg(F.max(F.struct(*f.columns[1:])).alias("_f")).select("execution_id", "_f.*", F.lit(True).alias("_hit"))
    rows = executions.join(f, "execution_id", "left")
    hit = F.col("_hit").isNotNull()
    new = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in cols}
    new["finished_at"] = F.when(hit, instant(now)).otherwise(F.col("finished_at"))
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in executions.columns])


def new_executions(assignments: DataFrame, now: datetime) -> DataFrame:
    """Rows to append for (execution_id, job_id, worker_id, attempt)."""
    nothing = lambda t: F.lit(None).cast(t)
    return assignments.select(
        "execution_id",
        "job_id",
        "worker_id",
        F.col("attempt").cast("int").alias("attempt"),
        F.lit("PENDING").alias("state"),
        nothing("timestamp").alias("started_at"),
        nothing("timestamp").alias("finished_at"),
        nothing("bigint").alias("duration_ms"),
        nothing("string").alias("error"),
        nothing("string").alias("output"),
        nothing("boolean").alias("retryable"),
        instant(now).alias("created_at"),
    )


def upsert_workers(workers: DataFrame, reports: DataFrame) -> DataFrame:
    """The worker table after upserts: the latest report of a worker replaces its row, but the time
    of its first registration stays.

    ``reports`` has the worker columns; ``last_heartbeat`` orders the reports of one worker.
    """
    # The reports of a worker are reduced on the map side, so a chatty worker is no hot task.
    latest = reports.groupBy("worker_id").agg(
        F.max_by(F.struct(*reports.columns), F.struct("last_heartbeat", "registered_at")).alias("_row"),
        F.min_by("registered_at", "last_heartbeat").alias("_first"),
    )
    old = workers.select("worker_id", F.col("registered_at").alias("_registered"))
    merged = (
        latest.join(old, "worker_id", "left")
        .select("_row.*", F.coalesce("_registered", "_first").alias("_since"))
        .withColumn("registered_at", F.col("_since"))
    )
    untouched = workers.join(latest.select("worker_id"), "worker_id", "left_anti")
    return untouched.unionByName(merged.select(*workers.columns))
