"""Schemas, vocabulary and state names of the job-event data model."""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# Event types, states, topics. They are part of the data format.
# ---------------------------------------------------------------------------------------------

EVENT_TYPES = [
    "JOB_CREATED",
    "JOB_SCHEDULED",
    "JOB_QUEUED",
    "JOB_ASSIGNED",
    "JOB_STARTED",
    "JOB_COMPLETED",
    "JOB_FAILED",
    "JOB_TIMEOUT",
    "JOB_RETRY_SCHEDULED",
    "JOB_CANCEL_REQUESTED",
    "JOB_CANCELLED",
    "JOB_EXPIRED",
    "WORKER_REGISTERED",
    "WORKER_HEARTBEAT",
    "WORKER_CAPACITY_CHANGED",
    "WORKER_UNAVAILABLE",
    "WORKER_RECOVERED",
    "WORKER_DEREGISTERED",
    "SCHEDULER_STARTED",
    "SCHEDULER_STOPPED",
    "SCHEDULER_LEADER_ACQUIRED",
    "SCHEDULER_LEADER_LOST",
    "SCHEDULER_REBALANCED",
]

JOB_STATES = [
    "CREATED",
    "SCHEDULED",
    "QUEUED",
    "ASSIGNED",
    "RUNNING",
    "COMPLETED",
    "FAILED",
    "TIMEOUT",
    "RETRYING",
    "CANCEL_REQUESTED",
    "CANCELLED",
    "EXPIRED",
]
TERMINAL_JOB_STATES = ["COMPLETED", "FAILED", "CANCELLED", "TIMEOUT", "EXPIRED"]
EXECUTION_STATES = ["PENDING", "RUNNING", "COMPLETED", "FAILED", "TIMEOUT", "CANCELLED"]
WORKER_STATUSES = ["HEALTHY", "SUSPECTED", "UNAVAILABLE", "DRAINING"]
SCHEDULE_TYPES = ["immediate", "delayed", "one_time", "recurring"]
JOB_TYPES = ["builtin", "webhook"]
RESULT_REASONS = ["success", "failed", "timeout", "cancelled"]
BUILTIN_HANDLERS = ["sleep", "echo", "fail", "cpu_burn"]

OUTCOME_TYPES = ["JOB_COMPLETED", "JOB_FAILED", "JOB_TIMEOUT", "JOB_CANCELLED", "JOB_RETRY_SCHEDULED"]
FAILURE_TYPES = ["JOB_FAILED", "JOB_TIMEOUT", "JOB_CANCELLED", "JOB_RETRY_SCHEDULED"]

# Rows with an equal key are copies of one event.
EVENT_KEY = ["event_type", "event_time", "event_id"]

NANOS_PER_MS = 1_000_000

# ---------------------------------------------------------------------------------------------
# Names and types of the columns, as DDL text (accepted by readers, from_json and createDataFrame).
# ---------------------------------------------------------------------------------------------

EVENT = (
    "event_id string, event_type string, event_version int, event_time timestamp, ingested_at timestamp, "
    "job_id string, execution_id string, worker_id string, scheduler_id string, attempt bigint, "
    "trace_id string, payload string"
)
EVENT_COLUMNS = [field.split()[0] for field in EVENT.split(", ")]

# Event messages as they travel: times stay text until they are checked.
EVENT_MESSAGE = (
    "event_id string, event_type string, event_version int, event_time string, ingested_at string, "
    "job_id string, execution_id string, worker_id string, scheduler_id string, attempt bigint, "
    "trace_id string, payload string"
)

SCHEDULE = "type string, run_at timestamp, delay bigint, cron_expr string, timezone string"
RETRY_POLICY = (
    "max_attempts int, backoff_strategy string, initial_delay bigint, max_delay bigint, "
    "multiplier double, jitter boolean"
)
_SCHEDULE_STRUCT = f"struct<{SCHEDULE}>"
_RETRY_STRUCT = f"struct<{RETRY_POLICY}>"

JOB = (
    "job_id string, name string, type string, payload string, priority int, state string, "
    f"schedule {_SCHEDULE_STRUCT}, retry_policy {_RETRY_STRUCT}, "
    "timeout_ms bigint, idempotency_key string, attempt int, max_attempts int, worker_id string, "
    "execution_id string, last_error string, scheduled_at timestamp, queued_at timestamp, "
    "started_at timestamp, completed_at timestamp, next_retry_at timestamp, created_at timestamp, "
    "updated_at timestamp, metadata map<string,string>"
)

JOB_REQUEST = (
    f"request_id string, name string, type string, payload string, priority int, "
    f"schedule {_SCHEDULE_STRUCT}, retry_policy {_RETRY_STRUCT}, "
    "timeout_seconds bigint, idempotency_key string, metadata map<string,string>"
)

EXECUTION = (
    "execution_id string, job_id string, worker_id string, attempt int, state string, "
    "started_at timestamp, finished_at timestamp, duration_ms bigint, error string, output string, "
    "retryable boolean, created_at timestamp"
)

WORKER = (
    "worker_id string, address string, status string, capacity int, active_jobs int, "
    "capabilities struct<builtin:boolean,webhook:boolean>, labels map<string,string>, "
    "last_heartbeat timestamp, registered_at timestamp, metadata map<string,string>"
)

OUTBOX = (
    "id string, event_type string, aggregate_id string, payload string, created_at timestamp, "
    "published_at timestamp"
)

QUEUED_JOB = (
    "job_id string, execution_id string, name string, type string, payload string, priority int, "
    "attempt int, timeout bigint, enqueued_at string, trace_id string"
)

RESULT = (
    "job_id string, execution_id string, worker_id string, attempt int, success boolean, output string, "
    "error string, retryable boolean, duration_ms bigint, reason string"
)
