from __future__ import annotations

import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from jobtrail.schema import EVENT, EVENT_COLUMNS, JOB, WORKER  # noqa: E402
from jobtrail.session import local_session  # noqa: E402

UTC = timezone.utc


def at(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=UTC)


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture
def events(spark):
    """Build log rows from (event_type, event_time, overrides)."""

    def build(*rows):
        out = []
        for i, (kind, when, *more) in enumerate(rows):
            row = dict(
                event_id=f"e{i}", event_type=kind, event_version=1, event_time=when, ingested_at=when, job_id="",
                execution_id="", worker_id="", scheduler_id="", attempt=1, trace_id="", payload="{}",
            )
            row.update(more[0] if more else {})
            out.append(tuple(row[c] for c in EVENT_COLUMNS))
        return spark.createDataFrame(out, EVENT)

    return build


_RETRY = dict(
    max_attempts=3, backoff_strategy="fixed", initial_delay=1_000_000_000, max_delay=0, multiplier=2.0, jitter=False
)


@pytest.fixture
def jobs(spark):
    def build(*rows):
        base = dict(
            name="n", type="builtin", payload="{}", priority=5, state="SCHEDULED",
            schedule=dict(type="immediate", run_at=None, delay=0, cron_expr="", timezone=""), retry_policy=_RETRY,
            timeout_ms=30000, idempotency_key="", attempt=1, max_attempts=3, worker_id="", execution_id="",
            last_error="", scheduled_at=None, queued_at=None, started_at=None, completed_at=None,
            next_retry_at=None, created_at=at(2026, 1, 1), updated_at=at(2026, 1, 1), metadata={},
        )
        names = ["job_id", *base]
        return spark.createDataFrame([tuple((base | r)[c] for c in names) for r in rows], JOB)

    return build


@pytest.fixture
def workers(spark):
    def build(*rows):
        base = dict(
            address="a:1", status="HEALTHY", capacity=1, active_jobs=0, capabilities=None, labels={},
            last_heartbeat=at(2026, 1, 1), registered_at=at(2025, 1, 1), metadata={},
        )
        names = ["worker_id", *base]
        return spark.createDataFrame([tuple((base | r)[c] for c in names) for r in rows], WORKER)

    return build
