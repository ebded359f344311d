"""Streams that decide as time passes: ended jobs, limits, closed minutes, waits of queued jobs."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from jobtrail.operators import analytics as aq
from jobtrail.operators import overdue as ov
from jobtrail.operators import rollups as ru
from jobtrail.operators.jobs import timed_out
from jobtrail.operators.lifecycle import states_from_log
from jobtrail.operators.timerange import UTC, TimeRange
from jobtrail.schema import EVENT
from jobtrail.streaming import overdue as stream
from jobtrail.streaming.gate import read_late, start_gate, stream_on_time
from jobtrail.streaming.live import (
    read_live_minutes,
    read_never_started,
    read_queue_waits,
    start_live_minutes,
    start_queue_waits,
)
from jobtrail.streaming.states import read_job_states, start_job_states
from tests.conftest import at

BEGIN, EPOCH = at(2026, 1, 1), at(1970, 1, 1)


@pytest.fixture(autouse=True)
def few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def given(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def deliver(events, folder, rows):
    events(*rows).coalesce(1).write.mode("append").parquet(folder)


def random_log(rng, n, kinds, jobs, step):
    when, out = BEGIN, []
    for i in range(n):
        when += timedelta(milliseconds=rng.choice(step))
        out.append((rng.choice(kinds), when, dict(event_id=f"e{i}", job_id=f"j{rng.randrange(jobs)}", worker_id=f"w{rng.randrange(3)}")))
    return out


def state_rows(query) -> int:
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]


def test_state_of_ended_jobs_is_let_go(spark, events, tmp_path):
    folder, path = f"{tmp_path}/in", f"{tmp_path}/states"
    run = lambda ck, out, keep: start_job_states(given(spark, folder), out, ck, None, keep)
    rows = [("JOB_COMPLETED", BEGIN + timedelta(minutes=i), dict(event_id=f"a{i}", job_id=f"done{i}")) for i in range(40)]
    rows += [("JOB_STARTED", BEGIN, dict(event_id="r", job_id="runs"))]
    sizes = []
    batches = [rows, [("JOB_QUEUED", BEGIN, dict(event_id="q", job_id="waits"))], [("JOB_STARTED", BEGIN, dict(event_id="s", job_id="done3"))]]
    for batch in batches:
        deliver(events, folder, batch)
        query = run(f"{tmp_path}/ck", path, timedelta(0))
        query.awaitTermination()
        sizes.append(state_rows(query))
    kept = run(f"{tmp_path}/ck-all", f"{tmp_path}/all", timedelta(days=1))
    kept.awaitTermination()
    assert state_rows(kept) >= 42 and sizes[-1] <= 10
    # A job that was let go and heard of again still has its final state.
    whole = [tuple(r) for r in states_from_log(spark.read.schema(EVENT).parquet(folder)).orderBy("job_id").collect()]
    for out in (path, f"{tmp_path}/all"):
        assert [tuple(r) for r in read_job_states(spark, out).orderBy("job_id").collect()] == whole
    assert {r[0]: r[1] for r in whole}["done3"] == "COMPLETED"


@pytest.mark.parametrize("kind", ["runs", "workers"])
def test_limits_equal_the_batch_rule_at_every_cut(spark, events, tmp_path, kind):
    rng = random.Random(kind)
    if kind == "runs":
        kinds = ["JOB_STARTED"] * 3 + ["JOB_COMPLETED", "JOB_QUEUED", "JOB_ASSIGNED", "JOB_FAILED"]
        marks = lambda rows: ov.run_marks(rows, timedelta(seconds=10))
    else:
        kinds = ["WORKER_HEARTBEAT"] * 5 + ["WORKER_DEREGISTERED", "JOB_STARTED"]
        marks = lambda rows: ov.life_marks(rows, timedelta(seconds=3), timedelta(seconds=2))
    log = random_log(rng, 300, kinds, 8, (0, 1, 500, 1000, 3000))
    folder = f"{tmp_path}/in"
    for cut in (100, 200, 300):
        part = log[cut - 100 : cut]
        deliver(events, folder, rng.sample(part, len(part)) + part[:5])
        stream.start_overdue(marks(given(spark, folder)), f"{tmp_path}/out", f"{tmp_path}/ck", "0 seconds", None).awaitTermination()
        known = marks(events(*log[:cut]))
        now = EPOCH + timedelta(milliseconds=known.agg(F.max("at")).first()[0] >> 4)
        got = sorted(map(tuple, stream.read_overdue(spark, f"{tmp_path}/out").collect()))
        assert got == sorted(map(tuple, ov.overdue(known, now).collect())) and len(got) > 5
    assert stream.read_late_marks(spark, f"{tmp_path}/out").isEmpty()


def test_overdue_runs_are_those_of_the_job_table(spark, events):
    rng = random.Random(2)
    log = events(*random_log(rng, 300, ["JOB_STARTED", "JOB_STARTED", "JOB_COMPLETED", "JOB_QUEUED"], 25, (0, 200, 900)))
    now = BEGIN + timedelta(minutes=5)
    jobs = states_from_log(log).withColumn("timeout_ms", F.lit(20_000))
    want = {(r.job_id, r.started_at) for r in timed_out(jobs, now).collect()}
    assert want and want <= {(r.key, r.since) for r in ov.overdue(ov.run_marks(log, timedelta(seconds=20)), now).collect()}
    own = spark.createDataFrame([("j1", 1), ("j2", 10**9), ("j3", 0)], "job_id string, timeout_ms bigint")
    keys = {r.key for r in ov.overdue(ov.run_marks(log, timedelta(seconds=20), own), now).collect()}
    assert "j2" not in keys


def test_marks_behind_the_watermark_are_listed(spark, events, tmp_path):
    folder = f"{tmp_path}/in"
    for minute in (0, 60, 1):
        deliver(events, folder, [("JOB_STARTED", BEGIN + timedelta(minutes=minute), dict(event_id=f"m{minute}", job_id="j"))])
        marks = ov.run_marks(given(spark, folder), timedelta(minutes=30))
        stream.start_overdue(marks, f"{tmp_path}/out", f"{tmp_path}/ck", "1 minute", None).awaitTermination()
    late = stream.read_late_marks(spark, f"{tmp_path}/out").collect()
    assert [(r.key, r.since.minute, r.label) for r in late] == [("j", 1, "LATE")]
    assert [r.since.minute for r in stream.read_overdue(spark, f"{tmp_path}/out").collect()] == [0]


def test_closed_minutes_and_late_rows_are_the_rollup(spark, events, tmp_path):
    rng, folder, gate = random.Random(8), f"{tmp_path}/in", f"{tmp_path}/gate"
    log = random_log(rng, 240, ["JOB_QUEUED", "JOB_COMPLETED"], 5, (1000, 20_000, 60_000))
    parts = [log[:120], log[:10] + log[110:180], log[60:100] + log[170:]]
    for part in parts:
        deliver(events, folder, part + part[::3])
        start_gate(given(spark, folder), gate, f"{tmp_path}/ck-gate", timedelta(minutes=5), None).awaitTermination()
        start_live_minutes(stream_on_time(spark, gate), f"{tmp_path}/out", f"{tmp_path}/ck", "5 minutes", None).awaitTermination()
    assert read_late(spark, gate).isEmpty()  # all of them are copies of events that were on time
    deliver(events, folder, [("JOB_QUEUED", BEGIN, dict(event_id="late"))] * 2)
    start_gate(given(spark, folder), gate, f"{tmp_path}/ck-gate", timedelta(minutes=5), None).awaitTermination()
    assert [r.event_id for r in read_late(spark, gate).collect()] == ["late"]
    batch = ru.job_minute_stats(ru.rollup_input(spark.read.schema(EVENT).parquet(folder)), sketches=False)
    end = log[-1][1] - timedelta(minutes=6)
    got = {tuple(r) for r in read_live_minutes(spark, f"{tmp_path}/out", gate).collect()}
    want = {tuple(r) for r in batch.collect()}
    closed = lambda rows: {r for r in rows if r[0].astimezone(UTC) < end}
    assert closed(got) == closed(want) and len(got) > 40


def test_a_gate_that_starts_anew_deals_rows_as_before(spark, events, tmp_path):
    folder = f"{tmp_path}/in"
    for n, hours in enumerate((0, 5, 1)):
        deliver(events, folder, [("JOB_QUEUED", BEGIN + timedelta(hours=hours), dict(event_id=f"e{n}"))])
    for ck in ("ck", "again"):  # the second run repeats all batches
        start_gate(given(spark, folder), f"{tmp_path}/gate", f"{tmp_path}/{ck}", timedelta(hours=1), None).awaitTermination()
        assert [r.event_id for r in read_late(spark, f"{tmp_path}/gate").collect()] == ["e2"]


def test_queue_waits_while_jobs_run(spark, events, tmp_path):
    rng, folder = random.Random(3), f"{tmp_path}/in"
    log = random_log(rng, 200, ["JOB_QUEUED", "JOB_STARTED"], 40, (1000, 30_000))
    for part in (log[:100], log[100:]):
        deliver(events, folder, rng.sample(part, len(part)) + part[:9])
        sides = [given(spark, folder) for _ in range(2)]
        start_queue_waits(*sides, f"{tmp_path}/out", f"{tmp_path}/ck", "1 minute", "5 minutes", None).awaitTermination()
    until = log[-1][1] - timedelta(minutes=10)
    rows = spark.read.schema(EVENT).parquet(folder)
    pairs = aq.queue_waits(rows, TimeRange(BEGIN - timedelta(days=1), until))
    got = sorted(map(tuple, read_queue_waits(spark, f"{tmp_path}/out", until).collect()))
    assert got == sorted(map(tuple, pairs.collect())) and got
    starts = {}
    for kind, when, more in log:
        starts.setdefault(more["job_id"], []).append(when) if kind == "JOB_STARTED" else None
    alone = {
        (more["job_id"], when) for kind, when, more in log
        if kind == "JOB_QUEUED" and when < until and not any(when <= s <= when + timedelta(minutes=5) for s in starts.get(more["job_id"], []))
    }
    assert {(r.job_id, r.queued_at.astimezone(UTC)) for r in read_never_started(spark, f"{tmp_path}/out", until).collect()} == alone and alone
