"""Operational tables and lifecycle decisions."""

from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from jobtrail.operators import jobs as jb
from jobtrail.operators import lifecycle as lc
from jobtrail.operators.ranking import rank_rows
from jobtrail.schema import EXECUTION, RESULT
from jobtrail.sinks.outbox import to_events
from tests.conftest import at

NOW = at(2026, 1, 1, 12)
MIN = timedelta(minutes=1)


def ids(df, col="job_id"):
    return [r[col] for r in df.collect()]


def results(spark, *rows):
    base = dict(execution_id="x", worker_id="w1", attempt=1, success=False, output=None, error="boom", retryable=True,
                duration_ms=5, reason="")
    names = ["job_id", *base]
    return spark.createDataFrame([tuple((base | r)[c] for c in names) for r in rows], RESULT)


# --- tables -----------------------------------------------------------------------------------


def test_lookups(jobs):
    df = jobs(dict(job_id="a", idempotency_key="k"), dict(job_id="b", state="RUNNING"))
    assert ids(jb.job_by_id(df, "a")) == ["a"] and ids(jb.job_by_id(df, "zz")) == []
    assert ids(jb.job_by_key(df, "k")) == ["a"]
    assert ids(jb.list_jobs(df, "RUNNING")) == ["b"] and len(ids(jb.list_jobs(df))) == 2
    assert len(ids(jb.list_jobs(df, limit=1))) == 1


def test_due_jobs_in_order(jobs):
    df = jobs(
        dict(job_id="past", scheduled_at=NOW - MIN),
        dict(job_id="future", scheduled_at=NOW + MIN),
        dict(job_id="exact", scheduled_at=NOW, priority=9),
        dict(job_id="retry-null", state="RETRYING", next_retry_at=NOW - MIN),
        dict(job_id="retry-later", state="RETRYING", next_retry_at=NOW + MIN),
        dict(job_id="done", state="COMPLETED", scheduled_at=NOW - MIN),
    )
    assert ids(jb.due_jobs(df, NOW)) == ["exact", "retry-null", "past"]
    assert ids(jb.due_jobs(df, NOW, 1)) == ["exact"]
    out = lc.promote_due(df, NOW)
    after = jb.apply_transitions(df, out.updates, NOW)
    assert sorted(ids(after.filter("state = 'QUEUED'"))) == ["exact", "past", "retry-null"]
    assert out.messages.count() == 3 and ids(out.events, "event_type") == ["JOB_QUEUED"] * 3


def test_timed_out(jobs):
    df = jobs(
        dict(job_id="late", state="RUNNING", started_at=NOW - MIN, timeout_ms=59_999),
        dict(job_id="exact", state="RUNNING", started_at=NOW - MIN, timeout_ms=60_000),
        dict(job_id="zero", state="ASSIGNED", started_at=NOW - timedelta(seconds=10), timeout_ms=0),
        dict(job_id="none", state="RUNNING", started_at=None),
    )
    assert ids(jb.timed_out(df, NOW)) == ["late", "zero"]
    assert ids(jb.timed_out(df, NOW, zero_timeout_default_ms=30_000)) == ["late"]


def test_stale_workers(workers):
    s = lambda n: NOW - timedelta(seconds=n)
    df = workers(
        dict(worker_id="fresh", last_heartbeat=s(15)),
        dict(worker_id="slow", last_heartbeat=s(16)),
        dict(worker_id="edge", last_heartbeat=s(25)),
        dict(worker_id="dead", last_heartbeat=s(26)),
        dict(worker_id="still-suspect", status="SUSPECTED", last_heartbeat=s(20)),
        dict(worker_id="draining", status="DRAINING", last_heartbeat=s(99)),
        dict(worker_id="gone", status="UNAVAILABLE", last_heartbeat=s(99)),
    )
    out = {r.worker_id: r.new_status for r in jb.stale_workers(df, NOW).collect()}
    assert out == {"slow": "SUSPECTED", "edge": "SUSPECTED", "dead": "UNAVAILABLE"}
    assert ids(lc.unavailable_events(jb.stale_workers(df, NOW)), "worker_id") == ["dead"]


def test_idempotent_insert(spark, jobs):
    held = jobs(dict(job_id="old", idempotency_key="pay-0"))
    asked = spark.createDataFrame(
        [(1, "a", "pay-1", 0, "", None), (2, "b", "pay-1", 3, "SCHEDULED", "{}"), (3, "c", "pay-0", 3, "", "{}"),
         (4, "d", "", 3, "", "{}"), (5, "e", "", 3, "", "{}")],
        "request_no int, job_id string, idempotency_key string, priority int, state string, payload string",
    )
    rows, mapping = jb.create_jobs(asked, held, NOW)
    assert {r.request_no: (r.job_id, r.created) for r in mapping.collect()} == {
        1: ("a", True), 2: ("a", False), 3: ("old", False), 4: ("d", True), 5: ("e", True)
    }
    first = rows.filter("job_id = 'a'").first()
    assert (first.priority, first.state, first.payload) == (5, "CREATED", "{}")
    assert sorted(ids(rows)) == ["a", "d", "e"]


def test_stale_transition_is_ignored(spark, jobs):
    df = jobs(dict(job_id="a", state="COMPLETED"), dict(job_id="b", state="SCHEDULED"))
    up = df.select("job_id", F.lit("QUEUED").alias("new_state"), F.array(F.lit("SCHEDULED")).alias("only_from"))
    out = {r.job_id: r.state for r in jb.apply_transitions(df, up, NOW).collect()}
    assert out == {"a": "COMPLETED", "b": "QUEUED"}


def test_worker_upsert_keeps_first_registration(workers):
    table = workers(dict(worker_id="a"), dict(worker_id="keep"))
    reports = workers(
        dict(worker_id="a", address="new:1", last_heartbeat=NOW, registered_at=NOW),
        dict(worker_id="b", address="b:1", last_heartbeat=NOW - MIN, registered_at=NOW - MIN),
        dict(worker_id="b", address="b:2", last_heartbeat=NOW, registered_at=NOW),
    )
    out = {r.worker_id: (r.address, r.registered_at) for r in jb.upsert_workers(table, reports).collect()}
    assert set(out) == {"a", "b", "keep"}
    assert out["a"][0] == "new:1" and out["a"][1] < out["b"][1]
    assert out["b"][0] == "b:2"


# --- decisions --------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "job, result, action, state",
    [
        (dict(state="RUNNING"), dict(success=True), "completed", "COMPLETED"),
        (dict(state="RUNNING"), dict(), "failure_retry", "RETRYING"),
        (dict(state="RUNNING"), dict(reason="timeout", retryable=False), "timeout_retry", "RETRYING"),
        (dict(state="CANCEL_REQUESTED"), dict(success=True), "cancelled", "CANCELLED"),
        (dict(state="RUNNING"), dict(reason="cancelled"), "cancelled", "CANCELLED"),
        (dict(state="RUNNING", max_attempts=2), dict(attempt=2), "failure", "FAILED"),
        (dict(state="RUNNING", max_attempts=5), dict(retryable=False), "failure", "FAILED"),
        (dict(state="RUNNING", max_attempts=2), dict(attempt=2, reason="timeout"), "timeout", "TIMEOUT"),
        (dict(state="COMPLETED"), dict(), "ignored", None),
        (None, dict(), "unknown_job", None),
    ],
)
def test_result_rules(spark, jobs, job, result, action, state):
    table = jobs(dict(job_id="j" if job is not None else "other") | (job or {}))
    row = lc.decide_results(results(spark, dict(job_id="j") | result), table, NOW).first()
    assert (row.action, row.job_state) == (action, state)


def test_results_of_one_job_fold_in_order(spark, jobs):
    table = jobs(dict(job_id="j", state="RUNNING", worker_id="w1", execution_id="x1"))
    batch = results(
        spark,
        dict(job_id="j", execution_id="x1", attempt=1),
        dict(job_id="j", execution_id="x2", attempt=2, success=True, error=""),
        dict(job_id="j", execution_id="x3", attempt=3, reason="timeout"),
    )
    out = lc.resolve_results(batch, table, NOW)
    up = out.updates.collect()
    assert len(up) == 1 and up[0].new_state == "COMPLETED"
    assert (up[0].last_error, up[0].worker_id) == ("boom", "")
    after = jb.apply_transitions(table, out.updates, NOW).first()
    assert (after.state, after.worker_id, after.last_error) == ("COMPLETED", "", "boom")
    kinds = [r.event_type for r in out.events.orderBy("attempt", "seq").collect()]
    assert kinds == ["JOB_FAILED", "JOB_RETRY_SCHEDULED", "JOB_COMPLETED"]
    assert sorted(ids(out.executions, "execution_id")) == ["x1", "x2"]
    events = to_events(out.events, NOW, "s")
    assert events.select("event_id").distinct().count() == 3
    assert events.collect() == to_events(out.events, NOW, "s").collect()


@pytest.mark.parametrize(
    "policy, attempt, ms",
    [
        (dict(initial_delay=2_000_000_000), 1, 2000), (dict(initial_delay=2_000_000_000), 5, 2000),
        (dict(backoff_strategy="exponential"), 1, 1000), (dict(backoff_strategy="exponential"), 2, 2000),
        (dict(backoff_strategy="exponential"), 3, 4000),
        (dict(backoff_strategy="exponential", multiplier=10.0, max_delay=3_000_000_000), 5, 3000),
        (dict(initial_delay=0), 1, 1000), (dict(backoff_strategy="exponential", multiplier=0.5), 2, 2000),
    ],
)
def test_backoff(jobs, policy, attempt, ms):
    base = dict(max_attempts=3, backoff_strategy="fixed", initial_delay=1_000_000_000, max_delay=0, multiplier=2.0,
                jitter=False)
    row = lc.backoff(jobs(dict(job_id="j", attempt=attempt, retry_policy=base | policy))).first()
    assert (row.delay_ms, row.delay_min_ms, row.delay_max_ms) == (ms, ms, ms)


def test_jitter_spreads_and_repeats(spark, jobs):
    policy = dict(max_attempts=3, backoff_strategy="fixed", initial_delay=100_000_000, max_delay=0, multiplier=2.0,
                  jitter=True)
    table = jobs(*[dict(job_id=f"j{i}", state="RUNNING", retry_policy=policy) for i in range(200)])
    batch = results(spark, *[dict(job_id=f"j{i}", execution_id=f"x{i}") for i in range(200)])
    got = [r.delay_ms for r in lc.decide_results(batch, table, NOW, jitter_seed=1).orderBy("job_id").collect()]
    assert all(50 <= d <= 150 for d in got) and len(set(got)) > 20
    assert got == [r.delay_ms for r in lc.decide_results(batch, table, NOW, jitter_seed=1).orderBy("job_id").collect()]


def test_worker_loss(spark, jobs):
    mine = dict(worker_id="w1", execution_id="x")
    table = jobs(
        dict(job_id="run", state="RUNNING", **mine), dict(job_id="asg", state="ASSIGNED", **mine),
        dict(job_id="can", state="CANCEL_REQUESTED", **mine), dict(job_id="end", state="RUNNING", attempt=3, **mine),
        dict(job_id="other", state="RUNNING", worker_id="w2"), dict(job_id="q", state="QUEUED", worker_id="w1"),
    )
    out = lc.recover_jobs(table, spark.createDataFrame([("w1",)], "worker_id string"), NOW)
    assert {r.job_id: r.new_state for r in out.updates.collect()} == {
        "run": "RETRYING", "asg": "RETRYING", "can": "CANCELLED", "end": "FAILED"
    }


def test_cancel(spark, jobs):
    table = jobs(*[dict(job_id=s, state=s, worker_id="w") for s in ("SCHEDULED", "RUNNING", "COMPLETED", "FAILED")])
    asked = spark.createDataFrame([(s,) for s in ("SCHEDULED", "RUNNING", "COMPLETED", "FAILED", "??")], "job_id string")
    got = {r.job_id: r.status for r in lc.cancel_jobs(asked, table, NOW).collect()}
    assert got == {"SCHEDULED": "CANCELLED", "RUNNING": "CANCEL_REQUESTED", "COMPLETED": "conflict",
                   "FAILED": "CANCELLED", "??": "not_found"}


def test_queue_order(spark):
    rows = [("low", 1, NOW), ("high", 10, NOW), ("mid-late", 5, NOW + MIN), ("mid", 5, NOW)]
    df = spark.createDataFrame(rows, "job_id string, priority int, enqueued_at timestamp")
    assert ids(lc.dispatch_order(df).orderBy("position")) == ["high", "mid", "mid-late", "low"]


def test_rank_over_many_tasks(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"),
                                   F.pmod(F.xxhash64("id"), F.lit(50)).alias("p"), "id").repartition(8)
    ranked = rank_rows(df, ["g"], [F.desc("p"), F.asc("id")], "n").cache()
    assert ranked.count() == 20000
    hot = [(r.p, r.id) for r in ranked.filter("g = 'hot'").orderBy("n").collect()]
    assert hot == sorted(hot, key=lambda x: (-x[0], x[1]))
    assert ranked.filter("g = 'hot'").agg(F.max("n"), F.countDistinct("n")).first()[:] == (len(hot), len(hot))


def test_workers(workers):
    df = workers(
        dict(worker_id="a", capacity=5, active_jobs=2), dict(worker_id="over", capacity=5, active_jobs=10),
        dict(worker_id="sus", status="SUSPECTED"), dict(worker_id="idle"), dict(worker_id="full", active_jobs=1),
    )
    got = {r.worker_id: (r.slots, r.assignable) for r in lc.worker_capacity(df).collect()}
    assert got == {"a": (3, True), "over": (0, False), "sus": (1, False), "idle": (1, True), "full": (0, False)}
    assert ids(lc.pick_worker(df), "worker_id") == ["idle"]


def test_requests(spark):
    cols = ("request_id string, name string, type string, payload string, priority int, "
            "schedule struct<type:string,run_at:timestamp,delay:bigint,cron_expr:string,timezone:string>, "
            "retry_policy struct<max_attempts:int,backoff_strategy:string,initial_delay:bigint,max_delay:bigint,"
            "multiplier:double,jitter:boolean>, timeout_seconds bigint, idempotency_key string, "
            "metadata map<string,string>")

    def req(i, name="n", kind="", priority=0, schedule=None):
        return (i, name, kind, None, priority, schedule, None, None, None, None)

    rows = [
        req("noname", name=""), req("shell", kind="shell"), req("high", priority=99),
        req("cron", schedule=("recurring", None, None, "not a cron", None)),
        req("ok", priority=8), req("late", schedule=("delayed", None, 60_000_000_000, None, None)),
        req("once", schedule=("one_time", NOW + timedelta(hours=1), None, None, None)),
        req("back", schedule=("delayed", None, -1, None, None)),
    ]
    checked = lc.validate_requests(spark.createDataFrame(rows, cols), NOW).cache()
    assert sorted(ids(lc.rejected_requests(checked), "request_id")) == ["cron", "high", "noname", "shell"]
    plan = {r.request_id: r for r in lc.plan_requests(checked, NOW).collect()}
    assert {k: r.state for k, r in plan.items()} == {
        "ok": "QUEUED", "late": "SCHEDULED", "once": "SCHEDULED", "back": "QUEUED"
    }
    assert plan["late"].scheduled_at.timestamp() == (NOW + MIN).timestamp()
    assert (plan["ok"].timeout_ms, plan["ok"].max_attempts, plan["ok"].priority, plan["late"].priority) == (30000, 3, 8, 5)
    assert lc.request_events(lc.plan_requests(checked, NOW)).count() == 4 * 2 + 2


def test_precheck_and_http(jobs, spark):
    df = jobs(
        dict(job_id="1", type="webhook", payload='{"url":"ftp://x"}'), dict(job_id="2", type="webhook"),
        dict(job_id="3", payload='{"handler":"nope"}'), dict(job_id="4", payload="{"),
        dict(job_id="5", type="unknown"), dict(job_id="6", payload='{"handler":"echo"}'),
        dict(job_id="7", type="webhook", payload='{"url":"https://x"}'),
    )
    rows = {r.job_id: r for r in lc.precheck_payloads(df).collect()}
    assert rows["6"].precheck_error is None and rows["7"].precheck_error is None and rows["7"].method == "POST"
    assert all(rows[i].precheck_error for i in "12345")
    x = spark.createDataFrame([(str(c), f'{{"status_code":{c}}}') for c in (200, 500, 429, 400)],
                              "execution_id string, output string")
    got = {r.status_code: (r.success, r.retryable) for r in lc.http_outcomes(x).collect()}
    assert got == {200: (True, False), 500: (False, True), 429: (False, True), 400: (False, False)}


def test_states_follow_time_then_order(events):
    t = at(2026, 1, 1)
    df = events(
        ("JOB_STARTED", t, dict(job_id="a")), ("JOB_QUEUED", t, dict(job_id="a")),
        ("JOB_FAILED", t, dict(job_id="b")), ("JOB_RETRY_SCHEDULED", t, dict(job_id="b")),
        ("JOB_COMPLETED", t, dict(job_id="c")), ("JOB_QUEUED", t - MIN, dict(job_id="c", attempt=4)),
        ("WORKER_REGISTERED", t),
    )
    got = {r.job_id: (r.state, r.attempts) for r in lc.states_from_log(df).collect()}
    assert got == {"a": ("RUNNING", 1), "b": ("RETRYING", 1), "c": ("COMPLETED", 4)}


def test_results_delivered_twice(spark, jobs):
    table = jobs(dict(job_id="j", state="RUNNING", worker_id="w", execution_id="x"))
    one = dict(job_id="j", execution_id="x", success=False, retryable=False, error="")
    twice = results(spark, one, one)
    out = lc.resolve_results(twice, table, NOW)
    assert out.updates.count() == 1 and out.executions.count() == 1
    events = to_events(out.events, NOW)
    assert events.count() == events.select("event_id").distinct().count() == 1
    row = ("x", "j", "w", 1, "PENDING", None, None, None, None, None, None, NOW)
    runs = spark.createDataFrame([row], EXECUTION)
    ended = out.executions.union(out.executions)
    done = jb.finish_executions(runs, ended, NOW).collect()
    assert len(done) == 1 and done[0].state == "FAILED" and done[0].error is None
    moved = jb.apply_transitions(table, out.updates.union(out.updates), NOW)
    assert [r.state for r in moved.collect()] == ["FAILED"]
