from __future__ import annotations

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtrail.functions.percentiles import exact_percentiles
from jobtrail.functions.scalar import json_uint
from jobtrail.operators import analytics as aq
from jobtrail.operators import dashboard as db
from jobtrail.operators import rollups as ru
from jobtrail.operators.timerange import TimeRange
from tests.conftest import at

DAY = TimeRange(at(2026, 1, 1), at(2026, 1, 2))


def done(minute, ms, **more):
    return ("JOB_COMPLETED", at(2026, 1, 1, 0, minute), dict(payload=f'{{"duration_ms":{ms}}}', **more))


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_percentiles(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {g: np.floor(np.exp(rng.uniform(0, 25, n))).astype(int) for g, n in [("a", 1), ("b", 2), ("c", 999)]}
    groups["d"] = np.repeat([0, 7, 7_000_000_000], [400, 3, 10])
    rows = [(g, int(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v bigint").repartition(7)
    ps = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    for r in exact_percentiles(df, ["g"], "v", ps, "n", "mean").collect():
        want = np.percentile(groups[r.g], [p * 100 for p in ps.values()])
        assert np.allclose([r[n] for n in ps], want, rtol=1e-12)
        assert r.n == len(groups[r.g]) and np.isclose(r["mean"], groups[r.g].mean())
    whole = exact_percentiles(df, [], "v", ps).first()
    assert np.allclose(list(whole), np.percentile([v for _, v in rows], [p * 100 for p in ps.values()]))


def test_durations_at_the_edge(spark):
    texts = ["{}", '{"duration_ms":0}', '{"duration_ms":-4}', '{"duration_ms":"x"}', '{"duration_ms":9}', "", None]
    df = spark.createDataFrame([(t,) for t in texts], "payload string")
    assert [r.d for r in df.select(json_uint("payload", "duration_ms").alias("d")).collect()] == [0, 0, 0, 0, 9, 0, 0]


def test_empty_window(events):
    df = events(("JOB_CREATED", at(2025, 1, 1)))
    assert aq.throughput_points(df, DAY).count() == 0
    assert tuple(aq.throughput_totals(df, DAY).first()) == (0, 0, 0, 0.0)
    assert tuple(aq.latency_summary(df, DAY).first()) == (0.0, 0.0, 0.0, 0.0, 0.0, 0)
    assert tuple(aq.outcome_rates(df, DAY).first()) == (0.0,) * 5
    assert tuple(aq.queue_wait(df, DAY).first()) == (0.0, 0.0, 0)
    assert tuple(aq.queue_depth(df, DAY).first()) == (0, 0, 0.0)
    assert tuple(aq.capacity(df, DAY).first()) == (0, 0, 0.0, 30.0, 0, 0)
    assert aq.worker_stats(df, DAY).count() == 0
    assert aq.anomalies(df, DAY, DAY.before()).count() == 0


def test_buckets_exist_for_any_event(events):
    df = events(("WORKER_REGISTERED", at(2026, 1, 1, 5)), done(1, 5))
    points = aq.throughput_points(df, DAY).collect()
    assert [(p.completed, p.rate_per_sec) for p in points] == [(1, 1 / 60), (0, 0.0)]
    assert aq.throughput_points(df, DAY, "weird").count() == 2
    assert aq.failure_series(df, DAY).count() == 2
    assert aq.completed_per_minute(df, DAY).first().avg_per_minute == 0.5


def test_retry_rate_needs_attempts(events):
    df = events(("JOB_RETRY_SCHEDULED", at(2026, 1, 1)), ("JOB_CANCELLED", at(2026, 1, 1)))
    r = aq.outcome_rates(df, DAY).first()
    assert (r.cancel_rate, r.retry_rate) == (1.0, 0.0)
    df = events(*[(k, at(2026, 1, 1)) for k in ("JOB_COMPLETED", "JOB_FAILED", "JOB_TIMEOUT", "JOB_RETRY_SCHEDULED")])
    assert aq.outcome_rates(df, DAY).first().retry_rate == 0.25


def test_top_workers_and_share(events):
    rows = [done(i % 60, 10 + i, worker_id=f"w{i % 105:03d}") for i in range(210)]
    rows.append(("JOB_FAILED", at(2026, 1, 1), dict(worker_id="only-failed")))
    out = aq.worker_stats(events(*rows), DAY).collect()
    assert len(out) == 100 and [r.worker_id for r in out] == sorted(r.worker_id for r in out)
    assert all(r.share == 0.01 for r in out)
    failed = aq.worker_stats(events(rows[-1]), DAY).first()
    assert (failed.failed, failed.avg_ms, failed.share) == (1, 0.0, 0.0)


def test_queue_wait_pairs(events):
    t = at(2026, 1, 1)

    def job(name, queued, *started):
        return [("JOB_QUEUED", t + timedelta(milliseconds=queued), dict(job_id=name))] + [
            ("JOB_STARTED", t + timedelta(milliseconds=s), dict(job_id=name)) for s in started
        ]

    df = events(*job("a", 0, 100, 900), *job("b", 50, 10), *job("c", 5, 5), *job("", 0, 7), *job("d", -5, 9))
    assert {r.job_id: r.wait_ms for r in aq.queue_waits(df, DAY).collect()} == {"a": 100, "c": 0}
    assert tuple(aq.queue_wait(df, DAY).first()) == (50.0, 95.0, 2)


def test_zero_durations_count_in_snapshots_only(events):
    df = events(done(0, 0), done(1, 100), ("JOB_COMPLETED", at(2026, 1, 1, 0, 2)))
    assert aq.latency_summary(df, DAY).first()["count"] == 1
    snap = aq.snapshots(df, {"current": DAY}).first()
    assert snap.p95_latency_ms == pytest.approx(90.0)


@pytest.mark.parametrize(
    "metric, base, cur, want",
    [
        ("p95_latency_ms", 10.0, 20.0, "warn"), ("p95_latency_ms", 10.0, 40.0, "critical"),
        ("p95_latency_ms", 10.0, 19.9, None), ("p95_latency_ms", 0.0, 1.0, "critical"),
        ("failure_rate", 0.1, 0.5, "critical"), ("failure_rate", 0.1, 0.4, "warn"), ("failure_rate", 0.0, 0.0, None),
        ("throughput_per_sec", 8.0, 4.0, "warn"), ("throughput_per_sec", 8.0, 2.0, "critical"),
        ("throughput_per_sec", 8.0, 0.0, "critical"), ("throughput_per_sec", 8.0, 4.1, None),
        ("throughput_per_sec", 0.0, 5.0, None),
    ],
)
def test_anomaly_limits(spark, metric, base, cur, want):
    names = [c[0] for c in aq.ANOMALY_CHECKS]
    rows = [(w, *[v if n == metric else 0.0 for n in names]) for w, v in (("baseline", base), ("current", cur))]
    df = spark.createDataFrame(rows, "win string, " + ", ".join(f"{n} double" for n in names))
    found = aq.with_message(aq.check_anomalies(df)).collect()
    assert [r.severity for r in found] == ([want] if want else [])
    if base == 0 and want:
        assert found[0].ratio == float("inf") and "+Inf" in found[0].message


def test_copies_change_nothing_but_raw_panels(events):
    rows = [done(i % 7, 10 * i + 1, worker_id=f"w{i % 3}", job_id=f"j{i}") for i in range(40)]
    once = events(*rows)
    twice = once.unionByName(once.withColumn("ingested_at", F.col("ingested_at") + F.expr("INTERVAL 1 MINUTE")))
    for fn in (aq.throughput_points, aq.latency_series, aq.worker_stats, aq.latency_summary):
        assert fn(once, DAY).collect() == fn(twice, DAY).collect()
    assert db.events_by_type(twice, DAY).first().cnt == 80
    assert db.events_by_type(twice, DAY, dedupe=True).first().cnt == 40


def test_sketches_are_close(spark, events):
    rows = [done(i % 60, 1 + (i * 7919) % 1000, job_id=f"j{i % 150}") for i in range(600)]
    df = events(*rows)
    whole = ru.finalise(ru.merge_minute_parts(ru.job_minute_stats(ru.rollup_input(df)), ["event_type"])).first()
    exact = aq.latency_summary(df, DAY).first()
    assert abs(whole.uniq_jobs - 150) <= 5
    assert whole.cnt == 600 and abs(whole.p95_ms - exact.p95_ms) / exact.p95_ms < 0.05
    approx = aq.latency_summary(df, DAY, approx=True).first()
    assert approx["count"] == 600 and abs(approx.p50_ms - exact.p50_ms) <= 2


def test_key_queries_do_not_sort_the_log(events):
    plan = aq.throughput_totals(events(done(1, 5)), DAY)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Window" not in plan and "SortAggregate" not in plan


def test_percentiles_count_nulls_on_the_way(spark):
    rows = [("some", v) for v in (5, 1, None, 3, None)] + [("none", None)] * 3 + [("full", 7)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    out = exact_percentiles(df, ["g"], "v", {"p50": 0.5}, count_name="n", mean_name="mean", null_name="nulls")
    assert sorted(map(tuple, out.collect()), key=str) == [("full", 7.0, 1, 7.0, 0), ("none", None, 0, None, 3), ("some", 3.0, 3, 3.0, 2)]
    (whole,) = exact_percentiles(df, [], "v", {"p50": 0.5}, count_name="n", null_name="nulls").collect()
    assert tuple(whole) == (4.0, 4, 5)


def test_latency_from_the_bins_of_minutes(spark, events):
    rng = np.random.default_rng(4)
    rows = [
        ("JOB_COMPLETED", at(2026, 1, 1 + i % 9, i % 24, i % 60), dict(event_id=f"e{i}", payload=f'{{"duration_ms":{int(v)}}}'))
        for i, v in enumerate(rng.lognormal(5, 2, 400) * (rng.random(400) > 0.1))
    ]
    log = events(*rows, *rows[::7], ("JOB_FAILED", at(2026, 1, 2), {}))
    bins = ru.minute_duration_bins(ru.rollup_input(log)).cache()
    for tr in (TimeRange(at(2026, 1, 1), at(2026, 1, 10)), TimeRange(at(2026, 1, 3, 5, 7), at(2026, 1, 4, 2, 1)), TimeRange(at(2025, 1, 1), at(2025, 1, 2))):
        assert ru.latency_summary(bins, log, tr).collect() == aq.latency_summary(log, tr).collect()
    # A bin at the far end occurs on one day, and only this day is read.
    top = bins.orderBy(F.desc("bin")).first()
    assert ru.days_of_bins(bins, [top.bin]) == [top.minute.date()]
