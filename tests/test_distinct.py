"""Distinct jobs from bitmaps against sets."""

from __future__ import annotations

import random
from datetime import timedelta

from pyspark.sql import functions as F

from jobtrail.operators.distinct import distinct_jobs, merge_jobs, minute_jobs, number_jobs
from jobtrail.operators.timerange import TimeRange
from tests.conftest import at


def test_distinct_jobs_of_any_range(spark, events):
    rng, begin = random.Random(5), at(2026, 1, 1)
    rows = [
        (rng.choice(["JOB_QUEUED", "JOB_STARTED"]), begin + timedelta(seconds=rng.randrange(7200)), dict(event_id=f"e{i}", job_id=f"j{rng.randrange(90)}"))
        for i in range(600)
    ]
    first, second = rows[:350] + [("WORKER_HEARTBEAT", begin, {})], rows[300:]
    numbers = number_jobs(events(*first))
    more = number_jobs(events(*second), numbers)
    both = numbers.unionByName(more)
    assert sorted(r.job_no for r in both.collect()) == list(range(1, len({m["job_id"] for _, _, m in rows}) + 1))
    # Two parts of the table that overlap in events.
    table = minute_jobs(events(*first), numbers).unionByName(minute_jobs(events(*second), both))
    for lo, hi in ((0, 120), (7, 8), (13, 90), (119, 120)):
        tr = TimeRange(begin + timedelta(minutes=lo), begin + timedelta(minutes=hi))
        inside = [(k, m["job_id"]) for k, t, m in rows if tr.start <= t < tr.end]
        assert distinct_jobs(table, tr).first().uniq_jobs == len({j for _, j in inside})
        assert {r.event_type: r.uniq_jobs for r in distinct_jobs(table, tr, "event_type").collect()} == {
            kind: len({j for k, j in inside if k == kind}) for kind in {k for k, _ in inside}
        }
    hours = merge_jobs(table.withColumn("hour", F.date_trunc("hour", "minute")), "hour")
    assert hours.count() == 2
    nothing = TimeRange(begin - timedelta(days=1), begin)
    assert distinct_jobs(table, nothing).first().uniq_jobs == 0 and distinct_jobs(table, nothing, "event_type").isEmpty()
