from __future__ import annotations

import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from jobtrail.operators.schedules import with_next_run
from tests.conftest import UTC, at

INPUT = (
    "schedule struct<type:string,run_at:timestamp,delay:bigint,cron_expr:string,timezone:string>, "
    "from_time timestamp, no int"
)


def run(spark, rows):
    data = [((kind, run_at, delay, cron, tz), start, i) for i, (kind, run_at, delay, cron, tz, start) in enumerate(rows)]
    out = with_next_run(spark.createDataFrame(data, INPUT)).orderBy("no").collect()
    return [(r.next_run_at.astimezone(UTC) if r.next_run_at else None, r.schedule_error) for r in out]


def brute_force(fields, zone, start):
    """Minute by minute: the first instant whose local time fits."""
    minutes, hours, doms, months, dows, both = fields
    t = start.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(60 * 24 * 70):
        w = t.astimezone(zone)
        dom, dow = w.day in doms, (w.isoweekday() % 7) in dows
        day = (dom and dow) if both else (dom or dow)
        if w.minute in minutes and w.hour in hours and w.month in months and day:
            return t
        t += timedelta(minutes=1)
    return None


ALL = (set(range(60)), set(range(24)), set(range(1, 32)), set(range(1, 13)), set(range(7)))
CASES = {
    "* * * * *": (*ALL, True),
    "*/7 * * * *": (set(range(0, 60, 7)), *ALL[1:], True),
    "30 2 * * *": ({30}, {2}, *ALL[2:], True),
    "15 1,2 * * *": ({15}, {1, 2}, *ALL[2:], True),
    "0 9-17/4 * * mon-fri": ({0}, {9, 13, 17}, ALL[2], ALL[3], {1, 2, 3, 4, 5}, True),
    "5 4 13 * 5": ({5}, {4}, {13}, ALL[3], {5}, False),
    "0 0 */2 * 1": ({0}, {0}, set(range(1, 32, 2)), ALL[3], {1}, False),
    "59 23 28-31 FEB,mar,Oct *": ({59}, {23}, {28, 29, 30, 31}, {2, 3, 10}, ALL[4], True),
    "10/20 0 ? * SUN": ({10, 30, 50}, {0}, ALL[2], ALL[3], {0}, True),
}
ZONES = ["UTC", "America/New_York", "Europe/Paris", "Asia/Kolkata", "Australia/Lord_Howe"]


def test_against_brute_force(spark):
    rng = random.Random(7)
    rows, want = [], []
    # around clock changes and anywhere else in the spring and autumn of a year
    anchors = [at(2026, 3, 8, 5), at(2026, 11, 1, 4), at(2026, 3, 28, 23), at(2026, 10, 24, 23), at(2026, 4, 4, 13),
               at(2026, 10, 3, 13)]
    for cron, fields in CASES.items():
        for zone in ZONES:
            for anchor in anchors:
                start = anchor + timedelta(seconds=rng.randrange(0, 4 * 3600))
                hit = brute_force(fields, ZoneInfo(zone), start)
                if hit is not None:
                    rows.append(("recurring", None, None, cron, zone, start))
                    want.append(hit)
    got = run(spark, rows)
    wrong = [(r[3:], g, w) for r, g, w in zip(rows, got, want) if g != (w, None)]
    assert len(rows) > 200 and not wrong, wrong[:5]


def test_fixed_cases(spark):
    ten = at(2026, 1, 1, 10)
    cases = [
        (("recurring", None, None, "0 * * * *", "", ten), at(2026, 1, 1, 11)),
        (("recurring", None, None, "@hourly", "", ten), at(2026, 1, 1, 11)),
        (("recurring", None, None, "@weekly", "", ten), at(2026, 1, 4)),
        (("recurring", None, None, "@every 90m", "", ten + timedelta(milliseconds=300)), at(2026, 1, 1, 11, 30)),
        (("recurring", None, None, "@every 10ms", "", ten), at(2026, 1, 1, 10, 0, 1)),
        (("recurring", None, None, "0 0 29 2 *", "", ten), at(2028, 2, 29)),
        (("recurring", None, None, "0 0 31 * *", "", at(2026, 1, 31, 1)), at(2026, 3, 31)),
        (("recurring", None, None, "TZ=Asia/Tokyo 0 9 * * *", "UTC", ten), at(2026, 1, 2)),
        (("recurring", None, None, "0 0 30 2 *", "", ten), None),
        (("immediate", None, None, None, None, ten), ten),
        (("delayed", None, 60_000_000_000, None, None, ten), at(2026, 1, 1, 10, 1)),
        (("delayed", None, -5, None, None, ten), ten),
        (("one_time", at(2027, 1, 1), None, None, None, ten), at(2027, 1, 1)),
    ]
    assert run(spark, [c for c, _ in cases]) == [(w, None) for _, w in cases]


@pytest.mark.parametrize(
    "kind, cron, zone, text",
    [
        ("recurring", "", "", "cron_expr required for recurring"),
        ("recurring", "not a cron", "", "cron_expr: invalid expression"),
        ("recurring", "60 * * * *", "", "cron_expr: invalid expression"),
        ("recurring", "* * * * 7", "", "cron_expr: invalid expression"),
        ("recurring", "5-1 * * * *", "", "cron_expr: invalid expression"),
        ("recurring", "*/0 * * * *", "", "cron_expr: invalid expression"),
        ("recurring", "* * * *", "", "cron_expr: invalid expression"),
        ("recurring", "@sometimes", "", "cron_expr: invalid expression"),
        ("recurring", "@every x", "", "cron_expr: invalid expression"),
        ("recurring", "0 0 * * *", "Mars/Base", "timezone: unknown time zone Mars/Base"),
        ("one_time", None, None, "run_at required"),
        ("weekly", None, None, 'unknown schedule type "weekly"'),
        ("", None, None, 'unknown schedule type ""'),
    ],
)
def test_errors(spark, kind, cron, zone, text):
    ((when, error),) = run(spark, [(kind, None, None, cron, zone, at(2026, 1, 1))])
    assert when is None and error.startswith(text)


def test_each_expression_is_parsed_once_and_broadcast(spark):
    rows = [(("recurring", None, 0, f"{i % 3} * * * *", "UTC"), datetime(2026, 1, 1), i) for i in range(3000)]
    df = with_next_run(spark.createDataFrame(rows, INPUT).repartition(4))
    assert {r.next_run_at.minute for r in df.collect()} == {0, 1, 2}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin" in plan and "Python" not in plan.split("Initial Plan")[0]


@pytest.mark.parametrize("cron, start, want", [
    ("0 0 29 2 *", at(2097, 1, 1), None),  # 2100 is no leap year: none in five years
    ("0 0 29 2 *", at(2026, 3, 1), at(2028, 2, 29)),
    ("59 23 31 12 *", at(2026, 12, 31, 23, 59), at(2027, 12, 31, 23, 59)),
    ("0 0 31 */2 *", at(2026, 1, 31), at(2026, 3, 31)),
    ("0 0 31 4,6,9,11 *", at(2026, 1, 1), None),
    ("0 12 1 1 mon", at(2026, 1, 1, 12), at(2026, 1, 5, 12)),
    ("*/59 */23 * * *", at(2026, 5, 5, 23, 58), at(2026, 5, 5, 23, 59)),
])
def test_far_and_edge_runs(spark, cron, start, want):
    assert run(spark, [("recurring", None, 0, cron, "", start)]) == [(want, None)]


def test_columns_of_any_name_and_rows_without_schedule(spark):
    rows = [(("recurring", None, 0, "0 1 * * *", None), datetime(2026, 1, 1), i) for i in range(3)] + [(None, None, 9)]
    df = spark.createDataFrame(rows, INPUT).selectExpr("*", "no AS key", "no AS cron_expr", "no AS timezone", "no AS k")
    out = with_next_run(df)
    assert out.columns == [*df.columns, "schedule_error", "next_run_at"] and out.count() == 4
