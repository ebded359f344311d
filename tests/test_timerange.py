from __future__ import annotations

from datetime import timedelta

import pytest

from jobtrail.operators.timerange import TimeRange, anomaly_windows, parse_duration, parse_range, within
from tests.conftest import at

NOW = at(2026, 1, 1, 12)
HOUR = timedelta(hours=1)


def test_default_width():
    tr = parse_range("", "", HOUR, NOW)
    assert tr == TimeRange(NOW - HOUR, NOW)
    assert parse_range("", "", HOUR).seconds >= 50 * 60


def test_explicit_bounds():
    tr = parse_range("2026-01-01T00:00:00Z", "2026-01-01T01:00:00Z", HOUR, NOW)
    assert (tr.start.hour, tr.end.hour) == (0, 1)
    assert parse_range("2026-01-01T05:30:00.123456789+05:30", "", HOUR, NOW).start == at(2026, 1, 1, 0, 0, 0, 123456)
    # only the end given: the start is still counted from now
    assert parse_range("", "2026-01-01T11:30:00Z", HOUR, NOW).start == NOW - HOUR


@pytest.mark.parametrize("lo, hi", [("nope", ""), ("", "x"), ("2026-01-01T02:00:00Z", "2026-01-01T01:00:00Z"),
                                    ("2026-01-01", ""), ("2026-01-01T01:00:00Z", "2026-01-01T01:00:00Z")])
def test_bad_ranges(lo, hi):
    with pytest.raises(ValueError):
        parse_range(lo, hi, HOUR, NOW)


def test_durations():
    assert parse_duration("1h30m") == timedelta(minutes=90)
    assert parse_duration("1.5s") == timedelta(seconds=1.5)
    for bad in ("", "5", "m", "5x"):
        with pytest.raises(ValueError):
            parse_duration(bad)


def test_anomaly_windows():
    quarter = timedelta(minutes=15)
    assert anomaly_windows(now=NOW)[0] == TimeRange(NOW - quarter, NOW)
    assert anomaly_windows("bad", now=NOW)[1] == TimeRange(NOW - 2 * quarter, NOW - quarter)
    cur, base = anomaly_windows("1h", "2026-01-01T03:00:00Z", "2026-01-01T05:00:00Z", NOW)
    assert (cur.start, base.start, base.end) == (at(2026, 1, 1, 3), at(2026, 1, 1, 1), at(2026, 1, 1, 3))
    # an invalid range falls back, an end alone is ignored
    assert anomaly_windows("1h", "zzz", now=NOW)[0] == TimeRange(NOW - HOUR, NOW)
    assert anomaly_windows("1h", "", "2026-01-01T05:00:00Z", NOW)[0].end == NOW


def test_window_is_half_open(events):
    df = events(("A", at(2026, 1, 1)), ("B", at(2026, 1, 2)), ("C", at(2025, 12, 31, 23, 59, 59)))
    rows = within(df, TimeRange(at(2026, 1, 1), at(2026, 1, 2))).collect()
    assert [r.event_type for r in rows] == ["A"]
