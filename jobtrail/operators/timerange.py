"""Time windows: parsing, defaults and the filter that prunes partitions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UTC = timezone.utc

# Default window widths of the analytics queries.
DEFAULT_WIDTH = {
    "throughput": timedelta(hours=1),
    "latency": timedelta(hours=1),
    "failures": timedelta(hours=1),
    "workers": timedelta(hours=1),
    "queue": timedelta(hours=1),
    "scheduler": timedelta(hours=24),
    "capacity": timedelta(hours=24),
    "anomalies": timedelta(minutes=15),
    "dashboard": timedelta(hours=6),
}

_RFC3339 = re.compile(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$")


@dataclass(frozen=True)
class TimeRange:
    """Half-open window [start, end)."""

    start: datetime
    end: datetime

    @property
    def seconds(self) -> float:
        return (self.end - self.start).total_seconds()

    def before(self) -> "TimeRange":
        """The window of the same width that ends where this one starts."""
        return TimeRange(self.start - (self.end - self.start), self.start)


def parse_rfc3339(text: str) -> datetime:
    if not _RFC3339.match(text):
        raise ValueError(f"not an RFC 3339 time: {text!r}")
    # datetime keeps microseconds; further digits are cut.
    text = re.sub(r"[.,](\d{1,6})\d*", r".\1", text)
    return datetime.fromisoformat(text.replace("Z", "+00:00")).astimezone(UTC)


def parse_range(start: str, end: str, width: timedelta, now: datetime | None = None) -> TimeRange:
    """Explicit bounds override [now - width, now) one by one; the end must be after the start."""
    now = now or datetime.now(UTC)
    lo = parse_rfc3339(start) if start else now - width
    hi = parse_rfc3339(end) if end else now
    if hi <= lo:
        raise ValueError("the end must be after the start")
    return TimeRange(lo, hi)


_UNIT = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_PART = re.compile(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)")


def parse_duration(text: str) -> timedelta:
    """Durations such as ``15m`` or ``1h30m``."""
    body = text.strip()
    sign = -1 if body.startswith("-") else 1
    body = body.lstrip("+-")
    if body == "0":
        return timedelta(0)
    parts = _PART.findall(body)
    if not parts or "".join(n + u for n, u in parts) != body:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(seconds=sign * sum(float(n) * _UNIT[u] for n, u in parts))


def anomaly_windows(
    window: str = "", start: str = "", end: str = "", now: datetime | None = None
) -> tuple[TimeRange, TimeRange]:
    """(current, baseline) windows.

    Without ``start`` the current window is the last ``window`` (15 minutes when absent or
    unreadable) and the baseline the one before. With ``start`` it is [start, end) against the
    same span before it. An invalid explicit range falls back to the default windows.
    """
    now = now or datetime.now(UTC)
    width = DEFAULT_WIDTH["anomalies"]
    if window:
        try:
            width = parse_duration(window)
        except ValueError:
            pass
    current = TimeRange(now - width, now)
    if start:
        try:
            current = parse_range(start, end, width, now)
        except ValueError:
            pass
    return current, current.before()


def instant(value: datetime) -> Column:
    """A timestamp literal with microsecond precision, whatever the session time zone."""
    if value.tzinfo is None:
        value = value.replace(tzinfo=UTC)
    micros = (value - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def within(df: DataFrame, tr: TimeRange, time_col: str = "event_time", day_col: str = "event_day") -> DataFrame:
    """Rows in [start, end). On a table partitioned by day the day bound prunes folders."""
    cond = (F.col(time_col) >= instant(tr.start)) & (F.col(time_col) < instant(tr.end))
    if day_col in df.columns:
        lo, hi = (t.astimezone(UTC).date().isoformat() for t in (tr.start, tr.end))
        cond = (F.col(day_col) >= F.lit(lo).cast("date")) & (F.col(day_col) <= F.lit(hi).cast("date")) & cond
    return df.filter(cond)


def within_closed(df: DataFrame, tr: TimeRange, time_col: str = "event_time", day_col: str = "event_day") -> DataFrame:
    """Rows in [start, end], the dashboard convention."""
    widened = within(df, TimeRange(tr.start, tr.end + timedelta(milliseconds=1)), time_col, day_col)
    return widened.filter(F.col(time_col) <= instant(tr.end))
