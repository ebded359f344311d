"""Retention: rows past their age are not read; whole expired day folders can be dropped."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.operators.timerange import UTC, instant

# Days each table is kept. None keeps rows for good.
RETENTION_DAYS = {
    "events": 30,
    "job_minute_stats": 90,
    "worker_minute_stats": 90,
    "failure_minute_stats": 90,
    "job_hourly_stats": 365,
    "job_daily_stats": None,
}


def retain(df: DataFrame, time_col: str, days: int | None, now: datetime, day_col: str = "event_day") -> DataFrame:
    """Rows that have not expired: time + days > now."""
    if days is None:
        return df
    cut = now - timedelta(days=days)
    cond = F.col(time_col) > instant(cut)
    if day_col in df.columns and day_col != time_col:
        cond = (F.col(day_col) >= F.lit(cut.astimezone(UTC).date().isoformat()).cast("date")) & cond
    return df.filter(cond)


def expired_days(df: DataFrame, days: int, now: datetime, day_col: str = "event_day") -> DataFrame:
    """Distinct day folders that hold expired rows only."""
    cut = (now - timedelta(days=days)).astimezone(UTC).date()
    return df.select(day_col).filter(F.col(day_col) < F.lit(cut.isoformat()).cast("date")).distinct()


def day_folders(spark: SparkSession, path: str, day_col: str = "event_day") -> dict[date, object]:
    """The day folders of a table, by listing them; no data is read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return {}
    found = {}
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{day_col}=") and name[-10:].count("-") == 2:
            found[date.fromisoformat(name[-10:])] = status.getPath()
    return found


def drop_expired(spark: SparkSession, path: str, days: int | None, now: datetime, day_col: str = "event_day") -> list[date]:
    """Remove the folders of days that hold expired rows only; the days removed. None keeps all."""
    if days is None:
        return []
    cut = (now - timedelta(days=days)).astimezone(UTC).date()
    gone = {d: p for d, p in day_folders(spark, path, day_col).items() if d < cut}
    for folder in gone.values():
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    spark.catalog.refreshByPath(path)
    return sorted(gone)
