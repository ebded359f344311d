"""Exact removal of at-least-once copies.

Copies of an event share (event_type, event_time, event_id); the copy ingested last wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.schema import EVENT_KEY


def final_events(
    events: DataFrame, columns: Sequence[str] | None = None, key: Sequence[str] = EVENT_KEY
) -> DataFrame:
    """One row per key: the copy with the newest ``ingested_at``.

    ``columns`` names the columns wanted beside the key, so that only those are read and
    shuffled. Copies that also share ``ingested_at`` are told apart by the kept columns, which
    makes the choice repeatable. Spark keeps the best copy per key on the map side before the
    shuffle, so an event with very many copies does not make a hot task.
    """
    key = list(key)
    if columns is None:
        columns = [c for c in events.columns if c not in key]
    rest = [c for c in columns if c not in key]
    extra = [c for c in ("ingested_at",) if c not in rest]
    newest_first = [F.col("ingested_at").desc()] + [F.col(c).desc() for c in rest if c != "ingested_at"]
    w = Window.partitionBy(*key).orderBy(*newest_first)
    return (
        events.select(*key, *rest, *extra)
        .withColumn("_copy", F.row_number().over(w))
        .filter("_copy = 1")
        .drop("_copy", *extra)
    )


def final_keys(events: DataFrame, key: Sequence[str] = EVENT_KEY) -> DataFrame:
    """The distinct keys.

    Enough for every query that only reads key columns: a hash aggregate without sorting, with
    copies removed before the shuffle.
    """
    return events.select(*key).distinct()


def count_events(events: DataFrame, event_type: str | None = None) -> DataFrame:
    """Number of events without copies, optionally of one type."""
    if event_type is not None:
        events = events.filter(F.col("event_type") == event_type)
    return final_keys(events).agg(F.count(F.lit(1)).alias("events"))


def create_final_view(events: DataFrame, name: str = "events_final") -> DataFrame:
    """Register the deduplicated log for SQL users."""
    view = final_events(events)
    view.createOrReplaceTempView(name)
    return view
