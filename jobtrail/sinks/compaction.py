"""Merging the small files of the event log.

A stream appends a few files to a day's folder with every batch. ``merge_days`` writes the days named anew, sorted and in
few files, next to the files they come from, and lists those in ``path``/_merged; ``remove_merged`` deletes the listed
files later, when no reader holds them any more. In between each row is there twice, as if it had been delivered twice:
all readers count an event once, so no reader has to know. A merge that breaks off before its list is written leaves such
copies, too, and the next merge of the day removes them.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.operators.dedupe import final_events
from jobtrail.schema import EVENT, EVENT_COLUMNS
from jobtrail.sinks.event_log import read_events, write_sorted
from jobtrail.streaming.storage import exists, names, remove



def merge_days(spark: SparkSession, path: str, days: list[date], least: int = 2) -> int:
    """Merge the files of some days that have ``least`` files or more; the number of files merged.

    Copies of an event are cut to the newest one. Days should be closed: what is appended while a day is merged stays
    in files of its own. The driver holds the names of the files merged, never rows.
    """
    if not days:
        return 0
    per_day = {}
    for d in days:
        listed = [f for f in names(spark, f"{path}/event_day={d}") if f.endswith(".parquet")]
        if len(listed) >= least:
            per_day[d] = [f"{path}/event_day={d}/{f}" for f in listed]
    old = [f for listed in per_day.values() for f in listed]
    if not old:
        return 0
    # Exactly the listed files are read: what is appended meanwhile is neither merged nor removed.
    rows = spark.read.schema(EVENT).parquet(*old)
    write_sorted(final_events(rows).select(*EVENT_COLUMNS), path)
    listing = spark.createDataFrame([(f,) for f in old], "file string").coalesce(1)
    listing.write.parquet(f"{path}/_merged/{uuid.uuid4().hex}")
    return len(old)


def remove_merged(spark: SparkSession, path: str) -> int:
    """Delete the files that merges have replaced; their number. Repeating it after a crash does no harm."""
    gone = 0
    for n in names(spark, f"{path}/_merged"):
        if not exists(spark, f"{path}/_merged/{n}/_SUCCESS"):
            continue  # a merge that broke off: its files stay
        for r in spark.read.schema("file string").parquet(f"{path}/_merged/{n}").collect():
            gone += exists(spark, r.file)
            remove(spark, r.file)
        remove(spark, f"{path}/_merged/{n}")
    spark.catalog.refreshByPath(path)
    return gone


def files_per_day(spark: SparkSession, path: str) -> DataFrame:
    """(event_day, files, rows) of the log, to choose days by."""
    rows = read_events(spark, path).select("event_day", F.col("_metadata.file_path").alias("_file"))
    per_file = rows.groupBy("event_day", "_file").agg(F.count(F.lit(1)).alias("_rows"))
    return per_file.groupBy("event_day").agg(F.count(F.lit(1)).alias("files"), F.sum("_rows").alias("rows"))
