"""Distinct jobs of any range, exact, from rows per minute that add up.

Jobs are numbered in the order in which they first occur, so that the jobs of a minute have near numbers and fill few
bitmaps of 32,768 bits. A minute's row holds the bitmap of one stretch of numbers; bitmaps of several minutes are merged
with OR, which counts no job twice. The numbers are a table that only grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.functions.scalar import minute
from jobtrail.operators.ranking import rank_rows
from jobtrail.operators.timerange import TimeRange, within


def number_jobs(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(job_id, job_no) of the jobs of ``events`` that are not in ``known``, numbered on from there.

    Numbers go by first event, then id: range partitioning and offsets per task, no window over all jobs.
    """
    firsts = events.filter("job_id != ''").groupBy("job_id").agg(F.min("event_time").alias("_first"))
    start = 0
    if known is not None:
        firsts = firsts.join(known.select("job_id"), "job_id", "left_anti")
        start = known.agg(F.coalesce(F.max("job_no"), F.lit(0))).first()[0]
    ranked = rank_rows(firsts, [], [F.col("_first"), F.col("job_id")], "_rank")
    return ranked.select("job_id", (F.col("_rank") + start).alias("job_no"))


def minute_jobs(events: DataFrame, numbers: DataFrame) -> DataFrame:
    """(minute, event_type, stretch, jobs): the jobs of each minute and type as bitmaps. Copies change nothing."""
    seen = events.filter("job_id != ''").select(minute().alias("minute"), "event_type", "job_id").distinct()
    numbered = seen.join(numbers, "job_id")
    return numbered.groupBy("minute", "event_type", F.bitmap_bucket_number("job_no").alias("stretch")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("job_no")).alias("jobs")
    )


def merge_jobs(rows: DataFrame, *keys: str) -> DataFrame:
    """Bitmaps of coarser keys, such as hours, or of several parts of the table."""
    return rows.groupBy(*keys, "stretch").agg(F.bitmap_or_agg("jobs").alias("jobs"))


def distinct_jobs(rows: DataFrame, tr: TimeRange, *keys: str) -> DataFrame:
    """(keys, uniq_jobs): jobs with an event in the range, which begins and ends on minutes."""
    merged = merge_jobs(within(rows, tr, "minute"), *keys)
    counts = (merged.groupBy(*keys) if keys else merged).agg(F.sum(F.bitmap_count("jobs")).alias("uniq_jobs"))
    return counts if keys else counts.fillna(0, ["uniq_jobs"])
