"""Job states followed on the stream of events, for as long as a job is alive.

Each job's fold is kept in the state store. Once a job has ended and nothing more came in for a while, a timer lets go of
it; the rows written so far stay. The fold is made of minima and maxima, so copies, events out of order and events of a
job that was let go all give the result of the batch query: readers merge the rows of a job the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from jobtrail.operators.lifecycle import EVENT_STATE, event_rank, state_of_rank
from jobtrail.schema import TERMINAL_JOB_STATES
from jobtrail.streaming.ingest import start
from jobtrail.streaming.parts import fold, read_parts

# The fold of a job: newest event as time * 16 + rank, and times in microseconds, with how two values merge.
MERGE = {"last": max, "attempts": max, "created": min, "queued": max, "started": max, "updated": max}
FOLD = ", ".join(f"{c} bigint" for c in MERGE)
ARRIVED = "arrived"
# Ranks of the events that end a job.
ENDED = {rank for rank, (_, state) in enumerate(EVENT_STATE) if state in TERMINAL_JOB_STATES}


def _fold_columns(events: DataFrame) -> DataFrame:
    """The fold of each single event."""
    at = F.unix_micros("event_time")
    of = lambda kind: F.when(F.col("event_type") == kind, at)
    return events.select(
        "job_id",
        (F.unix_millis("event_time") * 16 + event_rank()).alias("last"),
        F.col("attempt").alias("attempts"),
        of("JOB_CREATED").alias("created"),
        of("JOB_QUEUED").alias("queued"),
        of("JOB_STARTED").alias("started"),
        at.alias("updated"),
        F.unix_millis("_arrived").alias(ARRIVED),
    ).filter("job_id != '' AND last IS NOT NULL")


def _one_row_per_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the events of each Arrow batch, so that a job with very many events is no hot task."""
    for batch in batches:
        folded = pa.Table.from_batches([batch]).group_by("job_id").aggregate([(c, f.__name__) for c, f in MERGE.items()] + [(ARRIVED, "max")])
        yield from folded.rename_columns(["job_id", *MERGE, ARRIVED]).combine_chunks().to_batches()


class JobFold(StatefulProcessor):
    """Merges the rows of a job into its state and gives the state after each batch.

    ``until`` is the time of the timer that ends the state of a job, null while the job is alive.
    """

    def __init__(self, keep: timedelta):
        self.keep_ms = round(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", f"{FOLD}, until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        *fold, until = self.state.get() if self.state.exists() else [None] * (len(MERGE) + 1)
        arrived = 0
        for row in rows:
            fold = [b if a is None else a if b is None else f(a, b) for f, a, b in zip(MERGE.values(), fold, row[1:])]
            arrived = max(arrived, row[-1])
        if until is not None:
            self.handle.deleteTimer(until)
            until = None
        if fold[0] % 16 in ENDED:
            until = arrived + self.keep_ms
            self.handle.registerTimer(until)
        self.state.update((*fold, until))
        yield Row(job_id=key[0], **dict(zip(MERGE, fold)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def start_job_states(
    events: DataFrame, path: str, checkpoint: str, interval: str | None = "10 seconds", keep: timedelta = timedelta(days=1)
) -> StreamingQuery:
    """Write the jobs that had events in each batch. A retried batch replaces its own rows.

    The state of an ended job is let go when no event of it came in for ``keep``, by the times at which batches came in:
    they are the watermark, so no event is too old.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    schema = f"job_id string, {FOLD}"
    arriving = events.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", "0 seconds")
    per_job = _fold_columns(arriving).mapInArrow(_one_row_per_job, f"{schema}, {ARRIVED} bigint").groupBy("job_id")
    followed = per_job.transformWithState(JobFold(keep), schema, "append", "EventTime")
    return start(followed.writeStream.foreachBatch(run), checkpoint, interval)


def merge_states(rows: DataFrame) -> DataFrame:
    """One fold per job."""
    return rows.groupBy("job_id").agg(*[(F.min if f is min else F.max)(c).alias(c) for c, f in MERGE.items()])


def fold_job_states(spark: SparkSession, path: str) -> int:
    """Merge the parts written so far to one row per job; may run while the stream writes and others read."""
    return fold(spark, path, merge_states, f"job_id string, {FOLD}")


def read_job_states(spark: SparkSession, path: str) -> DataFrame:
    """State, attempts and times of each job, ended ones included."""
    return merge_states(read_parts(spark, path, f"job_id string, {FOLD}")).select(
        "job_id",
        state_of_rank(F.pmod("last", F.lit(16))).alias("state"),
        "attempts",
        F.timestamp_micros("created").alias("created_at"),
        F.timestamp_micros("queued").alias("queued_at"),
        F.timestamp_micros("started").alias("started_at"),
        F.timestamp_micros("updated").alias("updated_at"),
    )
