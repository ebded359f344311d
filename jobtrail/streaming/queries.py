"""Streams as named queries: each works off the generated tables and reads what it wrote."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.functions.scalar import month
from jobtrail.operators.dedupe import final_events
from jobtrail.operators.overdue import life_marks, run_marks
from jobtrail.operators.retention import RETENTION_DAYS, day_folders, drop_expired
from jobtrail.operators.timerange import UTC
from jobtrail.schema import EVENT
from jobtrail.session import work_folder
from jobtrail.sinks.compaction import files_per_day, merge_days, remove_merged
from jobtrail.sinks.event_log import append_events, read_events, write_sorted
from jobtrail.sinks.lookup import find_events, index_log
from jobtrail.sinks.outbox import event_json
from jobtrail.sources import testdata as td
from jobtrail.streaming.gate import closed_until, dedupe_stream, read_late, start_gate, stream_on_time
from jobtrail.streaming.ingest import start, start_ingest
from jobtrail.streaming.live import (
    read_live_minutes,
    read_never_started,
    read_queue_waits,
    start_live_minutes,
    start_queue_waits,
)
from jobtrail.streaming.overdue import read_overdue, start_overdue
from jobtrail.streaming.parts import sweep
from jobtrail.streaming.rollups import (
    backfill,
    fold_deltas,
    late_events,
    read_deltas,
    read_rollup,
    start_deltas,
    start_exact,
)
from jobtrail.streaming.states import read_job_states, start_job_states
from jobtrail.streaming.storage import names, remove

# The generated events span a month; copies may be that far apart in a replay.
DELAY = timedelta(days=40)
NOW = datetime(2024, 2, 10, 12, tzinfo=UTC)
# A moment at which the log still keeps all of the generated days.
MONTH_END = datetime(2024, 1, 30, 23, tzinfo=UTC)
# Well behind the last watermark of the generated events.
WAITS_UNTIL = datetime(2024, 1, 24, tzinfo=UTC)
MESSAGE = "value string, source_time timestamp"
# A batch of a stream's input with more rows is written by more tasks, a file each.
FILE_ROWS = 250_000


def _in_batches(rows: DataFrame, folder: str, run: Callable[[], None]) -> None:
    """Deliver rows as four files in two rounds, regardless of time; ``run`` works off what is there.

    The stream is started anew for the second round, and takes one file per batch.
    """
    columns = list(rows.columns)
    dealt = rows.withColumn("_file", F.pmod(F.xxhash64(*columns), F.lit(4)))
    for part in (dealt.filter("_file < 2"), dealt.filter("_file >= 2")):
        part.repartition(2, "_file").drop("_file").write.mode("append").parquet(folder)
        run()


def _stream(s: SparkSession, folder: str, schema: str, files: int = 1) -> DataFrame:
    return s.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def stream_ingest(s: SparkSession, d: str) -> DataFrame:
    root = work_folder(s, "ingest")

    def run() -> None:
        messages = _stream(s, f"{root}/in", MESSAGE)
        start_ingest(messages, f"{root}/log", f"{root}/rejects", f"{root}/ck", None, lambda: NOW).awaitTermination()

    _in_batches(td.event_messages(s, d), f"{root}/in", run)
    # The unset ids of this data are hashed, so events are told apart by what they carry.
    log = final_events(read_events(s, f"{root}/log"))
    return log.groupBy(F.to_date("event_time").alias("event_day"), "event_type").agg(F.count(F.lit(1)).alias("cnt"))


def _in_order(rows: DataFrame, folder: str, run: Callable[[int], None]) -> None:
    """Deliver rows as four batches in two rounds, days roughly in order: some are up to two days late.

    Copies of an event may be in batches of their own. All batches have as many files; ``run`` is told how many.
    """
    minutes_late = F.expr("timestampdiff(MINUTE, event_time, ingested_at)")
    shift = F.pmod(F.col("event_id").cast("bigint") + minutes_late, F.lit(3))
    batch = F.least(F.lit(3), F.floor((F.dayofmonth("event_time") - 1 + shift) / 8))
    s, staged, numbered = rows.sparkSession, f"{folder}-dealt", rows.withColumn("_batch", batch.cast("int"))
    # Rows are worked out once, by all tasks; small row groups, so that all tasks read them again.
    numbered.write.partitionBy("_batch").option("parquet.block.size", 16 << 20).parquet(staged)
    dealt = s.read.schema(numbered.schema).parquet(staged)
    parts = [dealt.filter(F.col("_batch") == n).drop("_batch") for n in range(4)]
    largest = dealt.groupBy("_batch").count().agg(F.max("count")).first()[0] or 0
    files = max(1, min(-(-largest // FILE_ROWS), max(part.rdd.getNumPartitions() for part in parts)))
    for n, part in enumerate(parts):
        part.coalesce(files).write.mode("append").parquet(folder)
        # A small batch may fill fewer files; the stream counts them.
        for _ in range(files * (n + 1) - sum(name.endswith(".parquet") for name in names(s, folder))):
            part.limit(0).coalesce(1).write.mode("append").parquet(folder)
        remove(s, f"{staged}/_batch={n}")
        if n % 2:
            run(files)


def _gated(s: SparkSession, root: str, delay: timedelta, files: int = 1) -> DataFrame:
    """Work off the events in ``root``/in with the gate; the stream behind it."""
    start_gate(_stream(s, f"{root}/in", EVENT, files), f"{root}/gate", f"{root}/ck-gate", delay, None).awaitTermination()
    return stream_on_time(s, f"{root}/gate")


def stream_dedupe(s: SparkSession, d: str) -> DataFrame:
    root = work_folder(s, "dedupe")

    def run() -> None:
        rows = dedupe_stream(_gated(s, root, DELAY), "40 days")
        start(rows.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/ck", None).awaitTermination()

    _in_batches(td.events(s, d), f"{root}/in", run)
    return s.read.parquet(f"{root}/out").select("event_type", "event_time", "event_id", "job_id", "worker_id")


def late_copies(s: SparkSession, d: str) -> DataFrame:
    """Events once each, from a stream whose delay is too short for the order they come in, and those it lists."""
    root = work_folder(s, "late-copies")
    delay = timedelta(hours=12)

    def run(files: int) -> None:
        rows = dedupe_stream(_gated(s, root, delay, files), "12 hours")
        start(rows.writeStream.format("parquet").option("path", f"{root}/out"), f"{root}/ck", None).awaitTermination()

    _in_order(td.events(s, d), f"{root}/in", run)
    columns = ["event_type", "event_time", "event_id", "job_id", "worker_id"]
    return s.read.parquet(f"{root}/out").select(*columns).unionByName(read_late(s, f"{root}/gate").select(*columns))


def live_minutes(s: SparkSession, d: str) -> DataFrame:
    """Minutes that a stream of a day's delay has closed, late events added."""
    root = work_folder(s, "live")
    delay = timedelta(days=1)

    def run(files: int) -> None:
        start_live_minutes(_gated(s, root, delay, files), f"{root}/minutes", f"{root}/ck", "1 day", None).awaitTermination()

    _in_order(td.events(s, d), f"{root}/in", run)
    closed = closed_until(s, f"{root}/gate", delay)  # one row
    rows = read_live_minutes(s, f"{root}/minutes", f"{root}/gate").join(closed, F.lit(True))
    return rows.filter(F.col("minute") + F.expr("INTERVAL 1 MINUTE") <= F.col("closed_until")).drop("closed_until")


def _queue_waits(s: SparkSession, d: str) -> str:
    root = work_folder(s, "waits")

    def run(files: int) -> None:
        sides = [_stream(s, f"{root}/in", EVENT, files) for _ in range(2)]
        start_queue_waits(*sides, f"{root}/waits", f"{root}/ck", "3 days", "12 hours", None).awaitTermination()

    _in_order(td.events(s, d), f"{root}/in", run)
    return f"{root}/waits"


def _overdue(s: SparkSession, d: str, purpose: str, marks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    root = work_folder(s, purpose)

    def run(files: int) -> None:
        found = marks(_stream(s, f"{root}/in", EVENT, files))
        start_overdue(found, f"{root}/out", f"{root}/ck", "3 days", None).awaitTermination()

    _in_order(td.events(s, d), f"{root}/in", run)
    return read_overdue(s, f"{root}/out")


def _run_marks(events: DataFrame) -> DataFrame:
    return run_marks(events, timedelta(hours=6))


def _life_marks(events: DataFrame) -> DataFrame:
    return life_marks(events, timedelta(hours=18), timedelta(hours=6))


def _messages(events: DataFrame) -> DataFrame:
    return events.select(event_json().alias("value"), F.col("ingested_at").alias("source_time"))


def _exact(s: SparkSession, root: str, now: datetime) -> Callable[[], None]:
    """Work off the messages in ``root``/in with the exact stream."""
    paths = [f"{root}/{name}" for name in ("log", "rejects", "rollups", "ck")]
    return lambda: start_exact(s, _stream(s, f"{root}/in", MESSAGE), *paths, None, lambda: now).awaitTermination()


def exact_rollups(name: str) -> Callable[[SparkSession, str], DataFrame]:
    keep = {"job_minute_stats": ["minute"], "worker_minute_stats": ["minute", "worker_id"]}[name]
    cols = [*keep, "event_type", "cnt", "duration_sum", "duration_count"]

    def run(s: SparkSession, d: str) -> DataFrame:
        root = work_folder(s, "exact")
        _in_batches(_messages(td.with_uuids(td.events(s, d))), f"{root}/in", _exact(s, root, MONTH_END))
        return read_rollup(s, f"{root}/rollups", name).select(*cols)

    return run


def _after_expiry(s: SparkSession, d: str) -> str:
    """Rollups of a log that has dropped its oldest days, after copies of all its events, old and new, came in."""
    root = work_folder(s, "expiry")
    log = td.with_uuids(td.events(s, d))
    write_sorted(log, f"{root}/log")
    backfill(s, f"{root}/log", f"{root}/rollups")
    drop_expired(s, f"{root}/log", RETENTION_DAYS["events"], NOW)
    _in_batches(_messages(log), f"{root}/in", _exact(s, root, NOW))
    return f"{root}/rollups"


def late_after_expiry(s: SparkSession, d: str) -> DataFrame:
    rows = read_rollup(s, _after_expiry(s, d), "job_minute_stats")
    return rows.select("minute", "event_type", "cnt", "duration_sum", "duration_count")


def listed_late(s: SparkSession, d: str) -> DataFrame:
    """Old events that a stream was given, per day: all of the log, of which the oldest days have expired."""
    root = work_folder(s, "late")
    _in_batches(_messages(td.with_uuids(td.events(s, d))), f"{root}/in", _exact(s, root, NOW))
    rows = late_events(s, f"{root}/rollups")
    return rows.groupBy(F.to_date("event_time").alias("event_day")).agg(F.count(F.lit(1)).alias("cnt"))


def delta_rollups(s: SparkSession, d: str) -> DataFrame:
    root = work_folder(s, "deltas")

    def run() -> None:
        start_deltas(_gated(s, root, DELAY), f"{root}/parts", f"{root}/ck", "40 days", None).awaitTermination()

    _in_batches(td.events(s, d), f"{root}/in", run)
    return read_deltas(s, f"{root}/parts", f"{root}/gate").drop("uniq_jobs", "durations")


def folded_deltas(s: SparkSession, d: str) -> DataFrame:
    """The delta table, folded after each round of parts and swept in between."""
    root = work_folder(s, "folded")

    def run() -> None:
        sweep(s, f"{root}/parts")
        start_deltas(_gated(s, root, DELAY), f"{root}/parts", f"{root}/ck", "40 days", None).awaitTermination()
        fold_deltas(s, f"{root}/parts")

    _in_batches(td.events(s, d), f"{root}/in", run)
    return read_deltas(s, f"{root}/parts", f"{root}/gate").drop("uniq_jobs", "durations")


def merged_log(s: SparkSession, d: str) -> DataFrame:
    """Rows and files per day of a log that batches have written, after its files were merged."""
    root = work_folder(s, "merged")
    rows = td.events(s, d)
    for k in range(3):
        append_events(rows.filter(F.pmod(F.xxhash64("event_id", "ingested_at"), F.lit(3)) == k), f"{root}/log")
    merge_days(s, f"{root}/log", sorted(day_folders(s, f"{root}/log")))
    remove_merged(s, f"{root}/log")
    return files_per_day(s, f"{root}/log").select("event_day", F.col("rows").alias("cnt"))


def one_job(s: SparkSession, d: str) -> DataFrame:
    """The events of one job, read from the files that an index names."""
    root = work_folder(s, "lookup")
    write_sorted(td.events(s, d), f"{root}/log")
    index_log(s, f"{root}/log", f"{root}/index")
    job = td.events(s, d).filter("job_id != ''").agg(F.min("job_id")).first()[0]
    found = find_events(s, f"{root}/log", f"{root}/index", "job_id", job)
    return found.select("job_id", "event_type", "event_time", "event_id", "ingested_at")


def backfilled(name: str, at: str, measures: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        root = work_folder(s, "backfill")
        write_sorted(td.events(s, d), f"{root}/log")
        backfill(s, f"{root}/log", f"{root}/rollups")
        return read_rollup(s, f"{root}/rollups", name).select(at, "event_type", *measures)

    return run


def stream_states(s: SparkSession, d: str) -> DataFrame:
    root = work_folder(s, "states")

    def run() -> None:
        start_job_states(_stream(s, f"{root}/in", EVENT), f"{root}/states", f"{root}/ck", None).awaitTermination()

    _in_batches(td.events(s, d), f"{root}/in", run)
    return read_job_states(s, f"{root}/states")


def trimmed_log(s: SparkSession, d: str) -> DataFrame:
    """What is left of a written log when its expired days have been dropped."""
    root = work_folder(s, "trimmed")
    write_sorted(td.events(s, d), f"{root}/log")
    drop_expired(s, f"{root}/log", RETENTION_DAYS["events"], NOW)
    return read_events(s, f"{root}/log").groupBy("event_day").agg(F.count(F.lit(1)).alias("cnt"))


def written_log(s: SparkSession, d: str) -> DataFrame:
    root = work_folder(s, "log")
    write_sorted(td.events(s, d), f"{root}/log")
    log = read_events(s, f"{root}/log")
    return log.groupBy(month("event_time").alias("month"), "event_day").agg(F.count(F.lit(1)).alias("cnt"))


def log_by_worker(s: SparkSession, d: str) -> DataFrame:
    """The second copy of the log, in the order of workers."""
    root = work_folder(s, "by-worker")
    write_sorted(td.events(s, d), f"{root}/log", ["worker_id", "event_time"])
    log = read_events(s, f"{root}/log").filter("worker_id != ''")
    return log.groupBy("worker_id").agg(F.count(F.lit(1)).alias("cnt"))


_SUMS = ["cnt", "duration_sum", "duration_count"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "src1_stream_ingest": stream_ingest,
    "ded2_stream_dedupe": stream_dedupe,
    "ru7_stream_rollups": exact_rollups("job_minute_stats"),
    "ru7_stream_workers": exact_rollups("worker_minute_stats"),
    "ru7_late_after_expiry": late_after_expiry,
    "ru7_late_events": listed_late,
    "ru7_delta_rollups": delta_rollups,
    "ru9_backfill_hours": backfilled("job_hourly_stats", "hour", _SUMS),
    "ru9_backfill_days": backfilled("job_daily_stats", "day", ["cnt"]),
    "ru9_backfill_failures": backfilled("failure_minute_stats", "minute", ["cnt"]),
    "ttl1_trimmed_log": trimmed_log,
    "lay2_written_log": written_log,
    "lay4_by_worker": log_by_worker,
    "lc17_stream_states": stream_states,
    "ru8_folded_deltas": folded_deltas,
    "snk3_merged_log": merged_log,
    "lay3_one_job": one_job,
    "ded2_late_copies": late_copies,
    "ru1_live_minutes": live_minutes,
    "aq5a_stream_pairs": lambda s, d: read_queue_waits(s, _queue_waits(s, d), WAITS_UNTIL),
    "aq5a_never_started": lambda s, d: read_never_started(s, _queue_waits(s, d), WAITS_UNTIL),
    "lc7_stream_timeouts": lambda s, d: _overdue(s, d, "timeouts", _run_marks),
    "store9_stream_silence": lambda s, d: _overdue(s, d, "silence", _life_marks),
}
