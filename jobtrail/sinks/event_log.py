"""The event log at rest: normalised rows in Parquet, one folder per day, sorted for pruning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from jobtrail.functions.scalar import day
from jobtrail.operators.dedupe import final_events
from jobtrail.operators.timerange import instant
from jobtrail.schema import EVENT, EVENT_COLUMNS, EVENT_KEY

_UUID = r"^(urn:uuid:)?\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\}?$"
_UUID_PARTS = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"
# Columns that are looked up one value at a time.
BLOOM_COLUMNS = ["event_id", "job_id", "execution_id", "worker_id", "trace_id"]


def _as_uuid(hex32: Column) -> Column:
    return F.regexp_replace(hex32, _UUID_PARTS, "$1-$2-$3-$4-$5")


def normalise(events: DataFrame, now: datetime) -> DataFrame:
    """Decoded events to log rows, stamped with one ingestion time.

    A malformed id becomes a hash of the message, and an unset time the time the source recorded
    (``source_time`` where present, else ``now``): both repeat on replay, so copies stay copies.
    """
    has = set(events.columns)
    message = F.col("raw") if "raw" in has else F.to_json(F.struct(*[c for c in EVENT_COLUMNS if c in has]))
    uuid_text = F.lower(F.regexp_replace(F.regexp_replace("event_id", "^urn:uuid:", ""), r"[-{}]", ""))
    event_id = F.when(F.col("event_id").rlike(_UUID), _as_uuid(uuid_text)).otherwise(_as_uuid(F.md5(message)))
    stamp = instant(now)
    times = [F.col("event_time")] + ([F.col("source_time")] if "source_time" in has else []) + [stamp]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    cols = {
        "event_id": event_id,
        "event_type": text("event_type"),
        "event_version": F.coalesce("event_version", F.lit(0)).bitwiseAND(0xFFFF).cast("int"),
        "event_time": F.date_trunc("MILLISECOND", F.coalesce(*times)),
        "ingested_at": F.date_trunc("MILLISECOND", stamp),
        "attempt": F.coalesce("attempt", F.lit(0)).cast("bigint").bitwiseAND(0xFFFFFFFF),
        "payload": F.when(F.length("payload") > 0, F.col("payload")).otherwise("{}"),
    }
    return events.select(*[cols.get(c, text(c)).alias(c) for c in EVENT_COLUMNS])


def with_day(events: DataFrame) -> DataFrame:
    return events.withColumn("event_day", day())


def _writer(df: DataFrame, mode: str) -> DataFrameWriter:
    out = df.write.mode(mode).partitionBy("event_day")
    for c in BLOOM_COLUMNS:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return out


def append_events(rows: DataFrame, path: str) -> None:
    """Append a batch as it arrives.

    Rows of a day are brought together without a hot task: adaptive execution splits a big day
    over several tasks and joins small ones.
    """
    cols = [*EVENT_COLUMNS, "event_day"]
    df = with_day(rows).select(*cols).hint("rebalance", "event_day").sortWithinPartitions("event_day", *EVENT_KEY)
    _writer(df, "append").parquet(path)


def write_sorted(rows: DataFrame, path: str, order: list[str] | None = None, mode: str = "append") -> None:
    """Write a large batch in global order of day and key.

    Files then cover narrow, disjoint ranges, and the min/max statistics prune row groups. A day of
    any size is spread over as many tasks as its rows need. ``order`` picks another order for a
    second copy, for example ``["worker_id", "event_time"]``.
    """
    order = order or EVENT_KEY
    rest = [c for c in EVENT_KEY if c not in order]
    keys = ["event_day", *order, *rest]
    # Copies of one event have equal keys; the last range key lets them spread over tasks, too. It is a hash of the
    # row, so a task that is run again deals its rows to the same tasks.
    spread = with_day(rows).select(*EVENT_COLUMNS, "event_day", F.xxhash64(*EVENT_COLUMNS).alias("_spread"))
    df = spread.repartitionByRange(*keys, "_spread").drop("_spread").sortWithinPartitions(*keys)
    _writer(df, mode).parquet(path)


def write_bucketed(rows: DataFrame, table: str, path: str, buckets: int, mode: str = "append") -> None:
    """Write a catalog table bucketed by event id, so that removing copies on read needs no shuffle.

    Copies within the batch are removed first; only copies across batches are left to the reader,
    so that no id fills a bucket.
    """
    df = with_day(final_events(rows)).select(*EVENT_COLUMNS, "event_day")
    (
        df.repartition(buckets, "event_id")
        .write.mode(mode)
        .bucketBy(buckets, "event_id")
        .sortBy(*EVENT_KEY)
        .option("path", path)
        .saveAsTable(table)
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The raw log with its day column."""
    return spark.read.schema(f"{EVENT}, event_day date").parquet(path)
