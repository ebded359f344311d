"""The outbox: event envelopes, routing to topics, marking as published, replay output."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.operators.timerange import instant
from jobtrail.schema import EVENT_COLUMNS
from jobtrail.sources.readers import EVENT_TOPICS

_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def rfc3339(ts: Column) -> Column:
    """UTC time text with the fraction cut of trailing zeros."""
    text = F.date_format(ts, _TIME_FORMAT)
    return F.regexp_replace(text, r"\.?0*Z$", "Z")


def to_events(rows: DataFrame, now: datetime, scheduler_id: str = "", random_ids: bool = False) -> DataFrame:
    """Event envelopes of emitted events.

    ``rows`` has event_type and may have job_id, execution_id, worker_id, attempt, payload and
    ``seq`` (order of events of one decision). The id is a hash of what happened, so a retried
    task repeats it; ``random_ids`` asks for random ones instead.
    """
    has = set(rows.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in has else F.lit("")
    attempt = F.coalesce(F.col("attempt"), F.lit(0)) if "attempt" in has else F.lit(0)
    payload = F.coalesce(F.col("payload"), F.lit("{}")) if "payload" in has else F.lit("{}")
    seq = F.col("seq") if "seq" in has else F.lit(0)
    stamp = instant(now)
    named = [text(c) for c in ("event_type", "job_id", "execution_id", "worker_id")]
    digest = F.md5(F.concat_ws("|", *named, attempt, seq, F.lit(scheduler_id), F.unix_micros(stamp)))
    hashed = F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    cols = {
        "event_id": F.uuid() if random_ids else hashed,
        "event_version": F.lit(1),
        "event_time": stamp,
        "ingested_at": stamp,
        "scheduler_id": F.lit(scheduler_id),
        "attempt": attempt.cast("bigint"),
        "payload": payload,
    }
    return rows.select(*[cols.get(c, text(c)).alias(c) for c in EVENT_COLUMNS])


# Fixed value: how an unset time is written.
_NO_TIME = "0001-01-01T00:00:00Z"


def event_json(*, payload: str = "payload", ingested: bool = False) -> Column:
    """One event as JSON text; empty ids, a zero attempt and an absent payload are left out, the payload is nested.

    An unset event time is written as the zero time. ``ingested`` adds the time of ingestion where there is one;
    events on their way to a topic have none yet.
    """
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    head = F.to_json(
        F.struct(
            F.col("event_id"),
            F.col("event_type"),
            F.col("event_version"),
            F.coalesce(rfc3339(F.col("event_time")), F.lit(_NO_TIME)).alias("event_time"),
            *([rfc3339(F.col("ingested_at")).alias("ingested_at")] if ingested else []),
            *[some(c).alias(c) for c in ("job_id", "execution_id", "worker_id", "scheduler_id")],
            F.when(F.col("attempt") != 0, F.col("attempt")).alias("attempt"),
            some("trace_id").alias("trace_id"),
        )
    )
    body = F.when(F.length(payload) > 0, F.concat(F.lit(',"payload":'), F.col(payload))).otherwise("")
    return F.concat(F.regexp_replace(head, r"\}$", ""), body, F.lit("}"))


def to_outbox(events: DataFrame) -> DataFrame:
    """Outbox rows: the payload is the whole event, the aggregate is the job."""
    return events.select(
        F.col("event_id").alias("id"),
        "event_type",
        F.col("job_id").alias("aggregate_id"),
        event_json().alias("payload"),
        F.col("event_time").alias("created_at"),
        F.lit(None).cast("timestamp").alias("published_at"),
    )


def route(outbox: DataFrame, entity_key: bool = False, topics: Sequence[str] = EVENT_TOPICS) -> DataFrame:
    """Topic, key, value and time of the message each outbox row becomes.

    ``topics`` names those of job, worker and scheduler events; other events go with the jobs'.
    ``entity_key`` keys worker and scheduler events by their worker or scheduler instead of the
    row id.
    """
    kind = F.col("event_type")
    of_jobs, of_workers, of_schedulers = topics
    topic = F.when(kind.startswith("WORKER_"), of_workers).when(kind.startswith("SCHEDULER_"), of_schedulers).otherwise(of_jobs)
    keys = [F.nullif("aggregate_id", F.lit("")), F.col("id")]
    if entity_key:
        entity = F.when(kind.startswith("WORKER_"), F.get_json_object("payload", "$.worker_id")).when(
            kind.startswith("SCHEDULER_"), F.get_json_object("payload", "$.scheduler_id")
        )
        keys.insert(0, F.nullif(entity, F.lit("")))
    return outbox.select(
        "id",
        topic.alias("topic"),
        F.coalesce(*keys).alias("key"),
        F.col("payload").alias("value"),
        F.col("created_at").alias("timestamp"),
    )


def write_kafka(messages: DataFrame, servers: str) -> None:
    """Publish routed rows; needs the Kafka connector on the class path."""
    (
        messages.select("topic", "key", "value", "timestamp")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .save()
    )


def write_topic_files(messages: DataFrame, folder: str) -> None:
    """Publish routed rows as JSON lines, one folder per topic."""
    messages.select("topic", "value").write.mode("append").partitionBy("topic").text(folder)


def mark_published(outbox: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """The outbox after the rows in ``ids`` went out; the first time of publishing stays."""
    sent = ids.select("id").distinct().withColumn("_sent", F.lit(True))
    when = F.coalesce("published_at", F.when(F.col("_sent"), instant(now)))
    return outbox.join(sent, "id", "left").withColumn("published_at", when).select(*outbox.columns)


def replay_lines(events: DataFrame) -> DataFrame:
    """One JSON line per event."""
    return events.select(event_json(ingested=True).alias("value"))
