"""Decode event and work messages; undecodable ones are kept apart, never dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.functions.scalar import settle
from jobtrail.schema import EVENT_COLUMNS, EVENT_MESSAGE, QUEUED_JOB

_CORRUPT = "_corrupt"
# Fixed value: the time an unset clock is written as.
ZERO_TIME = "0001-01-01T00:00:00Z"
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"

_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}


def _decode(value: Column, schema: str) -> Column:
    # A message is one JSON object; anything else decodes to NULL.
    text = F.when(F.ltrim(value).startswith("{"), value)
    return F.from_json(text, f"{schema}, {_CORRUPT} string", _OPTIONS)


def _time(text: Column) -> Column:
    """Timestamp of an RFC 3339 text, cut to milliseconds; NULL when it is not one."""
    return F.when(text.rlike(_RFC3339), F.date_trunc("MILLISECOND", text.try_cast("timestamp")))


def _unset(text: Column) -> Column:
    return text.isNull() | (text == ZERO_TIME)


def decode_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """Decoded event columns, the raw text and ``reject_reason`` (NULL for good rows).

    ``event_time`` is NULL where the message leaves it unset. Other columns of the input, such as
    the time the source recorded, are kept.
    """
    keep = [c for c in messages.columns if c != value]
    e = F.col("_e")
    raw_time = e["event_time"]
    bad = (
        e.isNull()
        | e[_CORRUPT].isNotNull()
        | (~_unset(raw_time) & _time(raw_time).isNull())
    )
    reason = F.when(bad, "undecodable").when(F.coalesce(e["event_id"], F.lit("")) == "", "empty_event_id")
    text = ["event_id", "event_type", "job_id", "execution_id", "worker_id", "scheduler_id", "trace_id"]
    fields = {c: F.coalesce(e[c], F.lit("")) for c in text}
    fields |= {
        "event_version": F.coalesce(e["event_version"], F.lit(0)),
        "event_time": F.when(~_unset(raw_time), _time(raw_time)),
        "ingested_at": _time(e["ingested_at"]),
        "attempt": F.coalesce(e["attempt"], F.lit(0).cast("bigint")),
        "payload": e["payload"],
    }
    return (
        settle(messages, {"_e": _decode(F.col(value).cast("string"), EVENT_MESSAGE)})
        .select(
            *keep,
            *[fields[c].alias(c) for c in EVENT_COLUMNS],
            F.col(value).cast("string").alias("raw"),
            reason.alias("reject_reason"),
        )
    )


def valid_events(decoded: DataFrame) -> DataFrame:
    return decoded.filter("reject_reason IS NULL").drop("reject_reason")


def rejected_events(decoded: DataFrame) -> DataFrame:
    """Quarantine rows: why and what."""
    return decoded.filter("reject_reason IS NOT NULL").select(F.col("reject_reason").alias("reason"), "raw")


def replayable_events(decoded: DataFrame) -> DataFrame:
    """A replay leaves out undecodable messages only; empty ids pass."""
    return decoded.filter("reject_reason IS NULL OR reject_reason <> 'undecodable'").drop("reject_reason")


def decode_queued_jobs(messages: DataFrame, value: str = "value") -> DataFrame:
    """Work messages with their payload as text; ``reject_reason`` marks poison."""
    keep = [c for c in messages.columns if c != value]
    j = F.col("_j")
    bad_payload = j["payload"].isNotNull() & F.try_to_binary(j["payload"], F.lit("base64")).isNull()
    bad_time = ~_unset(j["enqueued_at"]) & _time(j["enqueued_at"]).isNull()
    bad = j.isNull() | j[_CORRUPT].isNotNull() | bad_payload | bad_time
    text = ["job_id", "execution_id", "name", "type", "trace_id"]
    return settle(messages, {"_j": _decode(F.col(value).cast("string"), QUEUED_JOB)}).select(
        *keep,
        *[F.coalesce(j[c], F.lit("")).alias(c) for c in text],
        F.decode(F.try_to_binary(j["payload"], F.lit("base64")), "UTF-8").alias("payload"),
        F.coalesce(j["priority"], F.lit(0)).alias("priority"),
        F.coalesce(j["attempt"], F.lit(0)).alias("attempt"),
        F.coalesce(j["timeout"], F.lit(0).cast("bigint")).alias("timeout"),
        F.when(~_unset(j["enqueued_at"]), _time(j["enqueued_at"])).alias("enqueued_at"),
        F.col(value).cast("string").alias("raw"),
        F.when(bad, "undecodable").alias("reject_reason"),
    )
