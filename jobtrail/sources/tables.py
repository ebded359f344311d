"""Operational tables: read a snapshot, decode its JSON columns, fill absent text with ''."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.schema import RETRY_POLICY, SCHEDULE

_JOB_TEXT = ["idempotency_key", "worker_id", "execution_id", "last_error"]


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table over JDBC. Pass partitionColumn, lowerBound, upperBound and numPartitions to read
    it in parallel; without them one task reads all of it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def decode_jobs(rows: DataFrame) -> DataFrame:
    """Job rows as stored (JSON as text, NULL for absent ids) to the job schema."""
    out = rows.withColumnRenamed("id", "job_id") if "id" in rows.columns else rows
    return out.withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) for c in _JOB_TEXT}
        | {
            "schedule": F.from_json("schedule", SCHEDULE),
            "retry_policy": F.from_json("retry_policy", RETRY_POLICY),
            "metadata": F.coalesce(
                F.from_json("metadata", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")
            ),
        }
    )


def decode_workers(rows: DataFrame) -> DataFrame:
    """Worker rows as stored to the worker schema."""
    out = rows.withColumnRenamed("id", "worker_id") if "id" in rows.columns else rows
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return out.withColumns(
        {
            "capabilities": F.from_json("capabilities", "struct<builtin:boolean,webhook:boolean>"),
            "labels": F.coalesce(F.from_json("labels", "map<string,string>"), empty),
            "metadata": F.coalesce(F.from_json("metadata", "map<string,string>"), empty),
        }
    )


def unpublished(outbox: DataFrame, limit: int | None = 100) -> DataFrame:
    """Outbox rows still to publish, oldest first."""
    rows = outbox.filter("published_at IS NULL").orderBy("created_at", "id")
    return rows if limit is None else rows.limit(limit)
