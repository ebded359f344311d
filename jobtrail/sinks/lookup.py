"""Looking events up by job, trace, execution or worker without reading the whole log.

An index table has a row for each file of the log, id column and id that occurs in the file (as a hash), sorted by column
and hash, so that finding the files of an id reads a few row groups of the index. Only these files of the log are then
read, and within them Bloom filters and statistics still prune row groups. Files that are not indexed yet are read, too:
an index that lags behind costs time and never an event.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.schema import EVENT
from jobtrail.sinks.event_log import read_events
from jobtrail.streaming.storage import exists, names

LOOKUP_COLUMNS = ["job_id", "trace_id", "execution_id", "worker_id"]
_ENTRY = "name string, hash bigint, file string"


def log_files(spark: SparkSession, path: str) -> set[str]:
    """The files of the log as day folder and name."""
    days = [n for n in names(spark, path) if n.startswith("event_day=")]
    return {f"{d}/{f}" for d in days for f in names(spark, f"{path}/{d}") if f.endswith(".parquet")}


def indexed_files(spark: SparkSession, index: str) -> set[str]:
    if not exists(spark, f"{index}/files"):
        return set()
    return {r.file for r in spark.read.schema("file string").parquet(f"{index}/files").collect()}


def index_log(spark: SparkSession, path: str, index: str) -> int:
    """Index the files that are not indexed yet; their number.

    Each run adds a part of its own. The list of files is written last, so a run that breaks off is repeated as a whole;
    entries that are there twice do no harm.
    """
    new = sorted(log_files(spark, path) - indexed_files(spark, index))
    if not new:
        return 0
    rows = spark.read.schema(EVENT).parquet(*[f"{path}/{f}" for f in new])
    file = F.regexp_extract(F.url_decode("_metadata.file_path"), r"(event_day=[^/]+/[^/]+)$", 1)
    ids = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in LOOKUP_COLUMNS])
    entries = rows.select(file.alias("file"), F.inline(ids)).filter("value != ''")
    entries = entries.select("name", F.xxhash64("value").alias("hash"), "file").distinct()
    part = uuid.uuid4().hex
    sorted_entries = entries.repartitionByRange("name", "hash", "file").sortWithinPartitions("name", "hash")
    sorted_entries.write.parquet(f"{index}/entries/{part}")
    spark.createDataFrame([(f,) for f in new], "file string").coalesce(1).write.mode("append").parquet(f"{index}/files")
    return len(new)


def files_of(spark: SparkSession, path: str, index: str, column: str, value: str) -> list[str]:
    """The files that may hold events of an id: those the index names and those it does not know."""
    present, known = log_files(spark, path), indexed_files(spark, index)
    if not known:
        return sorted(present)
    entries = spark.read.schema(_ENTRY).option("recursiveFileLookup", "true").parquet(f"{index}/entries")
    wanted = entries.filter((F.col("name") == column) & (F.col("hash") == F.xxhash64(F.lit(value))))
    return sorted((present - known) | (present & {r.file for r in wanted.select("file").distinct().collect()}))


def find_events(spark: SparkSession, path: str, index: str, column: str, value: str) -> DataFrame:
    """All events of the log, copies included, whose ``column`` has a value other than ''."""
    if column not in LOOKUP_COLUMNS or value == "":
        raise ValueError(f"no index of {column} {value!r}")
    files = files_of(spark, path, index, column, value)
    if not files:
        return read_events(spark, path).filter(F.lit(False))
    rows = spark.read.schema(f"{EVENT}, event_day date").option("basePath", path).parquet(*[f"{path}/{f}" for f in files])
    return rows.filter(F.col(column) == value)
