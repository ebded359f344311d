"""Operational tables at rest, changed in place: jobs, executions, workers, outbox.

Rows are dealt to buckets by a hash of their key. A version of the table is a list of bucket folders; an update writes
the buckets that hold an id of it anew, and then, by one rename, the list of the next version. Readers take the newest
list and never see half an update; an update that breaks off leaves the table as it was. Of two updates at a time one
fails to rename and has to be repeated on the new version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.streaming.storage import exists, move, names, remove

BUCKETS = 256
_LIST = "bucket int, folder string"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def newest(spark: SparkSession, root: str) -> int:
    """The newest version; -1 for a table that was never written."""
    return max((int(n.removeprefix("v-")) for n in names(spark, f"{root}/versions") if n.startswith("v-")), default=-1)


def _listed(spark: SparkSession, root: str, version: int) -> dict[int, str]:
    """Folder of each bucket that holds rows: at most as many as the table has buckets."""
    rows = spark.read.schema(_LIST).parquet(f"{root}/versions/v-{version}").collect() if version >= 0 else []
    return {r.bucket: r.folder for r in rows}


def _write(rows: DataFrame, root: str, key: str, buckets: int) -> dict[int, str]:
    """Write rows below a folder of their own; the folder of each bucket they fill."""
    spark, place = rows.sparkSession, f"{root}/data/{uuid.uuid4().hex}"
    dealt = rows.withColumn("_bucket", _bucket(key, buckets)).hint("rebalance", "_bucket")
    dealt.write.partitionBy("_bucket").parquet(place)
    filled = (n.removeprefix("_bucket=") for n in names(spark, place) if n.startswith("_bucket="))
    return {int(b): f"{place}/_bucket={b}" for b in filled}


def _commit(spark: SparkSession, root: str, version: int, folders: dict[int, str]) -> int:
    staged = f"{root}/staged/{uuid.uuid4().hex}"
    spark.createDataFrame(sorted(folders.items()), _LIST).coalesce(1).write.parquet(staged)
    move(spark, staged, f"{root}/versions/v-{version}")
    return version


def create(rows: DataFrame, root: str, key: str, buckets: int = BUCKETS) -> int:
    """Write a new table; its version, 0. ``key`` has no null values."""
    if newest(rows.sparkSession, root) >= 0:
        raise FileExistsError(f"{root} holds a table")
    return _commit(rows.sparkSession, root, 0, _write(rows, root, key, buckets))


def read(spark: SparkSession, root: str, schema: str, version: int | None = None) -> DataFrame:
    """The newest or an older version that was not swept."""
    folders = _listed(spark, root, newest(spark, root) if version is None else version)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders.values())


def update(
    changes: DataFrame,
    root: str,
    schema: str,
    key: str,
    apply: Callable[[DataFrame, DataFrame], DataFrame],
    buckets: int = BUCKETS,
    change_key: str | None = None,
) -> tuple[int, int]:
    """Apply changes; the new version and how many buckets were written.

    ``apply(rows, changes)`` gives the rows that take the place of ``rows``; it gets the rows of the buckets that the
    keys of the changes fall in, and may add rows with such keys, change and leave out any. ``changes`` is read twice.
    """
    spark, version = changes.sparkSession, newest(changes.sparkSession, root)
    touched = {r.b for r in changes.select(_bucket(change_key or key, buckets).alias("b")).distinct().collect()}  # bucket numbers
    if not touched:
        return version, 0
    folders = _listed(spark, root, version)
    held = [f for b, f in folders.items() if b in touched]
    rows = spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)
    written = _write(apply(rows, changes), root, key, buckets)
    if strange := set(written) - touched:
        raise ValueError(f"rows for buckets {sorted(strange)[:5]} that no change names")
    kept = {b: f for b, f in folders.items() if b not in touched}
    return _commit(spark, root, version + 1, kept | written), len(touched)


def sweep(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove all but the newest versions and the folders only older ones use. No update may run meanwhile."""
    last = newest(spark, root)
    versions = [v for v in range(last + 1) if exists(spark, f"{root}/versions/v-{v}")]
    used = {f for v in versions if v > last - keep for f in _listed(spark, root, v).values()}
    for v in versions:
        if v <= last - keep:
            remove(spark, f"{root}/versions/v-{v}")
    for place in names(spark, f"{root}/data"):
        for n in names(spark, f"{root}/data/{place}"):
            if n.startswith("_bucket=") and f"{root}/data/{place}/{n}" not in used:
                remove(spark, f"{root}/data/{place}/{n}")
    remove(spark, f"{root}/staged")
