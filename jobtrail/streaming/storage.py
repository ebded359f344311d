"""Folders of the shared file system: whether they exist, and moving one in a single step."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _at(spark, path)
    return files.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it does not exist."""
    where, files = _at(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder. Readers see the target either whole or not at all where the file system renames in one step."""
    here, files = _at(spark, source)
    there, _ = _at(spark, target)
    files.mkdirs(there.getParent())
    if files.exists(there) or not files.rename(here, there):
        raise FileExistsError(f"{source} was not moved to {target}")


def remove(spark: SparkSession, path: str) -> None:
    where, files = _at(spark, path)
    files.delete(where, True)
