"""Tables that streams write part by part, and folding the parts.

``path``/batch_id=N is what batch N wrote. ``fold`` merges all finished parts into one folder, ``path``/_folded/upto=N,
which appears by one rename: it is the pointer. Readers take the newest folded folder and the parts after it, so streams
go on writing, folds run side by side with readers, and a fold that breaks off anywhere leaves the table as it was.
Parts that are folded, and older folded folders, are removed by ``sweep``, later than any reader may still use them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobtrail.streaming.storage import exists, move, names, remove

Merge = Callable[[DataFrame], DataFrame]


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    return sorted(int(n.removeprefix(prefix)) for n in names(spark, path) if n.startswith(prefix))


def folded_upto(spark: SparkSession, path: str) -> int:
    """The batch up to which parts are folded; -1 before the first fold."""
    return max(_numbers(spark, f"{path}/_folded", "upto="), default=-1)


def folders(spark: SparkSession, path: str, upto: int | None = None) -> list[str]:
    """The folders that make up the table, or those of the parts up to a batch."""
    done = folded_upto(spark, path)
    base = [f"{path}/_folded/upto={done}"] if done >= 0 else []
    parts = [n for n in _numbers(spark, path, "batch_id=") if n > done and (upto is None or n <= upto)]
    return base + [f"{path}/batch_id={n}" for n in parts]


def read_parts(spark: SparkSession, path: str, schema: str | None = None, upto: int | None = None) -> DataFrame:
    """All rows of the table, not merged."""
    found = folders(spark, path, upto)
    if not found:
        if schema is None:
            raise FileNotFoundError(f"no parts in {path}")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    # A part that is just being written again has no committed files yet; its folder may be empty.
    return reader.option("ignoreMissingFiles", "true").parquet(*found)


def finished(spark: SparkSession, path: str) -> int:
    """The last batch before which no part is unfinished; -1 if there is none."""
    last = -1
    for n in _numbers(spark, path, "batch_id="):
        if n > folded_upto(spark, path) and not exists(spark, f"{path}/batch_id={n}/_SUCCESS"):
            break
        last = n
    return last


def fold(spark: SparkSession, path: str, merge: Merge, schema: str | None = None, files: int | None = None) -> int:
    """Merge the finished parts; the batch up to which the table is folded now.

    ``merge`` maps rows of the table to fewer rows of the same meaning. A part that its stream writes again later holds
    the same rows, and is not read any more. One fold at a time: of two, the second fails to rename and changes nothing.
    """
    upto, done = finished(spark, path), folded_upto(spark, path)
    if upto <= done:
        return done
    rows = merge(read_parts(spark, path, schema, upto))
    staged = f"{path}/_folding/{uuid.uuid4().hex}"
    (rows if files is None else rows.repartition(files)).write.parquet(staged)
    move(spark, staged, f"{path}/_folded/upto={upto}")
    return upto


def sweep(spark: SparkSession, path: str) -> None:
    """Remove what the newest folded folder replaces, and leavings of folds that broke off."""
    done = folded_upto(spark, path)
    for n in _numbers(spark, path, "batch_id="):
        if n <= done:
            remove(spark, f"{path}/batch_id={n}")
    for n in _numbers(spark, f"{path}/_folded", "upto="):
        if n < done:
            remove(spark, f"{path}/_folded/upto={n}")
    remove(spark, f"{path}/_folding")
