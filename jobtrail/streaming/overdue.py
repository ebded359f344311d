"""Runs past their limit and silent workers, told when it happens.

The stream keeps the open waits and the watermark: the newest mark of all batches so far, less the delay. Once the
watermark has passed a limit, all marks up to there are in, so the decision is that of ``operators.overdue`` on the log,
whatever the order in which marks came in. Marks behind the watermark change no decision; they are given out with the
label LATE.

A batch is one pass over its marks and those kept: sorted by key and time, each wait needs only the next mark of its key.
What is kept lies in the checkpoint, at waits/BATCH_WATERMARK, and appears by one rename when the batch is done.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobtrail.operators.overdue import MARKS, shown
from jobtrail.streaming.ingest import adaptive, start
from jobtrail.streaming.parts import fold, read_parts
from jobtrail.streaming.storage import move, names, remove

LATE = "LATE"
_JUDGED = f"{MARKS}, over boolean"


def _delay_ms(spark: SparkSession, delay: str) -> int:
    ms = spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.lit(delay).cast("interval"))).first()[0]
    if ms is None or ms < 0:
        raise ValueError(f"no delay: {delay}")
    return ms


def _kept(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """(batch, watermark) of what is kept, oldest first."""
    return sorted((int(batch), int(ms)) for batch, _, ms in (n.partition("_") for n in names(spark, root)) if batch.isdigit())


def _behind(watermark: int) -> Column:
    return F.shiftright("at", 4) < watermark


def _judged(marks: DataFrame, watermark: int) -> DataFrame:
    """The marks that may still decide something, and the waits that are overdue by the watermark (``over``).

    Kept are open waits and marks that are not behind the watermark. What ended a wait need not stay: other waits before
    it have their end as well, and none behind the watermark comes in any more.
    """
    once = marks.repartition("key").dropDuplicates()
    # Marks with one place do not end each other, so the next mark is the first of a later place.
    later = Window.partitionBy("key").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    after = F.shiftright(F.min("at").over(later), 4)
    waits = F.col("label").isNotNull() & (F.col("_after").isNull() | (F.col("_after") > F.col("due")))
    over = _behind(watermark) & (F.col("due") < watermark)
    judged = once.withColumn("_after", after).withColumn("_waits", F.coalesce(waits, F.lit(False)))
    return judged.filter(F.col("_waits") | ~_behind(watermark)).select("key", "at", "label", "due", (F.col("_waits") & over).alias("over"))


def start_overdue(
    marks: DataFrame, path: str, checkpoint: str, delay: str = "10 seconds", interval: str | None = "1 second"
) -> StreamingQuery:
    """Write waits as they become overdue, and marks that came more than ``delay`` after newer ones (label LATE).

    ``marks`` comes from ``run_marks`` or ``life_marks`` of a stream. A retried batch replaces its own rows.
    """
    root, delay_ms = f"{checkpoint}/waits", _delay_ms(marks.sparkSession, delay)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = adaptive(batch.sparkSession)
        kept = _kept(spark, root)
        if any(n == batch_id for n, _ in kept):
            return
        last, before = kept[-1] if kept else (None, 0)
        rows = batch.select("key", "at", "label", "due").filter("at IS NOT NULL").persist(StorageLevel.DISK_ONLY)
        try:
            newest = rows.agg(F.max(F.shiftright("at", 4))).first()[0]
            watermark = before if newest is None else max(before, newest - delay_ms)
            known = rows.filter(~_behind(before))
            if last is not None:
                open_waits = spark.read.schema(_JUDGED).parquet(f"{root}/{last}_{before}").filter("NOT over").drop("over")
                known = known.unionByName(open_waits)
            _judged(known, watermark).write.mode("overwrite").parquet(f"{root}/arriving")
            found = spark.read.schema(_JUDGED).parquet(f"{root}/arriving").filter("over").drop("over")
            late = rows.filter(_behind(before)).withColumn("label", F.lit(LATE))
            found.unionByName(late).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            move(spark, f"{root}/arriving", f"{root}/{batch_id}_{watermark}")
        finally:
            rows.unpersist()
        for n, ms in kept[:-1]:
            remove(spark, f"{root}/{n}_{ms}")

    return start(marks.writeStream.foreachBatch(run), checkpoint, interval)


def read_overdue(spark: SparkSession, path: str) -> DataFrame:
    """(key, since, due, label) of all waits found overdue so far."""
    return shown(read_parts(spark, path, MARKS).filter(F.col("label") != LATE))


def read_late_marks(spark: SparkSession, path: str) -> DataFrame:
    """(key, since, due, label) of marks that came behind the watermark."""
    return shown(read_parts(spark, path, MARKS).filter(F.col("label") == LATE))


def fold_overdue(spark: SparkSession, path: str) -> int:
    """Bring the parts written so far together; may run while the stream writes and others read."""
    return fold(spark, path, lambda rows: rows.coalesce(8), MARKS)
