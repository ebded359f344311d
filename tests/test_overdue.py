"""Limits on the stream: dense keys, batches that are repeated, what is kept between batches."""

from __future__ import annotations

import math
import os
import shutil
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from jobtrail.operators import overdue as ov
from jobtrail.schema import EVENT, EVENT_COLUMNS
from jobtrail.streaming import overdue as stream
from jobtrail.streaming import queries
from tests.conftest import at
from tests.test_live import deliver, few_tasks, given  # noqa: F401

BEGIN, EPOCH = at(2026, 1, 1), at(1970, 1, 1)


def life(rows):
    return ov.life_marks(rows, timedelta(seconds=30), timedelta(seconds=20))


def run(spark, folder, top, delay="0 seconds"):
    stream.start_overdue(life(given(spark, folder)), f"{top}/out", f"{top}/ck", delay, None).awaitTermination()


def beats(seconds, worker="w"):
    return [("WORKER_HEARTBEAT", BEGIN + timedelta(seconds=s), dict(event_id=f"{worker}{s}", worker_id=worker)) for s in seconds]


def found(spark, top):
    return sorted(map(tuple, stream.read_overdue(spark, f"{top}/out").collect()))


def by_the_log(spark, folder, rows, delay=timedelta(0)):
    now = EPOCH + timedelta(milliseconds=life(rows).agg(F.max("at")).first()[0] >> 4) - delay
    return sorted(map(tuple, ov.overdue(life(rows), now).collect()))


def kept(spark, top):
    last = stream._kept(spark, f"{top}/ck/waits")[-1]
    return spark.read.parquet(f"{top}/ck/waits/{last[0]}_{last[1]}").filter("NOT over").count()


def test_many_marks_of_one_key_cost_no_more_than_those_of_many(spark, events, tmp_path):
    """A timer for each mark that reads all marks of its key takes minutes here."""
    folder = f"{tmp_path}/in"
    log = beats([s for s in range(9000) if s % 1000 > 60])
    for part in (log[:4000], log[4000:]):
        deliver(events, folder, part)
    begun = time.time()
    run(spark, folder, tmp_path, "1 hour")
    assert time.time() - begun < 60
    assert found(spark, tmp_path) == by_the_log(spark, folder, events(*log), timedelta(hours=1)) and len(found(spark, tmp_path)) == 10
    # Open waits and the marks of the last hour, two limits each.
    assert kept(spark, tmp_path) <= 2 * 3601


def test_many_keys_of_few_marks(spark, events, tmp_path):
    """A call of the state store for each key takes a minute here."""
    folder, n = f"{tmp_path}/in", 200_000
    rows = events(("JOB_STARTED", BEGIN, {})).drop("event_id", "job_id").crossJoin(
        spark.range(n).select(F.col("id").cast("string").alias("event_id"), F.concat(F.lit("j"), "id").alias("job_id"))
    )
    rows = rows.withColumn("event_time", F.col("event_time") + F.make_dt_interval(secs=F.col("event_id").cast("int") % 1000))
    rows.select(*EVENT_COLUMNS).coalesce(1).write.parquet(folder)
    marks = ov.run_marks(given(spark, folder), timedelta(seconds=99))
    begun = time.time()
    stream.start_overdue(marks, f"{tmp_path}/out", f"{tmp_path}/ck", "0 seconds", None).awaitTermination()
    assert time.time() - begun < 30
    late = stream.read_overdue(spark, f"{tmp_path}/out")
    assert late.count() == late.select("key").distinct().count() == n * 900 // 1000  # 99 s before the last second


@pytest.mark.parametrize("most, sizes", [(10, (5, 0, 4, 9)), (10, (95, 3, 0, 52)), (7, (0, 0, 0, 30))])
def test_batches_of_the_input_have_their_rows_in_as_many_files(spark, events, tmp_path, monkeypatch, most, sizes):
    monkeypatch.setattr(queries, "FILE_ROWS", most)
    days = (1, 12, 18, 29)
    rows = [
        ("JOB_STARTED", at(2026, 1, day) + timedelta(hours=i % 7, seconds=i), dict(event_id=str(3 * (100 * day + i)), job_id=f"j{i % 9}"))
        for day, size in zip(days, sizes) for i in range(size)
    ]
    folder, told = f"{tmp_path}/in", []

    def work(files: int) -> None:
        told.append(files)
        marks = ov.run_marks(queries._stream(spark, folder, EVENT, files), timedelta(hours=3))
        queries.start_overdue(marks, f"{tmp_path}/out", f"{tmp_path}/ck", "1 day", None).awaitTermination()

    queries._in_order(events(*rows), folder, work)
    assert told[0] == told[1] and 1 < told[0] + (max(sizes) <= most) <= 1 + math.ceil(max(sizes) / most)
    assert not any(n.startswith("_batch=") for n in os.listdir(f"{folder}-dealt"))
    written = sorted((os.path.getmtime(f"{folder}/{n}"), f"{folder}/{n}") for n in os.listdir(folder) if n.endswith(".parquet"))
    assert len(written) == 4 * told[0]
    for k, size in enumerate(sizes):
        part = spark.read.schema(EVENT).parquet(*[f for _, f in written[k * told[0] : (k + 1) * told[0]]])
        assert part.count() == size == part.filter(F.dayofmonth("event_time") == days[k]).count()
    known = ov.run_marks(events(*rows), timedelta(hours=3))
    now = EPOCH + timedelta(milliseconds=known.agg(F.max("at")).first()[0] >> 4) - timedelta(days=1)
    assert found(spark, tmp_path) == sorted(map(tuple, ov.overdue(known, now).collect()))
    assert stream.read_late_marks(spark, f"{tmp_path}/out").isEmpty()


def test_what_is_kept_does_not_grow_with_time(spark, events, tmp_path):
    folder, sizes = f"{tmp_path}/in", []
    for n in range(4):
        deliver(events, folder, beats(range(n * 1000, n * 1000 + 1000, 2)) + beats([0], "silent"))
        run(spark, folder, tmp_path, "1 minute")
        sizes.append(kept(spark, tmp_path))
        assert len(stream._kept(spark, f"{tmp_path}/ck/waits")) <= 2
    assert max(sizes) <= 2 * 32
    assert [(r[0], r[3]) for r in found(spark, tmp_path)] == [("silent", "SUSPECTED"), ("silent", "UNAVAILABLE")]


@pytest.mark.parametrize("broke_off", ["before the rename", "after the rename"])
def test_a_repeated_batch_replaces_its_rows(spark, events, tmp_path, broke_off):
    log = sorted(beats(range(0, 600, 7)) + beats([5, 300, 420], "x") + beats([640]), key=lambda row: row[1])
    folder = f"{tmp_path}/in"
    for part in (log[:40] + log[:9], log[40:]):
        deliver(events, folder, part)
        run(spark, folder, tmp_path)
    whole = found(spark, tmp_path)
    assert whole == by_the_log(spark, folder, events(*log)) and whole
    for name in ("1", ".1.crc"):
        os.remove(f"{tmp_path}/ck/commits/{name}")
    if broke_off == "before the rename":
        last = stream._kept(spark, f"{tmp_path}/ck/waits")[-1]
        shutil.move(f"{tmp_path}/ck/waits/{last[0]}_{last[1]}", f"{tmp_path}/ck/waits/arriving")
    run(spark, folder, tmp_path)
    assert found(spark, tmp_path) == whole


def test_marks_without_a_time_or_in_an_empty_batch_decide_nothing(spark, events, tmp_path):
    folder = f"{tmp_path}/in"
    deliver(events, folder, beats([0, 10]) + [("WORKER_HEARTBEAT", None, dict(event_id="n", worker_id="w"))])
    run(spark, folder, tmp_path)
    deliver(events, folder, [("JOB_QUEUED", BEGIN + timedelta(days=1), dict(event_id="q", job_id="j"))])
    run(spark, folder, tmp_path)
    assert found(spark, tmp_path) == [] and kept(spark, tmp_path) == 2
    deliver(events, folder, beats([40]))
    run(spark, folder, tmp_path)
    assert found(spark, tmp_path) == []  # a mark at the limit is in time
    deliver(events, folder, beats([71]))
    run(spark, folder, tmp_path)
    assert [(r[1].second, r[3]) for r in found(spark, tmp_path)] == [(40, "SUSPECTED")]
    assert stream.read_late_marks(spark, f"{tmp_path}/out").isEmpty()


def test_late_marks_are_listed_as_often_as_they_come(spark, events, tmp_path):
    folder = f"{tmp_path}/in"
    deliver(events, folder, beats([0, 100]))
    run(spark, folder, tmp_path)
    deliver(events, folder, beats([50, 50, 100, 200]))
    run(spark, folder, tmp_path)
    late = [(r.since.second, r.label) for r in stream.read_late_marks(spark, f"{tmp_path}/out").collect()]
    assert late == [(50, "LATE")] * 4  # two limits each
    assert len(found(spark, tmp_path)) == 4


def test_a_delay_is_a_length_of_time(spark):
    lengths = {"3 days": 3 * 86_400_000, "0 seconds": 0, "interval 1 minute": 60_000, "1 hour 5 seconds": 3_605_000}
    assert {d: stream._delay_ms(spark, d) for d in lengths} == lengths
    with pytest.raises(ValueError):
        stream._delay_ms(spark, "-1 second")
