"""Streams: late files, repeated files, replays; the tables must end as the batch gives them."""

from __future__ import annotations

import json
import shutil
from datetime import date, timedelta

import pytest
from pyspark.errors import StreamingQueryException

from jobtrail.operators import rollups as ru
from jobtrail.operators.dedupe import final_events
from jobtrail.operators.retention import day_folders, drop_expired
from jobtrail.schema import EVENT
from jobtrail.sinks.event_log import append_events, read_events
from jobtrail.sources.readers import stream_files
from jobtrail.streaming import ingest, queries
from jobtrail.streaming.gate import read_late, start_gate, stream_on_time
from jobtrail.streaming.ingest import start_ingest
from jobtrail.streaming.rollups import backfill, days_ahead, late_events, read_deltas, read_rollup, refresh, start_deltas, start_exact
from tests.conftest import at

KINDS = ["JOB_QUEUED", "JOB_STARTED", "JOB_COMPLETED", "JOB_FAILED"]


def _line(i):
    # crosses a month border; every event has its own id
    when = at(2026, 1, 31, 20) + timedelta(minutes=7 * i)
    body = {
        "event_id": f"00000000-0000-4000-8000-{i:012d}", "event_type": KINDS[i % 4], "event_version": 1,
        "event_time": when.strftime("%Y-%m-%dT%H:%M:%SZ"), "job_id": f"j{i % 9}", "worker_id": f"w{i % 3}",
        "attempt": 1, "payload": {"duration_ms": i} if i % 4 == 2 else None,
    }
    return json.dumps({k: v for k, v in body.items() if v is not None})


def _counts(df, keys):
    return sorted(tuple(r) for r in df.select(*keys, "cnt", "duration_sum", "duration_count").collect())


def test_exact_rollups_under_late_and_repeated_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    files = [range(0, 60), range(90, 150), range(40, 100)]  # the last is late and repeats rows of both
    paths = [f"{tmp_path}/{n}" for n in ("log", "rejects", "rollups", "ck")]
    for n, rows in enumerate(files):
        (folder / f"{n}.json").write_text("\n".join([*map(_line, rows), "broken"]))
        start_exact(spark, stream_files(spark, str(folder)), *paths, None, lambda: at(2026, 2, 2)).awaitTermination()
    log = read_events(spark, paths[0])
    assert log.count() == 180 and final_events(log).count() == 150
    assert spark.read.parquet(paths[1]).count() == 3

    batch = ru.job_minute_stats(ru.rollup_input(log))
    keys = ["minute", "event_type"]
    got = read_rollup(spark, paths[2], "job_minute_stats")
    assert _counts(got, keys) == _counts(batch, keys) and len(_counts(got, keys)) == 150
    daily = read_rollup(spark, paths[2], "job_daily_stats")
    assert sum(r.cnt for r in daily.collect()) == 150
    workers = ru.worker_minute_stats(ru.rollup_input(log))
    keys = ["minute", "worker_id", "event_type"]
    assert _counts(read_rollup(spark, paths[2], "worker_minute_stats"), keys) == _counts(workers, keys)

    # a replay of everything changes no rollup
    before = _counts(got, ["minute", "event_type"])
    append_events(log.drop("event_day"), paths[0])
    backfill(spark, paths[0], paths[2])
    assert _counts(read_rollup(spark, paths[2], "job_minute_stats"), ["minute", "event_type"]) == before


def test_refresh_rebuilds_named_days_only(spark, events, tmp_path):
    log, root = f"{tmp_path}/log", f"{tmp_path}/rollups"
    append_events(events(("JOB_QUEUED", at(2026, 1, 1, 1)), ("JOB_QUEUED", at(2026, 1, 2, 2))), log)
    backfill(spark, log, root)
    more = events(("JOB_QUEUED", at(2026, 1, 1, 1), dict(event_id="n1")), ("JOB_QUEUED", at(2026, 1, 2, 2), dict(event_id="n2")))
    append_events(more, log)
    refresh(spark, log, root, [date(2026, 1, 2)])
    got = {str(r.day)[:10]: r.cnt for r in read_rollup(spark, root, "job_daily_stats").collect()}
    assert got == {"2026-01-01": 1, "2026-01-02": 2}
    refresh(spark, log, root, [])
    # A commit that died after it removed a folder: the next refresh of the day puts it right.
    shutil.rmtree(f"{root}/job_minute_stats/event_day=2026-01-02")
    refresh(spark, log, root, [date(2026, 1, 2)])
    assert {r.cnt for r in read_rollup(spark, root, "job_minute_stats").collect()} == {1, 2}


def test_one_late_event_does_not_erase_what_the_log_has_dropped(spark, events, tmp_path):
    log, root, now = f"{tmp_path}/log", f"{tmp_path}/rollups", at(2026, 3, 1, 12)
    old = [("JOB_QUEUED", at(2026, 1, 5, 1, n), dict(event_id=f"00000000-0000-4000-8000-{n:012d}")) for n in range(10)]
    append_events(events(*old, ("JOB_QUEUED", at(2026, 2, 20))), log)
    backfill(spark, log, root)
    assert drop_expired(spark, log, 30, now) == [date(2026, 1, 5)] and list(day_folders(spark, log)) == [date(2026, 2, 20)]
    folder = tmp_path / "in"
    folder.mkdir()
    late = {"event_id": "00000000-0000-4000-8000-0000000000aa", "event_type": "JOB_QUEUED", "event_version": 1}
    lines = [json.dumps(late | {"event_time": t}) for t in ("2026-01-05T01:00:00Z", "2026-02-20T05:00:00Z", "2999-01-01T00:00:00Z")]
    (folder / "a.json").write_text("\n".join(lines))
    paths = [log, f"{tmp_path}/rejects", root, f"{tmp_path}/ck"]
    start_exact(spark, stream_files(spark, str(folder)), *paths, None, lambda: now).awaitTermination()
    days = {str(r.day)[:10]: r.cnt for r in read_rollup(spark, root, "job_daily_stats").collect()}
    assert days == {"2026-01-05": 10, "2026-02-20": 2}
    assert [r.event_time.day for r in late_events(spark, root).collect()] == [5]
    assert days_ahead(spark, root) == [date(2999, 1, 1)]


def test_events_of_days_ahead_count_when_their_day_comes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    paths = [f"{tmp_path}/{n}" for n in ("log", "rejects", "rollups", "ck")]

    def run(name, now, *times):
        lines = [json.dumps({"event_id": f"00000000-0000-4000-8000-{abs(hash(t)) % 10**12:012d}", "event_type": "JOB_QUEUED", "event_time": t}) for t in times]
        (folder / name).write_text("\n".join(lines))
        start_exact(spark, stream_files(spark, str(folder)), *paths, None, lambda: now).awaitTermination()
        return {str(r.day)[:10]: r.cnt for r in read_rollup(spark, paths[2], "job_daily_stats").collect()}

    got = run("a.json", at(2026, 1, 1, 12), "2026-01-01T01:00:00Z", "2026-01-09T01:00:00Z", "2026-01-09T02:00:00Z", "2027-05-01T00:00:00Z")
    assert got == {"2026-01-01": 1} and days_ahead(spark, paths[2]) == [date(2026, 1, 9), date(2027, 5, 1)]
    # The day comes with a batch that does not touch it.
    got = run("b.json", at(2026, 1, 9, 3), "2026-01-08T05:00:00Z")
    assert got == {"2026-01-01": 1, "2026-01-08": 1, "2026-01-09": 2} and days_ahead(spark, paths[2]) == [date(2027, 5, 1)]
    got = run("c.json", at(2026, 1, 9, 4), "2026-01-09T03:30:00Z")
    assert got["2026-01-09"] == 3 and late_events(spark, paths[2]).isEmpty()


def test_deltas_count_late_events_and_list_them(spark, events, tmp_path):
    folder, gate = f"{tmp_path}/in", f"{tmp_path}/gate"

    def run():
        given = spark.readStream.schema(EVENT).parquet(folder)
        start_gate(given, gate, f"{tmp_path}/ck-gate", timedelta(hours=2), None).awaitTermination()
        start_deltas(stream_on_time(spark, gate), f"{tmp_path}/parts", f"{tmp_path}/ck", "2 hours", None).awaitTermination()

    events(("JOB_QUEUED", at(2026, 1, 1, 23, 50), dict(event_id="a"))).write.parquet(folder)
    run()
    events(("JOB_QUEUED", at(2020, 1, 1), dict(event_id="b")), ("JOB_QUEUED", at(2026, 1, 1, 23, 50), dict(event_id="a"))).write.mode("append").parquet(folder)
    run()
    assert sorted(r.cnt for r in read_deltas(spark, f"{tmp_path}/parts", gate).collect()) == [1, 1]
    assert [r.event_id for r in read_late(spark, gate).collect()] == ["b"]


def test_a_crash_between_log_and_checkpoint_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(_line(i) for i in range(30)))
    log, rejects, ck = f"{tmp_path}/log", f"{tmp_path}/rejects", f"{tmp_path}/ck"
    whole = ingest.ingest_batch

    def breaks(*args):
        whole(*args)
        raise RuntimeError("the driver dies here")

    monkeypatch.setattr(ingest, "ingest_batch", breaks)
    with pytest.raises(StreamingQueryException, match="the driver dies here"):
        start_ingest(stream_files(spark, str(folder)), log, rejects, ck, None).awaitTermination()
    assert read_events(spark, log).count() == 30
    monkeypatch.setattr(ingest, "ingest_batch", whole)
    start_ingest(stream_files(spark, str(folder)), log, rejects, ck, None).awaitTermination()
    assert read_events(spark, log).count() == 60 and final_events(read_events(spark, log)).count() == 30
    start_ingest(stream_files(spark, str(folder)), log, rejects, ck, None).awaitTermination()
    assert read_events(spark, log).count() == 60


def test_ingest_twice_gives_the_same_log(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(_line(i) for i in range(30)) + '\n{"event_type":"X"}')
    log, rejects = f"{tmp_path}/log", f"{tmp_path}/rejects"
    for ck in ("one", "two"):
        start_ingest(stream_files(spark, str(folder)), log, rejects, f"{tmp_path}/{ck}", None).awaitTermination()
    assert read_events(spark, log).count() == 60
    assert final_events(read_events(spark, log)).count() == 30
    assert {r.reason for r in spark.read.parquet(rejects).collect()} == {"empty_event_id"}


def test_the_whole_log_comes_in_again_after_expiry(spark, monkeypatch):
    given, deal = [], queries._in_batches
    monkeypatch.setattr(queries, "_in_batches", lambda rows, *args: (given.append(rows.count()), deal(rows, *args)))
    rows = queries.late_after_expiry(spark, "/root/testdata/sf0.001")
    events = queries.td.events(spark, "/root/testdata/sf0.001")
    assert given == [events.count()]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, ru.job_minute_stats(ru.rollup_input(events)).select(*rows.columns).collect()))
