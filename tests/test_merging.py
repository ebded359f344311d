"""Tables that are merged or changed while others read them, and what crashes leave behind."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from jobtrail.operators.dedupe import final_events
from jobtrail.operators.jobs import apply_transitions
from jobtrail.schema import JOB
from jobtrail.sinks import compaction, snapshot
from jobtrail.sinks.event_log import append_events, read_events
from jobtrail.streaming import parts
from jobtrail.streaming.storage import names
from tests.conftest import at

SCHEMA = "k string, n bigint"


def by_key(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def put(spark, path, batch, *rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def table(spark, path):
    return sorted(map(tuple, by_key(parts.read_parts(spark, path, SCHEMA)).collect()))


def dies(*args):
    raise RuntimeError("the driver dies here")


def test_folding_parts(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    assert table(spark, path) == [] and parts.fold(spark, path, by_key, SCHEMA) == -1
    put(spark, path, 0, ("a", 1), ("b", 2))
    put(spark, path, 1, ("a", 10))
    put(spark, path, 2)
    want = [("a", 11), ("b", 2)]
    before = by_key(parts.read_parts(spark, path, SCHEMA))

    with monkeypatch.context() as m:  # before the rename
        m.setattr(parts, "move", dies)
        with pytest.raises(RuntimeError):
            parts.fold(spark, path, by_key, SCHEMA)
    assert table(spark, path) == want and parts.folded_upto(spark, path) == -1
    assert parts.fold(spark, path, by_key, SCHEMA) == 2 and table(spark, path) == want
    assert sorted(map(tuple, before.collect())) == want  # a reader from before the fold
    put(spark, path, 1, ("a", 10))  # a folded part is written again by a batch that is retried
    assert table(spark, path) == want
    put(spark, path, 3, ("b", 5))
    assert table(spark, path) == [("a", 11), ("b", 7)]
    with monkeypatch.context() as m:  # in the middle of a sweep
        removed = []
        m.setattr(parts, "remove", lambda s, p: removed.append(p) if not removed else dies())
        with pytest.raises(RuntimeError):
            parts.sweep(spark, path)
    parts.sweep(spark, path)
    assert table(spark, path) == [("a", 11), ("b", 7)]
    assert [n for n in names(spark, path) if n.startswith("batch")] == ["batch_id=3"]


def test_a_part_that_is_being_written_is_not_folded(spark, tmp_path):
    path = f"{tmp_path}/t"
    for batch in range(4):
        put(spark, path, batch, ("a", 1))
    (tmp_path / "t" / "batch_id=2" / "_SUCCESS").unlink()
    assert parts.fold(spark, path, by_key, SCHEMA) == 1 and table(spark, path) == [("a", 4)]
    put(spark, path, 2, ("a", 1))
    assert parts.fold(spark, path, by_key, SCHEMA) == 3 and table(spark, path) == [("a", 4)]
    parts.sweep(spark, path)
    assert names(spark, f"{path}/_folded") == ["upto=3"] and table(spark, path) == [("a", 4)]


def test_two_folds_at_a_time(spark, tmp_path):
    path = f"{tmp_path}/t"
    put(spark, path, 0, ("a", 1))

    def slow(rows):
        parts.fold(spark, path, by_key, SCHEMA)
        return by_key(rows)

    with pytest.raises(FileExistsError):
        parts.fold(spark, path, slow, SCHEMA)
    assert table(spark, path) == [("a", 1)]


def log_of(events, path):
    for batch in range(5):
        rows = [("JOB_QUEUED", at(2026, 1, 1 + i % 2, 1) + timedelta(minutes=10 * batch + i), dict(event_id=f"b{batch}-{i}")) for i in range(6)]
        append_events(events(*rows, *rows[:2]), path)


def test_merging_the_files_of_days(spark, events, tmp_path, monkeypatch):
    path, days = f"{tmp_path}/log", [date(2026, 1, 1), date(2026, 1, 2)]
    log_of(events, path)
    files = lambda: {r.event_day.day: r.files for r in compaction.files_per_day(spark, path).collect()}
    final = lambda: sorted(map(tuple, final_events(read_events(spark, path)).collect()))
    want = final()
    assert len(want) == 30 and min(files().values()) >= 5

    class Dies:
        hex = property(dies)

    with monkeypatch.context() as m:  # merged files are there, their list is not
        m.setattr(compaction.uuid, "uuid4", Dies)
        with pytest.raises(RuntimeError):
            compaction.merge_days(spark, path, days)
    assert final() == want and compaction.remove_merged(spark, path) == 0
    merged = compaction.merge_days(spark, path, days)
    assert merged >= 12 and final() == want
    late = ("JOB_QUEUED", at(2026, 1, 1, 5), dict(event_id="late"))
    append_events(events(late), path)  # arrives before the old files are gone
    with monkeypatch.context() as m:
        m.setattr(compaction, "remove", dies)
        with pytest.raises(RuntimeError):
            compaction.remove_merged(spark, path)
    assert compaction.remove_merged(spark, path) == merged
    assert read_events(spark, path).count() == 31 and len(final()) == 31
    assert sum(files().values()) <= 5
    assert compaction.merge_days(spark, path, [date(2026, 1, 2)], least=9) == 0 == compaction.merge_days(spark, path, [])


def by_id(df):
    return sorted((r.job_id, r.state, r.attempt) for r in df.collect())


def test_only_touched_buckets_are_written(spark, jobs, tmp_path, monkeypatch):
    root, buckets = f"{tmp_path}/jobs", 64
    rows = jobs(*[dict(job_id=f"j{i}") for i in range(1000)])
    assert snapshot.create(rows, root, "job_id", buckets) == 0
    with pytest.raises(FileExistsError):
        snapshot.create(rows, root, "job_id", buckets)
    changes = spark.createDataFrame([(f"j{i}", "QUEUED") for i in range(0, 1000, 100)], "job_id string, new_state string")
    apply = lambda held, u: apply_transitions(held, u, at(2026, 2, 1))
    before = snapshot.read(spark, root, JOB)

    with monkeypatch.context() as m:
        m.setattr(snapshot, "move", dies)
        with pytest.raises(RuntimeError):
            snapshot.update(changes, root, JOB, "job_id", apply, buckets)
    assert by_id(snapshot.read(spark, root, JOB)) == by_id(rows)
    version, touched = snapshot.update(changes, root, JOB, "job_id", apply, buckets)
    assert version == 1 and touched <= 10
    want = by_id(apply(rows, changes))
    assert by_id(snapshot.read(spark, root, JOB)) == want and by_id(before) == by_id(rows)
    assert by_id(snapshot.read(spark, root, JOB, 0)) == by_id(rows)
    old, new = (snapshot._listed(spark, root, v) for v in (0, 1))
    assert sum(old[b] != new[b] for b in old) == touched

    # Rows may come and go; an update without rows changes nothing.
    add = jobs(dict(job_id="new"), dict(job_id="j5", state="FAILED"))
    swap = lambda held, u: held.join(u.select("job_id"), "job_id", "left_anti").select(*held.columns).unionByName(u)
    assert snapshot.update(add, root, JOB, "job_id", swap, buckets)[0] == 2
    got = {r[0]: r[1] for r in by_id(snapshot.read(spark, root, JOB))}
    assert len(got) == 1001 and got["j5"] == "FAILED"
    assert snapshot.update(add.limit(0), root, JOB, "job_id", swap, buckets) == (2, 0)
    with pytest.raises(ValueError, match="no change names"):
        snapshot.update(changes.limit(1), root, JOB, "job_id", lambda held, u: rows, buckets)
    snapshot.sweep(spark, root, keep=1)
    assert len(by_id(snapshot.read(spark, root, JOB))) == 1001 and names(spark, f"{root}/versions") == ["v-2"]


def test_two_updates_at_a_time(spark, jobs, tmp_path):
    root = f"{tmp_path}/jobs"
    snapshot.create(jobs(dict(job_id="a")), root, "job_id", 4)
    changes = spark.createDataFrame([("a", "QUEUED")], "job_id string, new_state string")
    apply = lambda held, u: apply_transitions(held, u, at(2026, 2, 1))

    def meanwhile(held, u):
        snapshot.update(changes, root, JOB, "job_id", apply, 4)
        return held

    with pytest.raises(FileExistsError):
        snapshot.update(changes, root, JOB, "job_id", meanwhile, 4)
    assert by_id(snapshot.read(spark, root, JOB)) == [("a", "QUEUED", 1)]


def test_a_table_without_rows(spark, jobs, tmp_path):
    root = f"{tmp_path}/jobs"
    snapshot.create(jobs(), root, "job_id", 4)
    assert snapshot.read(spark, root, JOB).isEmpty()
    add = jobs(dict(job_id="a"))
    assert snapshot.update(add, root, JOB, "job_id", lambda held, u: held.unionByName(u), 4) == (1, 1)
    assert by_id(snapshot.read(spark, root, JOB)) == [("a", "SCHEDULED", 1)]
