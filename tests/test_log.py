"""Messages, log rows, copies, retention, layout."""

from __future__ import annotations

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from jobtrail.operators.dedupe import count_events, final_events, final_keys
from jobtrail.operators.retention import drop_expired, expired_days, retain
from jobtrail.sinks import event_log, lookup, outbox
from jobtrail.sources import messages as msg
from jobtrail.sources.readers import replay
from tests.conftest import at

NOW = at(2026, 1, 2)
GOOD = (
    '{"event_id":"7F0C0000-0000-4000-8000-000000000001","event_type":"JOB_COMPLETED","event_version":1,'
    '"event_time":"2026-01-01T00:00:00.123456789Z","job_id":"j1","attempt":1,"payload":{"duration_ms":12},"more":1}'
)
MESSAGES = [
    GOOD,
    "not json",
    '{"event_type":"X"}',
    '{"event_id":"a","event_type":"X","attempt":"one"}',
    '{"event_id":"b","event_type":"X","event_time":"0001-01-01T00:00:00Z"}',
    '{"event_id":"c","event_type":"X","event_time":"2026-01-01T05:30:00+05:30"}',
    '{"event_id":"d","event_type":"X","event_time":"yesterday"}',
    "[1]",
    "",
]


def _messages(spark, values=MESSAGES):
    return spark.createDataFrame([(v, at(2026, 1, 1, 6)) for v in values], "value string, source_time timestamp")


def test_decode_and_rejects(spark):
    decoded = msg.decode_events(_messages(spark)).cache()
    good = {r.event_id: r for r in msg.valid_events(decoded).collect()}
    assert set(good) == {"7F0C0000-0000-4000-8000-000000000001", "b", "c"}
    first = good["7F0C0000-0000-4000-8000-000000000001"]
    assert first.payload == '{"duration_ms":12}'
    assert first.event_time.microsecond == 123000
    assert good["b"].event_time is None and good["b"].payload is None  # the log stores {} instead
    reasons = sorted((r.reason, r.raw) for r in msg.rejected_events(decoded).collect())
    assert [r for r, _ in reasons].count("undecodable") == 5
    assert ("empty_event_id", '{"event_type":"X"}') in reasons
    # a replay lets empty ids pass
    assert replay(_messages(spark)).count() == 4
    assert replay(_messages(spark), max_events=2).count() == 2


def test_normalise_repeats_on_replay(spark):
    once = event_log.normalise(msg.valid_events(msg.decode_events(_messages(spark))), NOW)
    again = event_log.normalise(msg.valid_events(msg.decode_events(_messages(spark))), NOW + timedelta(days=1))
    key = ["event_type", "event_time", "event_id"]
    assert once.select(*key).exceptAll(again.select(*key)).count() == 0
    rows = {r.event_type + str(r.event_time): r for r in once.collect()}
    assert len(rows) == 3
    ids = {r.event_id for r in rows.values()}
    assert "7f0c0000-0000-4000-8000-000000000001" in ids and all(len(i) == 36 for i in ids)
    # the unset time is the time the source recorded
    unset = once.filter("event_time = timestamp_millis(1767247200000)").collect()
    assert len(unset) == 1


def test_work_messages(spark):
    import base64

    body = base64.b64encode(b'{"handler":"echo"}').decode()
    df = _messages(spark, [f'{{"job_id":"j","payload":"{body}","timeout":30000000000}}', '{"payload":"***"}', "x"])
    rows = msg.decode_queued_jobs(df).orderBy("reject_reason").collect()
    assert [r.reject_reason for r in rows] == [None, "undecodable", "undecodable"]
    assert rows[0].payload == '{"handler":"echo"}' and rows[0].timeout == 30_000_000_000


def test_newest_copy_wins(events):
    t = at(2026, 1, 1)
    df = events(
        ("A", t, dict(event_id="1", payload="old")),
        ("A", t, dict(event_id="1", payload="new", ingested_at=t + timedelta(minutes=1))),
        ("A", t + timedelta(seconds=1), dict(event_id="1", payload="other time")),
        ("B", t, dict(event_id="1", payload="x")),
        ("B", t, dict(event_id="1", payload="y")),
    )
    assert {r.payload for r in final_events(df).collect()} == {"new", "other time", "y"}
    assert final_keys(df).count() == 3
    assert count_events(df).first().events == 3
    assert count_events(df, "B").first().events == 1


def test_one_event_with_very_many_copies(spark, events):
    t = at(2026, 1, 1)
    df = events(("A", t, dict(event_id="hot")), ("A", t, dict(event_id="cold")))
    many = df.withColumn("no", F.explode(F.expr("sequence(0, IF(event_id = 'hot', 5000, 0))"))).withColumn(
        "ingested_at", F.timestamp_millis(F.unix_millis("ingested_at") + F.col("no"))
    ).drop("no").repartition(8)
    rows = final_events(many).collect()
    assert len(rows) == 2
    # the copies are cut before the shuffle
    plan = final_events(many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_retention(events):
    df = events(("A", at(2026, 1, 1)), ("B", at(2026, 1, 1, 0, 0, 0, 1000)), ("C", at(2025, 12, 1)))
    now = at(2026, 1, 31)
    assert {r.event_type for r in retain(df, "event_time", 30, now).collect()} == {"B"}
    assert retain(df, "event_time", None, now).count() == 3
    days = expired_days(event_log.with_day(df), 30, now).collect()
    assert [str(r.event_day) for r in days] == ["2025-12-01"]


def test_layouts(spark, events, tmp_path):
    df = events(*[("A" if i % 3 else "B", at(2026, 1, 1 + i % 3, i % 24), dict(worker_id=f"w{i % 5}")) for i in range(60)])
    event_log.append_events(df, f"{tmp_path}/log")
    event_log.append_events(df, f"{tmp_path}/log")
    log = event_log.read_events(spark, f"{tmp_path}/log")
    assert log.count() == 120 and final_events(log).count() == 60
    # a window reads its days only
    from jobtrail.operators.timerange import TimeRange, within

    plan = within(log, TimeRange(at(2026, 1, 1), at(2026, 1, 2)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_day" in plan and "GreaterThanOrEqual(event_time" in plan


def test_bucketed_log_needs_no_shuffle(spark, events, tmp_path):
    df = events(*[("A", at(2026, 1, 1, i % 24)) for i in range(50)])
    spark.sql("DROP TABLE IF EXISTS bucketed_log")
    event_log.write_bucketed(df, "bucketed_log", f"{tmp_path}/bucketed", 4)
    log = spark.table("bucketed_log")
    plan = final_events(log)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert final_events(log).count() == 50
    spark.sql("DROP TABLE bucketed_log")


def test_outbox_round_trip(spark, events):
    t = at(2026, 1, 1)
    df = events(
        ("JOB_QUEUED", t, dict(job_id="j1", payload='{"a":1}')),
        ("WORKER_REGISTERED", t, dict(worker_id="w1")),
        ("SCHEDULER_STARTED", t, dict(scheduler_id="s1")),
        ("OTHER", t),
    )
    box = outbox.to_outbox(df).cache()
    routes = {r.id: (r.topic, r.key) for r in outbox.route(box).collect()}
    assert routes == {
        "e0": ("job.events", "j1"), "e1": ("worker.events", "e1"),
        "e2": ("scheduler.events", "e2"), "e3": ("job.events", "e3"),
    }
    keys = {r.id: r.key for r in outbox.route(box, entity_key=True).collect()}
    assert (keys["e1"], keys["e2"]) == ("w1", "s1")
    back = msg.decode_events(box.select(F.col("payload").alias("value")))
    assert back.filter("reject_reason IS NULL").count() == 4
    assert back.filter("event_id = 'e0'").first().payload == '{"a":1}'
    done = outbox.mark_published(box, box.filter("id = 'e0'"), NOW)
    assert done.filter("published_at IS NULL").count() == 3


def test_event_json_keeps_what_the_format_keeps(events):
    rows = events(("JOB_QUEUED", at(2026, 1, 1), dict(payload=None, event_id="a")), ("JOB_QUEUED", None, dict(event_id="b", ingested_at=at(2026, 1, 2))))
    got = {json.loads(r.value)["event_id"]: json.loads(r.value) for r in outbox.replay_lines(rows).collect()}
    assert "payload" not in got["a"] and got["a"]["ingested_at"] == "2026-01-01T00:00:00Z"
    assert got["b"]["event_time"] == "0001-01-01T00:00:00Z" and got["b"]["payload"] == {}


def test_bounded_replay_takes_the_earliest(spark):
    line = '{"event_id":"%d","event_type":"JOB_QUEUED","event_time":"2026-01-01T00:00:00Z"}'
    rows = [(line % i, at(2026, 1, 1 + (7 * i) % 20)) for i in range(20)]
    messages = spark.createDataFrame(rows, "value string, source_time timestamp").repartition(5)
    want = [str(i) for i in sorted(range(20), key=lambda i: (7 * i) % 20)[:6]]
    assert sorted(r.event_id for r in replay(messages, 6).collect()) == sorted(want)
    assert replay(messages, 0).count() == replay(messages).count() == 20


def test_an_id_is_found_in_a_few_files(spark, events, tmp_path):
    path, index = f"{tmp_path}/log", f"{tmp_path}/index"
    for day in range(1, 25):
        rows = [("JOB_QUEUED", at(2026, 1, day, i), dict(event_id=f"{day}-{i}", job_id=f"j{day}-{i}", trace_id=f"t{i}", worker_id=f"w{day % 12}")) for i in range(8)]
        event_log.append_events(events(*rows), path)
    every = lookup.log_files(spark, path)
    assert lookup.index_log(spark, path, index) == len(every) >= 24 and lookup.index_log(spark, path, index) == 0
    for column, value, share in (("job_id", "j7-3", 0.1), ("worker_id", "w5", 0.2), ("job_id", "unknown", 0.0), ("trace_id", "t2", 1.0)):
        assert len(lookup.files_of(spark, path, index, column, value)) <= share * len(every)
        found = lookup.find_events(spark, path, index, column, value)
        want = event_log.read_events(spark, path).filter(F.col(column) == value)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    # Files that came after the index, and files that went.
    event_log.append_events(events(("JOB_STARTED", at(2026, 2, 1), dict(event_id="new", job_id="j7-3"))), path)
    assert lookup.find_events(spark, path, index, "job_id", "j7-3").count() == 2
    assert lookup.index_log(spark, path, index) == 1
    drop_expired(spark, path, 10, at(2026, 1, 30))
    assert [r.event_id for r in lookup.find_events(spark, path, index, "job_id", "j7-3").collect()] == ["new"]
    with pytest.raises(ValueError):
        lookup.find_events(spark, path, index, "job_id", "")
