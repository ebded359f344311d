"""The generated tables seen as the job-event data model.

``events`` becomes the event log (with some events delivered twice), ``orders`` the jobs,
``lineitem`` the executions and ``supplier`` the workers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.schema import EVENT_COLUMNS, RETRY_POLICY
from jobtrail.session import configure
from jobtrail.sinks.outbox import event_json, rfc3339, to_outbox


# Declared, so that building a plan starts no job that reads footers.
_TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.schema(_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(pairs: list[tuple[Column, str]], default: str) -> Column:
    out = F.lit(default)
    for cond, value in reversed(pairs):
        out = F.when(cond, F.lit(value)).otherwise(out)
    return out


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generated table as a stream of files."""
    configure(spark)
    return spark.readStream.schema(_TABLES[name]).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def events(spark: SparkSession, sf_dir: str, copies: bool = True, stream: bool = False) -> DataFrame:
    """The raw event log. With ``copies`` every 20th event is delivered a second time."""
    src = (stream_table if stream else table)(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("src_type")
    event_type = _pick(
        [
            (kind == "signup", "JOB_QUEUED"),
            (kind == "view", "JOB_STARTED"),
            (kind == "purchase", "JOB_COMPLETED"),
            ((kind == "error") & (k % 4 == 0), "JOB_FAILED"),
            ((kind == "error") & (k % 4 == 1), "JOB_TIMEOUT"),
            ((kind == "error") & (k % 4 == 2), "JOB_RETRY_SCHEDULED"),
            (kind == "error", "JOB_CANCELLED"),
            (k % 10 == 8, "SCHEDULER_STARTED"),
            (k % 10 == 9, "WORKER_REGISTERED"),
        ],
        "JOB_CREATED",
    )
    etype = F.col("event_type")
    is_job = etype.startswith("JOB_")
    no_worker = (k == 0) | etype.isin("JOB_CREATED", "JOB_QUEUED", "SCHEDULER_STARTED")
    duration = F.concat(F.lit('{"duration_ms":'), F.floor(F.col("value") * 10).cast("string"), F.lit("}"))
    payload = (
        F.when(etype != "JOB_COMPLETED", F.lit("{}"))
        .when(k == 1, F.lit("{}"))
        .when(k == 2, F.lit('{"duration_ms":0}'))
        .otherwise(duration)
    )
    rows = (
        src.withColumnRenamed("event_type", "src_type")
        .withColumn("event_type", event_type)
        .withColumn("event_time", F.date_trunc("MILLISECOND", F.col("ts").cast("timestamp")))
        .select(
            F.col("event_id").cast("string").alias("event_id"),
            "event_type",
            F.lit(1).alias("event_version"),
            "event_time",
            F.col("event_time").alias("ingested_at"),
            F.when(is_job, F.concat(F.lit("j"), F.col("user_id"), F.lit("-"), F.col("event_id") % 10))
            .otherwise("")
            .alias("job_id"),
            F.when(is_job, F.concat(F.lit("x"), F.col("event_id"))).otherwise("").alias("execution_id"),
            F.when(no_worker, "").otherwise(F.concat(F.lit("w"), F.col("user_id") % 12)).alias("worker_id"),
            F.when(etype == "SCHEDULER_STARTED", "scheduler-1").otherwise("").alias("scheduler_id"),
            F.lit(1).cast("bigint").alias("attempt"),
            F.lit("").alias("trace_id"),
            payload.alias("payload"),
            (F.col("event_id") % 20 == 0).alias("_twice"),
        )
    )
    if copies:
        # One scan gives both deliveries: the second one arrives a minute later.
        late = F.explode(F.expr("sequence(0, IF(_twice, 1, 0))"))
        rows = rows.withColumn("_late", late).withColumn(
            "ingested_at", F.col("ingested_at") + F.make_interval(mins=F.col("_late"))
        )
    return rows.select(*EVENT_COLUMNS)


# Fixed values of the mapping, shared with the SQL that checks it.
CRONS = ["0 * * * *", "*/5 * * * *", "30 9 * * *", "0 0 1 * *", "15 6 * * 1", "@daily"]
PAYLOADS = [
    '{"handler":"sleep","args":{"duration_ms":5}}',
    '{"handler":"echo"}',
    '{"handler":"nope"}',
    "{",
    '{"url":"https://hooks.example/a","method":"PUT"}',
    '{"url":"ftp://hooks.example/a"}',
    '{"url":"http://hooks.example/b"}',
]
STATUS_CODES = [200, 204, 404, 429, 500, 503]


def _nth(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _text(prefix: str, col: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.col(col) if isinstance(col, str) else col)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs from orders."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("timestamp")
    by_status = {
        "O": ["SCHEDULED", "RETRYING", "CANCEL_REQUESTED"],
        "P": ["RUNNING", "ASSIGNED", "QUEUED"],
        "F": ["COMPLETED", "FAILED", "TIMEOUT"],
    }
    state = F.lit(None).cast("string")
    for status, states in by_status.items():
        state = F.when(F.col("o_orderstatus") == status, _nth(states, key % 3)).otherwise(state)
    priority = F.lit(3)
    for name, n in {"1-URGENT": 10, "2-HIGH": 8, "3-MEDIUM": 5, "5-LOW": 1}.items():
        priority = F.when(F.col("o_orderpriority") == name, F.lit(n)).otherwise(priority)
    schedule = F.struct(
        _nth(["immediate", "delayed", "one_time", "recurring"], key % 4).alias("type"),
        (day + F.expr("INTERVAL 1 DAY")).alias("run_at"),
        ((key % 100) * 1_000_000_000).alias("delay"),
        _nth(CRONS, cust % 6).alias("cron_expr"),
        F.lit("").alias("timezone"),
    )
    retry = F.struct(
        F.lit(3).alias("max_attempts"),
        F.when(key % 2 == 0, "exponential").otherwise("fixed").alias("backoff_strategy"),
        ((1 + key % 3) * 1_000_000_000).alias("initial_delay"),
        F.when(key % 5 == 0, F.lit(3_000_000_000)).otherwise(F.lit(300_000_000_000)).alias("max_delay"),
        F.lit(2.0).alias("multiplier"),
        (key % 4 == 0).alias("jitter"),
    )
    nothing = F.lit(None).cast("timestamp")
    return o.withColumn("state", state).select(
        _text("o", "o_orderkey").alias("job_id"),
        _text("job-", "o_custkey").alias("name"),
        _nth(["builtin", "builtin", "webhook", "webhook", "shell"], key % 5).alias("type"),
        _nth(PAYLOADS, key % 7).alias("payload"),
        priority.alias("priority"),
        "state",
        schedule.alias("schedule"),
        retry.alias("retry_policy"),
        (1000 * (1 + key % 60)).alias("timeout_ms"),
        F.when(key % 2 == 0, _text("k", "o_orderkey")).otherwise("").alias("idempotency_key"),
        (key % 4).cast("int").alias("attempt"),
        F.lit(3).alias("max_attempts"),
        F.when(cust % 10 == 0, "").otherwise(_text("s", cust % 10)).alias("worker_id"),
        F.when(F.col("state").isin("RUNNING", "ASSIGNED", "CANCEL_REQUESTED"), _text("x", "o_orderkey"))
        .otherwise("")
        .alias("execution_id"),
        F.lit("").alias("last_error"),
        F.when(key % 11 != 0, day).alias("scheduled_at"),
        nothing.alias("queued_at"),
        day.alias("started_at"),
        nothing.alias("completed_at"),
        day.alias("next_retry_at"),
        day.alias("created_at"),
        day.alias("updated_at"),
        F.create_map(F.lit("source"), F.col("o_orderpriority")).alias("metadata"),
    )


def _execution_id() -> Column:
    return F.concat_ws("-", F.lit("e"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executions from lineitem; some were webhook calls."""
    x = table(spark, sf_dir, "lineitem")
    flag, part = F.col("l_returnflag"), F.col("l_partkey")
    code = _nth(STATUS_CODES, part % 6)
    begun = F.col("l_shipdate").cast("timestamp")
    return x.select(
        _execution_id().alias("execution_id"),
        _text("o", "l_orderkey").alias("job_id"),
        _text("s", "l_suppkey").alias("worker_id"),
        F.col("l_linenumber").alias("attempt"),
        F.when(flag == "A", "COMPLETED").when(flag == "R", "FAILED").otherwise("PENDING").alias("state"),
        begun.alias("started_at"),
        F.when(flag != "N", begun).alias("finished_at"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("duration_ms"),
        F.lit(None).cast("string").alias("error"),
        F.when(part % 7 != 6, F.concat(F.lit('{"status_code":'), code, F.lit(',"body":""}'))).alias("output"),
        F.lit(None).cast("boolean").alias("retryable"),
        begun.alias("created_at"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported results from lineitem: several per job, of all kinds. Every 10th is delivered twice."""
    x = table(spark, sf_dir, "lineitem").withColumn("_copy", F.explode(F.expr("sequence(0, IF(l_partkey % 10 = 4, 1, 0))")))
    part, ok = F.col("l_partkey"), F.col("l_returnflag") == "A"
    reason = (
        F.when(part % 11 == 0, "cancelled")
        .when((F.col("l_returnflag") == "N") & (part % 2 == 0), "timeout")
        .when(part % 3 == 0, "")
        .otherwise(F.when(ok, "success").otherwise("failed"))
    )
    return x.select(
        _text("o", "l_orderkey").alias("job_id"),
        _execution_id().alias("execution_id"),
        _text("s", "l_suppkey").alias("worker_id"),
        F.col("l_linenumber").alias("attempt"),
        ok.alias("success"),
        F.lit(None).cast("string").alias("output"),
        F.when(ok, "").otherwise(_text("error ", "l_returnflag")).alias("error"),
        (F.col("l_linestatus") == "O").alias("retryable"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("duration_ms"),
        reason.alias("reason"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue messages from lineitem: one job is delivered several times."""
    return table(spark, sf_dir, "lineitem").select(
        _execution_id().alias("message_id"), _text("o", "l_orderkey").alias("job_id")
    )


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers from supplier; heartbeats are spread over the staleness limits."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    beat = F.timestamp_seconds(F.lit(883612800) - 3 * key)  # 1998-01-01 and before
    return s.select(
        _text("s", "s_suppkey").alias("worker_id"),
        F.concat(F.lit("s"), key, F.lit(":7000")).alias("address"),
        F.when(key % 4 == 2, "SUSPECTED").otherwise("HEALTHY").alias("status"),
        (1 + key % 10).cast("int").alias("capacity"),
        (key % 7).cast("int").alias("active_jobs"),
        F.struct(F.lit(True).alias("builtin"), (key % 2 == 0).alias("webhook")).alias("capabilities"),
        F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("labels"),
        beat.alias("last_heartbeat"),
        (beat - F.expr("INTERVAL 1 DAY")).alias("registered_at"),
        F.create_map(F.lit("name"), F.col("s_name")).alias("metadata"),
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats from events: one per event, for known and unknown workers."""
    e = table(spark, sf_dir, "events")
    return e.select(
        _text("s", "user_id").alias("worker_id"),
        (F.col("event_id") % 12).cast("int").alias("active"),
        (1 + F.col("event_id") % 10).cast("int").alias("capacity"),
        F.date_trunc("MILLISECOND", F.col("ts").cast("timestamp")).alias("ts"),
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox the events went through; a third is published."""
    rows = to_outbox(events(spark, sf_dir, copies=False))
    sent = F.when(F.col("id").cast("bigint") % 3 == 0, F.col("created_at") + F.expr("INTERVAL 1 SECOND"))
    return rows.withColumn("published_at", sent)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job requests from orders: good ones and every kind of mistake."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kinds = ["", "immediate", "delayed", "one_time", "recurring", "recurring", "weekly", "delayed"]
    m = key % 8
    cron = F.when(m == 4, _nth(CRONS, cust % 6)).when(
        m == 5, F.when(cust % 3 == 0, "").when(cust % 3 == 1, "not a cron").otherwise("*/5 * * * *")
    )
    run_at = F.when((m == 3) & (cust % 5 != 0), F.col("o_orderdate").cast("timestamp"))
    delay = F.when(m == 2, (key % 100) * 1_000_000_000).when(m == 7, F.lit(-1_000_000_000))
    schedule = F.struct(
        _nth(kinds, m).alias("type"),
        run_at.alias("run_at"),
        delay.alias("delay"),
        cron.alias("cron_expr"),
        F.lit("").alias("timezone"),
    )
    return o.select(
        _text("r", "o_orderkey").alias("request_id"),
        F.when(cust % 17 == 0, "").otherwise(_text("job-", "o_custkey")).alias("name"),
        _nth(["", "builtin", "webhook", "builtin", "shell", "webhook"], key % 6).alias("type"),
        _nth(PAYLOADS, key % 7).alias("payload"),
        (key % 13).cast("int").alias("priority"),
        schedule.alias("schedule"),
        F.lit(None).cast(f"struct<{RETRY_POLICY}>").alias("retry_policy"),
        (key % 60 - 10).alias("timeout_seconds"),
        F.when(key % 3 == 0, _text("k", "o_custkey")).otherwise("").alias("idempotency_key"),
        F.create_map(F.lit("source"), F.col("o_orderpriority")).alias("metadata"),
    )


def with_uuids(events: DataFrame) -> DataFrame:
    """The events with ids in the form of the message format, which ingestion keeps as they are."""
    digits = F.lpad(F.col("event_id"), 12, "0")
    return events.withColumn("event_id", F.concat(F.lit("00000000-0000-4000-8000-"), digits))


def event_messages(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """The events as raw messages. Some are cut off, some carry no id, some no time."""
    n = F.col("event_id").cast("bigint")
    e = (
        events(spark, sf_dir, stream=stream)
        .withColumn("source_time", F.col("event_time") + F.expr("INTERVAL 2 SECONDS"))
        .withColumn("_n", n)
        .withColumn("event_id", F.when(n % 50 == 7, "").otherwise(F.col("event_id")))
    )
    body = event_json()
    unset = F.regexp_replace(body, r'"event_time":"[^"]*"', '"event_time":"0001-01-01T00:00:00Z"')
    value = (
        F.when(F.col("_n") % 50 == 3, F.substring(body, 1, 40)).when(F.col("_n") % 50 == 11, unset).otherwise(body)
    )
    return e.select(value.alias("value"), "source_time")


def work_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue messages of the jobs as JSON; some are not JSON."""
    j = jobs(spark, sf_dir).withColumn("_n", F.substring("job_id", 2, 20).cast("bigint"))
    body = F.to_json(
        F.struct(
            "job_id",
            "name",
            "type",
            F.base64(F.encode("payload", "UTF-8")).alias("payload"),
            "priority",
            "attempt",
            (F.col("timeout_ms") * 1_000_000).alias("timeout"),
            rfc3339(F.col("created_at")).alias("enqueued_at"),
        )
    )
    return j.select(F.when(F.col("_n") % 40 == 9, "oops").otherwise(body).alias("value"))
