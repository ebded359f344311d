"""The SQL that checks the queries: standard SQL over the same tables, written independently."""

from __future__ import annotations

from jobtrail.sources.testdata import CRONS, PAYLOADS, STATUS_CODES

WHOLE = "event_time >= TIMESTAMP '2024-01-01' AND event_time < TIMESTAMP '2024-02-01'"
LOG_NOW = "TIMESTAMP '2024-02-10 12:00:00'"
JOBS_NOW = "TIMESTAMP '1998-01-01 00:00:30'"
WORKERS_NOW = "TIMESTAMP '1998-01-01 00:00:00'"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _nth(values: list, index: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {_quote(v) if isinstance(v, str) else v}" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


# --- common tables ----------------------------------------------------------------------------

EV = """
src AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         date_trunc('millisecond', ts) AS event_time
  FROM events),
typed AS (
  SELECT *, CASE
      WHEN event_type = 'signup' THEN 'JOB_QUEUED'
      WHEN event_type = 'view' THEN 'JOB_STARTED'
      WHEN event_type = 'purchase' THEN 'JOB_COMPLETED'
      WHEN event_type = 'error' AND k % 4 = 0 THEN 'JOB_FAILED'
      WHEN event_type = 'error' AND k % 4 = 1 THEN 'JOB_TIMEOUT'
      WHEN event_type = 'error' AND k % 4 = 2 THEN 'JOB_RETRY_SCHEDULED'
      WHEN event_type = 'error' THEN 'JOB_CANCELLED'
      WHEN k % 10 = 8 THEN 'SCHEDULER_STARTED'
      WHEN k % 10 = 9 THEN 'WORKER_REGISTERED'
      ELSE 'JOB_CREATED' END AS kind
  FROM src),
ev AS (
  SELECT event_id AS n, CAST(event_id AS VARCHAR) AS event_id, kind AS event_type, event_time,
    event_time AS ingested_at,
    CASE WHEN kind LIKE 'JOB%' THEN 'j' || user_id || '-' || (event_id % 10) ELSE '' END AS job_id,
    CASE WHEN kind LIKE 'JOB%' THEN 'x' || event_id ELSE '' END AS execution_id,
    CASE WHEN k = 0 OR kind IN ('JOB_CREATED', 'JOB_QUEUED', 'SCHEDULER_STARTED') THEN ''
         ELSE 'w' || (user_id % 12) END AS worker_id,
    CASE WHEN kind = 'SCHEDULER_STARTED' THEN 'scheduler-1' ELSE '' END AS scheduler_id,
    CASE WHEN kind <> 'JOB_COMPLETED' THEN '{}' WHEN k = 1 THEN '{}' WHEN k = 2 THEN '{"duration_ms":0}'
         ELSE '{"duration_ms":' || CAST(floor(value * 10) AS BIGINT) || '}' END AS payload
  FROM typed),
raw AS (
  SELECT * FROM ev
  UNION ALL
  SELECT * REPLACE (ingested_at + INTERVAL 1 MINUTE AS ingested_at) FROM ev WHERE n % 20 = 0),
timed AS (
  SELECT *, CASE WHEN event_type = 'JOB_COMPLETED'
      THEN greatest(coalesce(TRY_CAST(json_extract_string(payload, '$.duration_ms') AS BIGINT), 0), 0) END AS ms
  FROM raw),
fin AS (
  SELECT * EXCLUDE (copy_no) FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type, event_time, event_id ORDER BY ingested_at DESC) AS copy_no
    FROM timed) WHERE copy_no = 1)
"""

JOBS = f"""
states AS (
  SELECT *, CASE o_orderstatus
      WHEN 'O' THEN {_nth(['SCHEDULED', 'RETRYING', 'CANCEL_REQUESTED'], 'o_orderkey % 3')}
      WHEN 'P' THEN {_nth(['RUNNING', 'ASSIGNED', 'QUEUED'], 'o_orderkey % 3')}
      WHEN 'F' THEN {_nth(['COMPLETED', 'FAILED', 'TIMEOUT'], 'o_orderkey % 3')} END AS state
  FROM orders),
jobs AS (
  SELECT o_orderkey AS no, o_custkey AS cust, 'o' || o_orderkey AS job_id, 'job-' || o_custkey AS name,
    {_nth(['builtin', 'builtin', 'webhook', 'webhook', 'shell'], 'o_orderkey % 5')} AS type,
    {_nth(PAYLOADS, 'o_orderkey % 7')} AS payload,
    CASE o_orderpriority WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 8 WHEN '3-MEDIUM' THEN 5
      WHEN '5-LOW' THEN 1 ELSE 3 END AS priority,
    state,
    {_nth(['immediate', 'delayed', 'one_time', 'recurring'], 'o_orderkey % 4')} AS schedule_type,
    o_orderdate + INTERVAL 1 DAY AS run_at,
    o_orderkey % 100 AS delay_s,
    {_nth(CRONS, 'o_custkey % 6')} AS cron_expr,
    CASE WHEN o_orderkey % 2 = 0 THEN 'exponential' ELSE 'fixed' END AS strategy,
    (1 + o_orderkey % 3) * 1000 AS initial_ms,
    CASE WHEN o_orderkey % 5 = 0 THEN 3000 ELSE 300000 END AS cap_ms,
    o_orderkey % 4 = 0 AS jitter,
    1000 * (1 + o_orderkey % 60) AS timeout_ms,
    CASE WHEN o_orderkey % 2 = 0 THEN 'k' || o_orderkey ELSE '' END AS idempotency_key,
    o_orderkey % 4 AS attempt, 3 AS max_attempts,
    CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 's' || (o_custkey % 10) END AS worker_id,
    CASE WHEN state IN ('RUNNING', 'ASSIGNED', 'CANCEL_REQUESTED') THEN 'x' || o_orderkey ELSE '' END AS execution_id,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS scheduled_at,
    o_orderdate AS started_at, o_orderdate AS next_retry_at, o_orderdate AS created_at, o_orderdate AS updated_at,
    o_orderpriority AS source
  FROM states)
"""

_EXEC_ID = "'e-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"

EXECUTIONS = f"""
executions AS (
  SELECT {_EXEC_ID} AS execution_id, 'o' || l_orderkey AS job_id,
    CASE l_returnflag WHEN 'A' THEN 'COMPLETED' WHEN 'R' THEN 'FAILED' ELSE 'PENDING' END AS state,
    CASE WHEN l_returnflag <> 'N' THEN l_shipdate END AS finished_at,
    CAST(l_quantity * 1000 AS BIGINT) AS duration_ms,
    CASE WHEN l_partkey % 7 <> 6 THEN {_nth(STATUS_CODES, 'l_partkey % 6')} END AS status_code
  FROM lineitem)
"""

RESULTS = f"""
results AS (
  -- Rows of equal job, attempt and execution are copies of one result; the least is taken.
  SELECT DISTINCT ON (job_id, attempt, execution_id)
    'o' || l_orderkey AS job_id, {_EXEC_ID} AS execution_id, l_linenumber AS attempt,
    l_returnflag = 'A' AS success,
    CASE WHEN l_returnflag = 'A' THEN '' ELSE 'error ' || l_returnflag END AS error,
    l_linestatus = 'O' AS retryable, CAST(l_quantity * 1000 AS BIGINT) AS duration_ms,
    CASE WHEN l_partkey % 11 = 0 THEN 'cancelled'
         WHEN l_returnflag = 'N' AND l_partkey % 2 = 0 THEN 'timeout'
         WHEN l_returnflag = 'A' THEN 'success' ELSE 'failed' END AS reason
  FROM lineitem ORDER BY job_id, attempt, execution_id, 's' || l_suppkey, success, error, retryable, duration_ms, reason)
"""

BACKOFF = """least(cap_ms, CASE WHEN strategy = 'exponential'
  THEN initial_ms * pow(2.0, {attempt} - 1) ELSE initial_ms END)"""

DECIDED = f"""
acted AS (
  SELECT r.*, j.job_id IS NOT NULL AS known, j.max_attempts, j.strategy, j.initial_ms, j.cap_ms,
    row_number() OVER (PARTITION BY r.job_id ORDER BY r.attempt, r.execution_id) AS place,
    CASE WHEN j.state IS NULL THEN 'unknown_job'
      WHEN j.state IN ('COMPLETED', 'FAILED', 'CANCELLED', 'TIMEOUT', 'EXPIRED') THEN 'ignored'
      WHEN r.reason = 'cancelled' OR j.state = 'CANCEL_REQUESTED' THEN 'cancelled'
      WHEN r.success THEN 'completed'
      WHEN r.reason = 'timeout' THEN CASE WHEN r.attempt < j.max_attempts THEN 'timeout_retry' ELSE 'timeout' END
      WHEN r.retryable AND r.attempt < j.max_attempts THEN 'failure_retry'
      ELSE 'failure' END AS first_action
  FROM results r LEFT JOIN jobs j ON r.job_id = j.job_id),
ended AS (
  SELECT *, min(CASE WHEN first_action IN ('cancelled', 'completed', 'timeout', 'failure') THEN place END)
    OVER (PARTITION BY job_id) AS last_place
  FROM acted),
decided AS (
  SELECT *, CASE WHEN first_action <> 'unknown_job' AND place > last_place THEN 'ignored'
    ELSE first_action END AS action FROM ended),
outcome AS (
  SELECT *,
    CASE action WHEN 'cancelled' THEN 'CANCELLED' WHEN 'completed' THEN 'COMPLETED' WHEN 'timeout' THEN 'TIMEOUT'
      WHEN 'failure' THEN 'FAILED' WHEN 'timeout_retry' THEN 'RETRYING' WHEN 'failure_retry' THEN 'RETRYING' END
      AS job_state,
    CASE action WHEN 'cancelled' THEN 'CANCELLED' WHEN 'completed' THEN 'COMPLETED' WHEN 'timeout' THEN 'TIMEOUT'
      WHEN 'failure' THEN 'FAILED' WHEN 'timeout_retry' THEN 'TIMEOUT' WHEN 'failure_retry' THEN 'FAILED' END
      AS execution_state,
    CASE WHEN action IN ('timeout_retry', 'failure_retry')
      THEN CAST({BACKOFF.format(attempt='attempt')} AS BIGINT) END AS delay_ms
  FROM decided)
"""

WORKERS = """
workers AS (
  SELECT s_suppkey AS no, 's' || s_suppkey AS worker_id, 's' || s_suppkey || ':7000' AS address,
    CASE WHEN s_suppkey % 4 = 2 THEN 'SUSPECTED' ELSE 'HEALTHY' END AS status,
    1 + s_suppkey % 10 AS capacity, s_suppkey % 7 AS active_jobs,
    TIMESTAMP '1998-01-01' - to_seconds(3 * s_suppkey) AS last_heartbeat,
    TIMESTAMP '1998-01-01' - to_seconds(3 * s_suppkey) - INTERVAL 1 DAY AS registered_at
  FROM supplier)
"""

BEATS = """
beats AS (
  SELECT 's' || user_id AS worker_id, event_id % 12 AS active, 1 + event_id % 10 AS capacity,
    date_trunc('millisecond', ts) AS ts,
    row_number() OVER (PARTITION BY user_id
      ORDER BY date_trunc('millisecond', ts) DESC, event_id % 12 DESC, 1 + event_id % 10 DESC) AS back
  FROM events)
"""

MESSAGES = """
arrived AS (
  SELECT n, n % 50 = 3 AS cut_off, n % 50 = 7 AS no_id, n % 50 = 11 AS no_time,
    event_id, event_type, event_time AS sent_at, job_id, worker_id, payload,
    event_time + INTERVAL 2 SECOND AS source_time
  FROM raw)
"""

_TIME_TEXT = "regexp_replace(strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f'), '[.]?0*$', '') || 'Z'"

# The text of the messages, field by field.
WIRE = f"""
wired AS (
  SELECT *, '{{"event_id":"' || CASE WHEN n % 50 = 7 THEN '' ELSE event_id END || '","event_type":"' || event_type
      || '","event_version":1,"event_time":"'
      || CASE WHEN n % 50 = 11 THEN '0001-01-01T00:00:00Z' ELSE {_TIME_TEXT} END || '"'
      || CASE WHEN job_id <> '' THEN ',"job_id":"' || job_id || '","execution_id":"' || execution_id || '"' ELSE '' END
      || CASE WHEN worker_id <> '' THEN ',"worker_id":"' || worker_id || '"' ELSE '' END
      || CASE WHEN scheduler_id <> '' THEN ',"scheduler_id":"' || scheduler_id || '"' ELSE '' END
      || ',"attempt":1,"payload":' || payload || '}}' AS body
  FROM raw)
"""

_REQ_TYPE = "CASE WHEN kind = '' THEN 'builtin' ELSE kind END"


def _next_cron(at: str, expr: str) -> str:
    """The next run of the expressions in CRONS after a time, in closed form."""
    morning = f"date_trunc('day', {at}) + INTERVAL 570 MINUTE"
    monday = f"date_trunc('week', {at}) + INTERVAL 375 MINUTE"
    runs = {
        "0 * * * *": f"date_trunc('hour', {at}) + INTERVAL 1 HOUR",
        "*/5 * * * *": f"date_trunc('hour', {at}) + to_minutes(5 * (CAST(date_part('minute', {at}) AS BIGINT) // 5 + 1))",
        "30 9 * * *": f"CASE WHEN {morning} > {at} THEN {morning} ELSE {morning} + INTERVAL 1 DAY END",
        "0 0 1 * *": f"date_trunc('month', {at}) + INTERVAL 1 MONTH",
        "15 6 * * 1": f"CASE WHEN {monday} > {at} THEN {monday} ELSE {monday} + INTERVAL 7 DAY END",
        "@daily": f"date_trunc('day', {at}) + INTERVAL 1 DAY",
    }
    arms = " ".join(f"WHEN {_quote(c)} THEN {sql}" for c, sql in runs.items())
    return f"CASE {expr} {arms} END"


REQUESTS = f"""
asked AS (
  SELECT o_orderkey AS no, 'r' || o_orderkey AS request_id,
    CASE WHEN o_custkey % 17 = 0 THEN '' ELSE 'job-' || o_custkey END AS name,
    {_nth(['', 'builtin', 'webhook', 'builtin', 'shell', 'webhook'], 'o_orderkey % 6')} AS kind,
    o_orderkey % 13 AS asked_priority,
    {_nth(['', 'immediate', 'delayed', 'one_time', 'recurring', 'recurring', 'weekly', 'delayed'], 'o_orderkey % 8')}
      AS schedule_type,
    CASE WHEN o_orderkey % 8 = 3 AND o_custkey % 5 <> 0 THEN o_orderdate END AS run_at,
    CASE o_orderkey % 8 WHEN 2 THEN o_orderkey % 100 WHEN 7 THEN -1 ELSE 0 END AS delay_s,
    CASE o_orderkey % 8 WHEN 4 THEN {_nth(CRONS, 'o_custkey % 6')}
      WHEN 5 THEN CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'not a cron' ELSE '*/5 * * * *' END END AS cron_expr,
    CASE WHEN o_orderkey % 60 - 10 > 0 THEN o_orderkey % 60 - 10 ELSE 30 END * 1000 AS timeout_ms
  FROM orders),
checked AS (
  SELECT *, CASE
      WHEN name = '' THEN 'name required'
      WHEN kind NOT IN ('', 'builtin', 'webhook') THEN 'type must be builtin or webhook'
      WHEN asked_priority > 10 THEN 'priority must be 1-10'
      WHEN schedule_type = 'one_time' AND run_at IS NULL THEN 'run_at required'
      WHEN schedule_type = 'recurring' AND cron_expr = '' THEN 'cron_expr required for recurring'
      WHEN schedule_type = 'recurring' AND cron_expr = 'not a cron' THEN 'cron_expr: invalid expression not a cron'
      WHEN schedule_type = 'weekly' THEN 'unknown schedule type "weekly"' END AS error
  FROM asked),
planned AS (
  SELECT *, CASE schedule_type
      WHEN 'delayed' THEN {JOBS_NOW} + to_seconds(delay_s)
      WHEN 'one_time' THEN run_at
      WHEN 'recurring' THEN {_next_cron(JOBS_NOW, 'cron_expr')}
      ELSE {JOBS_NOW} END AS scheduled_at
  FROM checked WHERE error IS NULL)
"""

DUE = f"""((state = 'SCHEDULED' AND scheduled_at <= {JOBS_NOW})
  OR (state = 'RETRYING' AND next_retry_at <= {JOBS_NOW}))"""

LOST = f"worker_id IN (SELECT worker_id FROM workers WHERE last_heartbeat < {WORKERS_NOW} - INTERVAL 25 SECOND)"

_COUNTERS = """count(*) AS cnt, CAST(coalesce(sum(ms), 0) AS BIGINT) AS duration_sum,
  count(CASE WHEN ms > 0 THEN 1 END) AS duration_count"""


def _n(kind: str, name: str) -> str:
    return f"count(CASE WHEN event_type = '{kind}' THEN 1 END) AS {name}"


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


def _log(body: str) -> str:
    return f"WITH {EV} {body}"


def _with(*parts_and_body: str) -> str:
    *parts, body = parts_and_body
    return f"WITH {','.join(parts)} {body}"


def _throughput(grain: str, seconds: int) -> str:
    return _log(f"""SELECT *, CAST(completed AS DOUBLE) / CAST({seconds} AS DOUBLE) AS rate_per_sec FROM (
      SELECT date_trunc('{grain}', event_time) AS bucket, {_n('JOB_COMPLETED', 'completed')},
        {_n('JOB_FAILED', 'failed')}, {_n('JOB_CREATED', 'created')}
      FROM fin WHERE {WHOLE} GROUP BY 1)""")


TOTALS = _log(f"""SELECT *, CAST(completed AS DOUBLE) / CAST(2678400 AS DOUBLE) AS avg_rate FROM (
  SELECT {_n('JOB_COMPLETED', 'completed')}, {_n('JOB_FAILED', 'failed')}, {_n('JOB_CREATED', 'created')}
  FROM fin WHERE {WHOLE})""")

OUTCOMES = ("'JOB_COMPLETED', 'JOB_FAILED', 'JOB_TIMEOUT', 'JOB_CANCELLED', 'JOB_RETRY_SCHEDULED'")
OUTCOME_COUNTS = _log(f"""SELECT event_type, count(*) AS cnt FROM fin
  WHERE {WHOLE} AND event_type IN ({OUTCOMES}) GROUP BY 1""")

RATES = _log(f"""SELECT
    {_ratio('c', '(c + f + t + x)')} AS success_rate, {_ratio('f', '(c + f + t + x)')} AS failure_rate,
    {_ratio('t', '(c + f + t + x)')} AS timeout_rate, {_ratio('x', '(c + f + t + x)')} AS cancel_rate,
    CASE WHEN c + f + t > 0 THEN {_ratio('r', '(c + f + t + r)')} ELSE CAST(0 AS DOUBLE) END AS retry_rate
  FROM (SELECT {_n('JOB_COMPLETED', 'c')}, {_n('JOB_FAILED', 'f')}, {_n('JOB_TIMEOUT', 't')},
    {_n('JOB_CANCELLED', 'x')}, {_n('JOB_RETRY_SCHEDULED', 'r')} FROM fin WHERE {WHOLE})""")

FAILURES = _log(f"""SELECT date_trunc('minute', event_time) AS bucket, {_n('JOB_FAILED', 'failed')},
    {_n('JOB_TIMEOUT', 'timeout')}, {_n('JOB_RETRY_SCHEDULED', 'retry')}
  FROM fin WHERE {WHOLE} GROUP BY 1""")

PEAKS = _log(f"""SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS completed, coalesce(max(c), 0) AS peak_per_minute,
    coalesce(avg(c), CAST(0 AS DOUBLE)) AS avg_per_minute
  FROM (SELECT date_trunc('minute', event_time) AS m, {_n('JOB_COMPLETED', 'c')} FROM fin WHERE {WHOLE} GROUP BY 1)""")

PAIRS = f"""pairs AS (
  SELECT q.job_id, q.t AS queued_at, s.t AS started_at, epoch_ms(s.t) - epoch_ms(q.t) AS wait_ms
  FROM (SELECT job_id, min(event_time) AS t FROM fin
        WHERE event_type = 'JOB_QUEUED' AND job_id <> '' AND {WHOLE} GROUP BY 1) q
  JOIN (SELECT job_id, min(event_time) AS t FROM fin
        WHERE event_type = 'JOB_STARTED' AND job_id <> '' AND {WHOLE} GROUP BY 1) s ON q.job_id = s.job_id
  WHERE s.t >= q.t)"""


def _snap(windows: dict[str, tuple[str, str]]) -> str:
    parts = []
    for name, (lo, hi) in windows.items():
        parts.append(f"""SELECT '{name}' AS win, {_n('JOB_COMPLETED', 'done')}, {_n('JOB_FAILED', 'failed')},
          coalesce(quantile_cont(ms, 0.95), 0) AS p95,
          CAST(date_diff('second', TIMESTAMP '{lo}', TIMESTAMP '{hi}') AS DOUBLE) AS seconds
        FROM fin WHERE event_time >= TIMESTAMP '{lo}' AND event_time < TIMESTAMP '{hi}'""")
    return f"""snaps AS (SELECT win, CAST(p95 AS DOUBLE) AS p95_latency_ms,
        {_ratio('failed', '(done + failed)')} AS failure_rate,
        CAST(done AS DOUBLE) / seconds AS throughput_per_sec
      FROM ({' UNION ALL '.join(parts)}))"""


SNAPSHOTS = _with(
    EV,
    _snap({"current": ("2024-01-16", "2024-01-31"), "baseline": ("2024-01-01", "2024-01-16")}),
    "SELECT * FROM snaps",
)

ANOMALIES = _with(
    EV,
    _snap({"current": ("2024-01-30", "2024-02-28"), "baseline": ("2024-01-01", "2024-01-30")}),
    """compared AS (
      SELECT m.metric, m.warn, m.crit, m.high_bad,
        max(CASE WHEN win = 'baseline' THEN CASE m.metric WHEN 'p95_latency_ms' THEN p95_latency_ms
          WHEN 'failure_rate' THEN failure_rate ELSE throughput_per_sec END END) AS baseline,
        max(CASE WHEN win = 'current' THEN CASE m.metric WHEN 'p95_latency_ms' THEN p95_latency_ms
          WHEN 'failure_rate' THEN failure_rate ELSE throughput_per_sec END END) AS current
      FROM snaps, (VALUES ('p95_latency_ms', 2.0, 4.0, true), ('failure_rate', 2.0, 5.0, true),
        ('throughput_per_sec', 2.0, 4.0, false)) AS m(metric, warn, crit, high_bad)
      GROUP BY 1, 2, 3, 4),
    rated AS (SELECT *, CASE WHEN baseline > 0 THEN current / baseline WHEN current > 0
      THEN CAST('Infinity' AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS ratio
      FROM compared WHERE baseline > 0 OR current > 0)""",
    """SELECT metric, baseline, current, ratio, severity FROM (
      SELECT *, CASE WHEN high_bad AND ratio >= crit THEN 'critical' WHEN high_bad AND ratio >= warn THEN 'warn'
        WHEN NOT high_bad AND baseline > 0 AND ratio <= 1.0 / crit THEN 'critical'
        WHEN NOT high_bad AND baseline > 0 AND ratio <= 1.0 / warn THEN 'warn' END AS severity FROM rated)
    WHERE severity IS NOT NULL""",
)

MINUTE_STATS = f"""minutes AS (SELECT date_trunc('minute', event_time) AS minute, event_type, {_COUNTERS}
  FROM fin GROUP BY 1, 2)"""
HOURLY = _log(f"SELECT date_trunc('hour', event_time) AS hour, event_type, {_COUNTERS} FROM fin GROUP BY 1, 2")
FAILURE_TYPES = "'JOB_FAILED', 'JOB_TIMEOUT', 'JOB_CANCELLED', 'JOB_RETRY_SCHEDULED'"

_UUID = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"

_WINNER = f"""asked AS (
  SELECT no AS request_no, 'n' || no AS job_id,
    CASE WHEN attempt = 0 THEN '' ELSE 'k' || cust END AS idempotency_key,
    CASE WHEN attempt = 1 OR priority = 0 THEN 5 ELSE priority END AS priority,
    CASE WHEN attempt = 2 THEN 'CREATED' ELSE 'SCHEDULED' END AS state,
    CASE WHEN attempt = 3 THEN '{{}}' ELSE payload END AS payload
  FROM jobs),
held AS (SELECT idempotency_key, job_id AS held_id FROM jobs WHERE idempotency_key <> ''),
placed AS (
  SELECT a.*, h.held_id,
    row_number() OVER (PARTITION BY a.idempotency_key ORDER BY request_no) AS nth,
    first_value(a.job_id) OVER (PARTITION BY a.idempotency_key ORDER BY request_no) AS first_id
  FROM asked a LEFT JOIN held h ON a.idempotency_key = h.idempotency_key AND a.idempotency_key <> ''),
settled AS (
  SELECT *, idempotency_key = '' OR (held_id IS NULL AND nth = 1) AS created,
    CASE WHEN idempotency_key = '' THEN job_id ELSE coalesce(held_id, first_id) END AS owner_id FROM placed)"""

_NEXT_FROM = """starts AS (
  SELECT *, created_at + to_seconds((no * 7919) % 86400) AS from_time FROM jobs)"""

RECOVERY = f"""lost_jobs AS (
  SELECT *, CASE WHEN state = 'CANCEL_REQUESTED' THEN 'CANCELLED' WHEN attempt < max_attempts THEN 'RETRYING'
    ELSE 'FAILED' END AS new_state
  FROM jobs WHERE state IN ('RUNNING', 'ASSIGNED', 'CANCEL_REQUESTED') AND {LOST})"""

_STATUS = f"""outcomes AS (
  SELECT a.job_id, j.execution_id, j.worker_id, CASE WHEN j.state IS NULL THEN 'not_found'
      WHEN j.state IN ('COMPLETED', 'CANCELLED', 'EXPIRED') THEN 'conflict'
      WHEN j.state IN ('RUNNING', 'ASSIGNED') THEN 'CANCEL_REQUESTED' ELSE 'CANCELLED' END AS status
  FROM (SELECT DISTINCT 'o' || l_orderkey AS job_id FROM lineitem) a LEFT JOIN jobs j ON a.job_id = j.job_id)"""

_RFC = "strftime({t}, '%Y-%m-%dT%H:%M:%SZ')"

ORACLE: dict[str, str] = {
    # sources
    "src2_decode_events": _with(
        EV,
        MESSAGES,
        """SELECT event_id, event_type, CASE WHEN no_time THEN NULL ELSE sent_at END AS event_time, job_id, worker_id,
          CAST(1 AS BIGINT) AS attempt, payload
        FROM arrived WHERE NOT cut_off AND NOT no_id""",
    ),
    "src3_reject_counts": _with(
        EV,
        MESSAGES,
        """SELECT CASE WHEN cut_off THEN 'undecodable' ELSE 'empty_event_id' END AS reason, count(*) AS cnt
        FROM arrived WHERE cut_off OR no_id GROUP BY 1""",
    ),
    "src3_rejects": _with(
        EV,
        WIRE,
        """SELECT CASE WHEN n % 50 = 3 THEN 'undecodable' ELSE 'empty_event_id' END AS reason,
          CASE WHEN n % 50 = 3 THEN substr(body, 1, 40) ELSE body END AS raw FROM wired WHERE n % 50 IN (3, 7)""",
    ),
    "src4_replay": _with(
        EV,
        MESSAGES,
        f"""SELECT CASE WHEN no_id THEN '' ELSE event_id END AS event_id, event_type,
          CASE WHEN no_time THEN NULL ELSE sent_at END AS event_time, source_time, job_id
        FROM arrived WHERE NOT cut_off AND source_time < {LOG_NOW}""",
    ),
    "src5_unpublished": _log(
        """SELECT event_id AS id, event_type, job_id AS aggregate_id, event_time AS created_at
        FROM ev WHERE n % 3 <> 0"""
    ),
    "src6_stored_jobs": _with(
        JOBS,
        """SELECT job_id, idempotency_key, worker_id, schedule_type, delay_s * 1000000000 AS delay, run_at,
          initial_ms * 1000000 AS initial_delay, source FROM jobs""",
    ),
    "src7_work_messages": _with(
        JOBS,
        """SELECT job_id, type, payload, priority, CAST(attempt AS INTEGER) AS attempt,
          CAST(timeout_ms AS BIGINT) * 1000000 AS timeout, created_at AS enqueued_at
        FROM jobs WHERE no % 40 <> 9""",
    ),
    # sinks
    "snk1_normalised": _with(
        EV,
        WIRE,
        "hashed AS (SELECT *, md5(body) AS h FROM wired WHERE n % 50 NOT IN (3, 7))",
        f"""SELECT {_UUID.format(h='h')} AS event_id, event_type,
          CASE WHEN n % 50 = 11 THEN event_time + INTERVAL 2 SECOND ELSE event_time END AS event_time,
          {LOG_NOW} AS ingested_at, job_id, CAST(1 AS BIGINT) AS attempt, payload FROM hashed""",
    ),
    "snk7_replay_lines": _with(
        EV,
        WIRE,
        """SELECT body AS value FROM wired WHERE n % 50 <> 3""",
    ),
    "snk4_routes": _log(
        """SELECT event_id AS id, CASE WHEN event_type LIKE 'WORKER%' THEN 'worker.events'
            WHEN event_type LIKE 'SCHEDULER%' THEN 'scheduler.events' ELSE 'job.events' END AS topic,
          CASE WHEN job_id <> '' THEN job_id ELSE event_id END AS key, event_time AS "timestamp" FROM ev"""
    ),
    "snk5_published": _log(
        f"""SELECT event_id AS id, CASE WHEN n % 3 = 0 THEN event_time + INTERVAL 1 SECOND
          WHEN event_type LIKE 'JOB%' THEN {LOG_NOW} END AS published_at FROM ev"""
    ),
    "snk6_emitted": _with(
        JOBS,
        f"""hashed AS (SELECT *, md5('JOB_QUEUED|' || job_id || '|||' || attempt || '|0|scheduler-1|'
          || epoch_us({JOBS_NOW})) AS h FROM jobs WHERE {DUE})""",
        f"""SELECT {_UUID.format(h='h')} AS id, 'JOB_QUEUED' AS event_type, job_id AS aggregate_id,
          CASE WHEN attempt > 0 THEN CAST(attempt AS VARCHAR) END AS attempt, {JOBS_NOW} AS created_at FROM hashed""",
    ),
    # log
    "ded1_final_events": _log(
        """SELECT event_id, event_type, CAST(1 AS INTEGER) AS event_version, event_time, ingested_at, job_id,
          execution_id, worker_id, scheduler_id, CAST(1 AS BIGINT) AS attempt, '' AS trace_id, payload FROM fin"""
    ),
    "view1_final_view": _log(
        "SELECT event_type, count(*) AS cnt, max(ingested_at) AS newest FROM fin GROUP BY event_type"
    ),
    "cnt1_events": _log("SELECT count(*) AS events FROM fin"),
    "cnt2_completed": _log("SELECT count(*) AS events FROM fin WHERE event_type = 'JOB_COMPLETED'"),
    "ttl1_events": _log(
        f"""SELECT event_id, event_type, event_time, ingested_at FROM raw
        WHERE event_time + INTERVAL 30 DAY > {LOG_NOW}"""
    ),
    "ttl1_expired_days": _log(
        f"""SELECT CAST(event_time AS DATE) AS event_day FROM raw GROUP BY 1
        HAVING CAST(event_time AS DATE) < CAST({LOG_NOW} - INTERVAL 30 DAY AS DATE)"""
    ),
    "ttl2_minute_stats": _with(
        EV,
        MINUTE_STATS,
        """SELECT minute, event_type, cnt FROM minutes
        WHERE minute + INTERVAL 90 DAY > TIMESTAMP '2024-04-10 12:00:00'""",
    ),
    "ttl2_failure_minutes": _with(
        EV,
        MINUTE_STATS,
        f"""SELECT minute, event_type, cnt FROM minutes WHERE event_type IN ({FAILURE_TYPES})
        AND minute + INTERVAL 90 DAY > TIMESTAMP '2024-04-10 12:00:00'""",
    ),
    "ttl3_hourly_stats": _log(
        """SELECT date_trunc('hour', event_time) AS hour, event_type, count(*) AS cnt FROM fin GROUP BY 1, 2
        HAVING date_trunc('hour', event_time) + INTERVAL 365 DAY > TIMESTAMP '2025-01-10 12:00:00'"""
    ),
    "ttl4_daily_stats": _log(
        "SELECT CAST(event_time AS DATE) AS day, event_type, count(*) AS cnt FROM fin GROUP BY 1, 2"
    ),
    "lay1_partitions": _log(
        """SELECT CAST(strftime(event_time, '%Y%m') AS INTEGER) AS month, CAST(event_time AS DATE) AS event_day,
          count(*) AS cnt FROM raw GROUP BY 1, 2"""
    ),
    # rollups
    "ru1_job_minute_stats": _with(EV, MINUTE_STATS, "SELECT * FROM minutes"),
    "ru1_with_copies": _log(
        f"SELECT date_trunc('minute', event_time) AS minute, event_type, {_COUNTERS} FROM timed GROUP BY 1, 2"
    ),
    "ru2_worker_minute_stats": _log(
        f"""SELECT date_trunc('minute', event_time) AS minute, worker_id, event_type, {_COUNTERS}
        FROM fin WHERE worker_id <> '' GROUP BY 1, 2, 3"""
    ),
    "ru3_failure_minute_stats": _log(
        f"""SELECT date_trunc('minute', event_time) AS minute, event_type, count(*) AS cnt
        FROM fin WHERE event_type IN ({FAILURE_TYPES}) GROUP BY 1, 2"""
    ),
    "ru4_job_hourly_stats": HOURLY,
    "ru5_job_daily_stats": _log(
        "SELECT CAST(event_time AS DATE) AS day, event_type, count(*) AS cnt FROM fin GROUP BY 1, 2"
    ),
    "ru8_merged_parts": HOURLY,
    # analytics
    "aq1a_throughput_minutes": _throughput("minute", 60),
    "aq1a_throughput_hours": _throughput("hour", 3600),
    "aq1b_throughput_totals": TOTALS,
    "aq2a_latency_summary": _log(
        f"""SELECT coalesce(quantile_cont(ms, 0.5), 0) AS p50_ms, coalesce(quantile_cont(ms, 0.9), 0) AS p90_ms,
          coalesce(quantile_cont(ms, 0.95), 0) AS p95_ms, coalesce(quantile_cont(ms, 0.99), 0) AS p99_ms,
          coalesce(avg(ms), 0) AS avg_ms, count(*) AS count FROM fin WHERE ms > 0 AND {WHOLE}"""
    ),
    "aq2b_latency_series": _log(
        f"""SELECT date_trunc('minute', event_time) AS bucket, quantile_cont(ms, 0.5) AS p50_ms,
          quantile_cont(ms, 0.95) AS p95_ms, quantile_cont(ms, 0.99) AS p99_ms, count(*) AS count
        FROM fin WHERE ms > 0 AND {WHOLE} GROUP BY 1"""
    ),
    "aq3a_outcome_counts": OUTCOME_COUNTS,
    "aq3b_outcome_rates": RATES,
    "aq3c_failure_series": FAILURES,
    "aq3d_retry_rates": RATES,
    "aq4_workers": _log(
        f"""SELECT worker_id, completed, failed, avg_ms,
          CASE WHEN sum(completed) OVER () > 0 THEN CAST(completed AS DOUBLE) / CAST(sum(completed) OVER () AS DOUBLE)
            ELSE CAST(0 AS DOUBLE) END AS share
        FROM (SELECT worker_id, {_n('JOB_COMPLETED', 'completed')}, {_n('JOB_FAILED', 'failed')},
            coalesce(avg(CASE WHEN ms > 0 THEN ms END), CAST(0 AS DOUBLE)) AS avg_ms
          FROM fin WHERE worker_id <> '' AND {WHOLE} GROUP BY 1 ORDER BY completed DESC, worker_id LIMIT 100)"""
    ),
    "aq5a_queue_wait": _with(
        EV,
        PAIRS,
        """SELECT coalesce(avg(wait_ms), 0) AS avg_wait_ms, coalesce(quantile_cont(wait_ms, 0.95), 0) AS p95_wait_ms,
          count(*) AS pairs FROM pairs""",
    ),
    "aq5a_queue_pairs": _with(EV, PAIRS, "SELECT * FROM pairs"),
    "aq5b_queue_depth": _log(
        f"""SELECT queued, started, CAST(greatest(0, queued - started) AS DOUBLE) AS depth_estimate
        FROM (SELECT {_n('JOB_QUEUED', 'queued')}, {_n('JOB_STARTED', 'started')} FROM fin WHERE {WHOLE})"""
    ),
    "aq6a_completed_per_minute": PEAKS,
    "aq6b_active_workers": _log(
        f"""SELECT count(DISTINCT worker_id) AS active_workers FROM fin
        WHERE event_type = 'JOB_COMPLETED' AND worker_id <> '' AND {WHOLE}"""
    ),
    "aq6c_capacity": _with(
        EV,
        f"peaks AS ({PEAKS[PEAKS.index('SELECT CAST(coalesce(sum(c)'):]})",
        f"""SELECT completed, peak_per_minute, avg_per_minute, CAST(0.5 AS DOUBLE) AS target_per_worker,
          CAST(ceil(CAST(peak_per_minute AS DOUBLE) / CAST(0.5 AS DOUBLE)) AS INTEGER) AS recommended_workers,
          (SELECT count(DISTINCT worker_id) FROM fin
           WHERE event_type = 'JOB_COMPLETED' AND worker_id <> '' AND {WHOLE}) AS active_workers FROM peaks""",
    ),
    "aq7a_snapshots": SNAPSHOTS,
    "aq7b_anomalies": ANOMALIES,
    "aq8_scheduler": _log(
        f"SELECT event_type, count(*) AS cnt FROM fin WHERE event_type LIKE 'SCHEDULER%' AND {WHOLE} GROUP BY 1"
    ),
    "aq1a_from_rollup": _throughput("minute", 60),
    "aq1b_from_rollup": TOTALS,
    "aq3a_from_rollup": OUTCOME_COUNTS,
    "aq3b_from_rollup": RATES,
    "aq3c_from_rollup": FAILURES,
    "aq6a_from_rollup": PEAKS,
    # dashboard
    "db1_completed_per_minute": _log(
        f"SELECT date_trunc('minute', event_time) AS time, {_n('JOB_COMPLETED', 'completed')} FROM raw GROUP BY 1"
    ),
    "db2_failures_per_minute": _log(
        f"""SELECT date_trunc('minute', event_time) AS time, {_n('JOB_FAILED', 'failed')},
          {_n('JOB_TIMEOUT', 'timeout')}, {_n('JOB_RETRY_SCHEDULED', 'retry')} FROM raw GROUP BY 1"""
    ),
    "db3_p95_per_minute": _log(
        """SELECT date_trunc('minute', event_time) AS time, quantile_cont(ms, 0.95) AS p95
        FROM timed WHERE ms > 0 GROUP BY 1"""
    ),
    "db4_events_by_type": _log("SELECT event_type, count(*) AS cnt FROM raw GROUP BY 1"),
    "db5_completed_by_worker": _log(
        f"""SELECT worker_id, {_n('JOB_COMPLETED', 'completed')} FROM raw WHERE worker_id <> ''
        GROUP BY 1 ORDER BY completed DESC, worker_id LIMIT 20"""
    ),
    # operational tables
    "store1_jobs_by_id": _with(
        JOBS, "SELECT job_id, state FROM jobs WHERE job_id IN (SELECT 'o' || l_orderkey FROM lineitem)"
    ),
    "store2_jobs_by_key": _with(
        JOBS,
        """SELECT job_id, idempotency_key FROM jobs WHERE idempotency_key <> ''
        AND idempotency_key IN (SELECT 'k' || o_custkey FROM orders WHERE o_orderkey % 3 = 0)""",
    ),
    "store3_list_jobs": _with(
        JOBS,
        """SELECT job_id, state, created_at FROM jobs WHERE state = 'RUNNING'
        ORDER BY created_at DESC, job_id LIMIT 50""",
    ),
    "store4_due_jobs": _with(JOBS, f"SELECT job_id, state, priority, scheduled_at FROM jobs WHERE {DUE}"),
    "store5_cancel_requested": _with(JOBS, "SELECT job_id, updated_at FROM jobs WHERE state = 'CANCEL_REQUESTED'"),
    "store6_timed_out": _with(
        JOBS,
        f"""SELECT job_id, state, started_at, timeout_ms FROM jobs WHERE state IN ('RUNNING', 'ASSIGNED')
        AND started_at + to_milliseconds(timeout_ms) < {JOBS_NOW}""",
    ),
    "store7_healthy_workers": _with(WORKERS, "SELECT worker_id, active_jobs FROM workers WHERE status = 'HEALTHY'"),
    "store8_workers": _with(WORKERS, "SELECT worker_id, status, registered_at FROM workers"),
    "store9_stale_workers": _with(
        WORKERS,
        f"""SELECT * FROM (SELECT worker_id, status AS old_status, CASE
            WHEN last_heartbeat < {WORKERS_NOW} - INTERVAL 25 SECOND THEN 'UNAVAILABLE'
            WHEN status = 'HEALTHY' AND last_heartbeat < {WORKERS_NOW} - INTERVAL 15 SECOND THEN 'SUSPECTED' END
            AS new_status FROM workers) WHERE new_status IS NOT NULL""",
    ),
    "store10_new_jobs": _with(
        JOBS, _WINNER, "SELECT job_id, idempotency_key, priority, state, payload FROM settled WHERE created"
    ),
    "store10_request_jobs": _with(JOBS, _WINNER, "SELECT request_no, owner_id AS job_id, created FROM settled"),
    "store11_transitions": _with(
        JOBS,
        f"""SELECT job_id, CASE WHEN go THEN 'QUEUED' ELSE state END AS state,
          CASE WHEN go THEN '' ELSE worker_id END AS worker_id,
          CASE WHEN go AND attempt > 0 THEN 'again' ELSE '' END AS last_error,
          CASE WHEN go THEN {JOBS_NOW} ELSE updated_at END AS updated_at
        FROM (SELECT *, attempt < 3 AND (priority <= 1 OR state IN ('SCHEDULED', 'RETRYING')) AS go FROM jobs)""",
    ),
    "store12_new_executions": _with(
        JOBS,
        f"""SELECT job_id, worker_id, CAST(attempt + 1 AS INTEGER) AS attempt, 'PENDING' AS state,
          {JOBS_NOW} AS created_at FROM jobs WHERE state = 'QUEUED' AND worker_id <> ''""",
    ),
    "store12_finished_executions": _with(
        JOBS,
        RESULTS,
        DECIDED,
        EXECUTIONS,
        f"""SELECT e.execution_id, coalesce(o.execution_state, e.state) AS state, e.duration_ms,
          nullif(o.error, '') AS error, o.retryable, CASE WHEN o.execution_id IS NOT NULL THEN {JOBS_NOW} ELSE e.finished_at END
            AS finished_at
        FROM executions e LEFT JOIN (SELECT * FROM outcome WHERE job_state IS NOT NULL) o
          ON e.execution_id = o.execution_id""",
    ),
    "store13_upserted_workers": _with(
        WORKERS,
        """latest AS (SELECT 's' || user_id AS worker_id, max(date_trunc('millisecond', ts)) AS last_beat,
          min(date_trunc('millisecond', ts)) AS first_beat FROM events GROUP BY 1)""",
        """SELECT coalesce(l.worker_id, w.worker_id) AS worker_id,
          CASE WHEN l.worker_id IS NULL THEN w.address ELSE l.worker_id || ':9000' END AS address,
          coalesce(last_beat, w.last_heartbeat) AS last_heartbeat, coalesce(w.registered_at, first_beat) AS registered_at
        FROM workers w FULL JOIN latest l ON w.worker_id = l.worker_id""",
    ),
    # lifecycle
    "lc1_validated_requests": _with(
        REQUESTS,
        f"""SELECT request_id, {_REQ_TYPE} AS type,
          CAST(CASE WHEN asked_priority = 0 THEN 5 ELSE asked_priority END AS INTEGER) AS priority,
          timeout_ms, error FROM checked""",
    ),
    "lc2_planned_requests": _with(
        REQUESTS,
        f"""SELECT request_id, CASE WHEN scheduled_at <= {JOBS_NOW} THEN 'QUEUED' ELSE 'SCHEDULED' END AS state,
          scheduled_at, CASE WHEN scheduled_at <= {JOBS_NOW} THEN {JOBS_NOW} END AS queued_at, 3 AS max_attempts
        FROM planned""",
    ),
    "lc2_request_events": _with(
        REQUESTS,
        f"""SELECT event_type, count(*) AS cnt, count(DISTINCT request_id) AS jobs FROM (
          SELECT 'JOB_CREATED' AS event_type, request_id FROM planned
          UNION ALL SELECT 'JOB_SCHEDULED', request_id FROM planned
          UNION ALL SELECT 'JOB_QUEUED', request_id FROM planned WHERE scheduled_at <= {JOBS_NOW}) GROUP BY 1""",
    ),
    "lc3_promoted_events": _with(
        JOBS, f"SELECT 'JOB_QUEUED' AS event_type, job_id, CAST(attempt AS INTEGER) AS attempt FROM jobs WHERE {DUE}"
    ),
    "lc3_promoted_messages": _with(
        JOBS,
        f"""SELECT job_id, type, priority, CAST(attempt AS INTEGER) AS attempt, timeout_ms, {JOBS_NOW} AS enqueued_at
        FROM jobs WHERE {DUE}""",
    ),
    "lc3_promoted_jobs": _with(
        JOBS,
        f"""SELECT job_id, CASE WHEN {DUE} THEN 'QUEUED' ELSE state END AS state,
          CASE WHEN {DUE} THEN {JOBS_NOW} END AS queued_at FROM jobs""",
    ),
    "lc4_gated_messages": _with(
        JOBS,
        f"""SELECT {_EXEC_ID} AS message_id, 'o' || l_orderkey AS job_id, CASE WHEN j.state IS NULL THEN 'not_found'
            WHEN j.state IN ('QUEUED', 'SCHEDULED', 'RETRYING') THEN 'proceed'
            WHEN j.state IN ('CANCEL_REQUESTED', 'CANCELLED') THEN 'skip_cancelled'
            ELSE 'skip_not_queueable' END AS route
        FROM lineitem LEFT JOIN jobs j ON j.no = l_orderkey""",
    ),
    "lc5_decided_results": _with(
        JOBS,
        RESULTS,
        DECIDED,
        f"""SELECT execution_id, job_id, action, job_state, execution_state, delay_ms,
          {JOBS_NOW} + to_milliseconds(delay_ms) AS next_retry_at FROM outcome""",
    ),
    "lc5_job_updates": _with(
        JOBS,
        RESULTS,
        DECIDED,
        """done AS (SELECT *, CASE WHEN action IN ('timeout', 'timeout_retry') THEN 'timeout'
          WHEN action <> 'completed' THEN error END AS note,
          action IN ('timeout_retry', 'failure_retry') AS again FROM outcome WHERE job_state IS NOT NULL)""",
        f"""SELECT job_id, arg_max(job_state, place) AS new_state, arg_max(note, place) AS last_error,
          max(CASE WHEN again THEN '' END) AS worker_id, max(CASE WHEN again THEN '' END) AS execution_id,
          {JOBS_NOW} + to_milliseconds(arg_max(delay_ms, CASE WHEN again THEN place END)) AS next_retry_at,
          max(CASE WHEN NOT again THEN {JOBS_NOW} END) AS completed_at FROM done GROUP BY 1""",
    ),
    "lc5_events": _with(
        JOBS,
        RESULTS,
        DECIDED,
        f"""told AS (SELECT *, {JOBS_NOW} + to_milliseconds(delay_ms) AS again_at FROM outcome
          WHERE job_state IS NOT NULL)""",
        f"""SELECT CASE WHEN action = 'cancelled' THEN 'JOB_CANCELLED' WHEN action = 'completed' THEN 'JOB_COMPLETED'
            WHEN action LIKE 'timeout%' THEN 'JOB_TIMEOUT' ELSE 'JOB_FAILED' END AS event_type,
          execution_id, attempt, 0 AS seq,
          CASE WHEN action = 'cancelled' THEN '{{"reason":"' || reason || '"}}'
            WHEN action = 'completed' THEN '{{"duration_ms":' || duration_ms || '}}'
            WHEN action LIKE 'timeout%' THEN '{{"error":"' || error || '"}}'
            ELSE '{{"error":"' || error || '","retryable":' || retryable || '}}' END AS payload
        FROM told
        UNION ALL
        SELECT 'JOB_RETRY_SCHEDULED', execution_id, attempt, 1, '{{"next_retry_at":"'
          || {_RFC.format(t='again_at')} || CASE action WHEN 'timeout_retry' THEN '","reason":"timeout"}}'
          ELSE '","delay_ms":' || delay_ms || '}}' END
        FROM told WHERE action IN ('timeout_retry', 'failure_retry')""",
    ),
    "lc6_backoff": _with(
        JOBS,
        f"""d AS (SELECT *, CAST(floor({BACKOFF.format(attempt='attempt')}) AS BIGINT) AS delay_ms,
          {BACKOFF.format(attempt='attempt')} AS exact FROM jobs)""",
        """SELECT job_id, CAST(attempt AS INTEGER) AS attempt, delay_ms,
          CASE WHEN jitter THEN CAST(floor(exact * CAST(0.5 AS DOUBLE)) AS BIGINT) ELSE delay_ms END AS delay_min_ms,
          CASE WHEN jitter THEN CAST(floor(exact * CAST(1.5 AS DOUBLE)) AS BIGINT) ELSE delay_ms END AS delay_max_ms
        FROM d""",
    ),
    "lc7_timeout_results": _with(
        JOBS,
        f"""late AS (SELECT *, CAST({BACKOFF.format(attempt='attempt')} * 1000 AS BIGINT) AS delay_us FROM jobs
          WHERE state IN ('RUNNING', 'ASSIGNED') AND started_at + to_milliseconds(timeout_ms) < {JOBS_NOW})""",
        f"""SELECT job_id, CAST(timeout_ms AS BIGINT) AS duration_ms,
          CASE WHEN attempt < max_attempts THEN 'timeout_retry' ELSE 'timeout' END AS action,
          CASE WHEN attempt < max_attempts THEN 'RETRYING' ELSE 'TIMEOUT' END AS job_state,
          CASE WHEN attempt < max_attempts THEN {JOBS_NOW} + to_microseconds(delay_us) END AS next_retry_at
        FROM late""",
    ),
    "lc8_recovered_jobs": _with(
        JOBS,
        WORKERS,
        RECOVERY,
        f"""SELECT job_id, new_state, CASE new_state WHEN 'CANCELLED' THEN 'worker lost during cancel'
            WHEN 'RETRYING' THEN 'worker lost' ELSE 'worker lost, max attempts exceeded' END AS last_error,
          CASE WHEN new_state = 'RETRYING' THEN '' END AS worker_id,
          CASE WHEN new_state = 'RETRYING' THEN '' END AS execution_id,
          CASE WHEN new_state = 'RETRYING' THEN {JOBS_NOW} END AS next_retry_at,
          CASE WHEN new_state <> 'RETRYING' THEN {JOBS_NOW} END AS completed_at FROM lost_jobs""",
    ),
    "lc8_recovered_executions": _with(
        JOBS,
        WORKERS,
        RECOVERY,
        "SELECT execution_id, 'FAILED' AS state, 'worker lost' AS error FROM lost_jobs WHERE execution_id <> ''",
    ),
    "lc8_recovery_events": _with(
        JOBS,
        WORKERS,
        RECOVERY,
        """SELECT CASE new_state WHEN 'CANCELLED' THEN 'JOB_CANCELLED' WHEN 'RETRYING' THEN 'JOB_RETRY_SCHEDULED'
            ELSE 'JOB_FAILED' END AS event_type, job_id, worker_id, CAST(attempt AS INTEGER) AS attempt,
          '{"reason":"worker_lost"}' AS payload FROM lost_jobs""",
    ),
    "lc9_next_runs": _with(
        JOBS,
        _NEXT_FROM,
        f"""SELECT job_id, schedule_type, from_time, CASE schedule_type WHEN 'immediate' THEN from_time
            WHEN 'delayed' THEN from_time + to_seconds(delay_s) WHEN 'one_time' THEN run_at
            ELSE {_next_cron('from_time', 'cron_expr')} END AS next_run_at, CAST(NULL AS VARCHAR) AS schedule_error
        FROM starts""",
    ),
    "lc10_recurring_children": _with(
        JOBS,
        f"""SELECT job_id AS parent_job_id, name, 'SCHEDULED' AS state, 0 AS attempt, '' AS idempotency_key,
          {_next_cron(JOBS_NOW, 'cron_expr')} AS scheduled_at
        FROM jobs WHERE state = 'COMPLETED' AND schedule_type = 'recurring'""",
    ),
    "lc10_child_events": _with(
        JOBS,
        f"""children AS (SELECT job_id, {_next_cron(JOBS_NOW, 'cron_expr')} AS next_at FROM jobs
          WHERE state = 'COMPLETED' AND schedule_type = 'recurring')""",
        f"""SELECT 'JOB_SCHEDULED' AS event_type, job_id AS parent_job_id, {_RFC.format(t='next_at')} AS scheduled_at
        FROM children""",
    ),
    "lc11_cancel_outcomes": _with(
        JOBS,
        _STATUS,
        f"SELECT job_id, status, CASE WHEN status = 'CANCELLED' THEN {JOBS_NOW} END AS completed_at FROM outcomes",
    ),
    "lc11_cancel_events": _with(
        JOBS,
        _STATUS,
        """SELECT CASE status WHEN 'CANCELLED' THEN 'JOB_CANCELLED' ELSE 'JOB_CANCEL_REQUESTED' END AS event_type, job_id,
          CASE status WHEN 'CANCELLED' THEN '' ELSE execution_id END AS execution_id,
          CASE status WHEN 'CANCELLED' THEN '' ELSE worker_id END AS worker_id
        FROM outcomes WHERE status IN ('CANCELLED', 'CANCEL_REQUESTED')""",
    ),
    "lc12_confirmed_cancels": _with(
        JOBS,
        f"""SELECT job_id, 'CANCELLED' AS new_state, {JOBS_NOW} AS completed_at FROM jobs
        WHERE state = 'CANCEL_REQUESTED' AND worker_id = ''""",
    ),
    "lc13_dispatch_order": _with(
        JOBS,
        """SELECT job_id, type, priority, created_at AS enqueued_at,
          row_number() OVER (PARTITION BY type ORDER BY priority DESC, created_at, job_id) AS position FROM jobs""",
    ),
    "lc14_worker_capacity": _with(
        WORKERS,
        """SELECT worker_id, status, active_jobs, greatest(0, capacity - active_jobs) AS slots,
          status = 'HEALTHY' AND capacity > active_jobs AS assignable FROM workers""",
    ),
    "lc14_pick_worker": _with(
        WORKERS,
        """SELECT worker_id, active_jobs, capacity - active_jobs AS slots FROM workers
        WHERE status = 'HEALTHY' AND capacity > active_jobs ORDER BY active_jobs, worker_id LIMIT 1""",
    ),
    "lc15_heartbeats": _with(
        WORKERS,
        BEATS,
        """SELECT w.worker_id, CASE WHEN b.ts IS NULL THEN w.status ELSE 'HEALTHY' END AS status,
          CAST(coalesce(b.active, w.active_jobs) AS INTEGER) AS active_jobs,
          CAST(coalesce(b.capacity, w.capacity) AS INTEGER) AS capacity,
          coalesce(b.ts, w.last_heartbeat) AS last_heartbeat
        FROM workers w LEFT JOIN (SELECT * FROM beats WHERE back = 1) b ON w.worker_id = b.worker_id""",
    ),
    "lc16_http_outcomes": _with(
        EXECUTIONS,
        """SELECT execution_id, status_code, status_code BETWEEN 200 AND 299 AS success,
          status_code >= 500 OR status_code = 429 AS retryable,
          CASE WHEN status_code NOT BETWEEN 200 AND 299 THEN 'webhook status ' || status_code END AS error
        FROM executions WHERE status_code IS NOT NULL""",
    ),
    "lc17_states_from_log": _with(
        EV,
        """ranked AS (SELECT *, CASE event_type WHEN 'JOB_CREATED' THEN 0 WHEN 'JOB_QUEUED' THEN 2
            WHEN 'JOB_STARTED' THEN 4 WHEN 'JOB_FAILED' THEN 6 WHEN 'JOB_TIMEOUT' THEN 7
            WHEN 'JOB_RETRY_SCHEDULED' THEN 8 WHEN 'JOB_COMPLETED' THEN 9 WHEN 'JOB_CANCELLED' THEN 10 END AS step
          FROM fin WHERE job_id <> ''),
        newest AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY event_time DESC, step DESC) AS back
          FROM ranked)""",
        """SELECT job_id, max(CASE WHEN back = 1 THEN CASE step WHEN 0 THEN 'CREATED' WHEN 2 THEN 'QUEUED'
            WHEN 4 THEN 'RUNNING' WHEN 6 THEN 'FAILED' WHEN 7 THEN 'TIMEOUT' WHEN 8 THEN 'RETRYING'
            WHEN 9 THEN 'COMPLETED' WHEN 10 THEN 'CANCELLED' END END) AS state, CAST(1 AS BIGINT) AS attempts,
          min(CASE WHEN step = 0 THEN event_time END) AS created_at,
          max(CASE WHEN step = 2 THEN event_time END) AS queued_at,
          max(CASE WHEN step = 4 THEN event_time END) AS started_at, max(event_time) AS updated_at
        FROM newest GROUP BY 1""",
    ),
    "lc18_assignment_events": _with(
        JOBS,
        """SELECT event_type, job_id, worker_id, CAST(attempt + 1 AS INTEGER) AS attempt, seq
        FROM jobs, (VALUES ('JOB_ASSIGNED', 0), ('JOB_STARTED', 1)) AS e(event_type, seq)
        WHERE state = 'QUEUED' AND worker_id <> ''""",
    ),
    "lc19_registered_workers": _with(
        WORKERS,
        f"""SELECT worker_id, 'HEALTHY' AS status, {WORKERS_NOW} AS last_heartbeat,
          CASE WHEN status = 'HEALTHY' THEN registered_at ELSE {WORKERS_NOW} END AS registered_at FROM workers""",
    ),
    "lc19_worker_events": _with(
        WORKERS,
        """SELECT 'WORKER_REGISTERED' AS event_type, worker_id,
          '{"address":"' || address || '","capacity":' || capacity || '}' AS payload FROM workers
        UNION ALL SELECT 'WORKER_DEREGISTERED', worker_id, '{}' FROM workers WHERE active_jobs = 0""",
    ),
    "lc20_precheck": _with(
        JOBS,
        """pre AS (SELECT *, no % 7 AS p FROM jobs)""",
        """SELECT job_id, type, CASE type
            WHEN 'builtin' THEN CASE WHEN p = 3 THEN 'invalid builtin payload' WHEN p = 2 THEN 'unknown builtin handler "nope"'
              WHEN p > 3 THEN 'unknown builtin handler ""' END
            WHEN 'webhook' THEN CASE WHEN p = 3 THEN 'invalid webhook payload' WHEN p < 3 THEN 'webhook url required'
              WHEN p = 5 THEN 'webhook url must be http(s)' END
            ELSE 'unsupported job type "shell"' END AS precheck_error,
          CASE WHEN type = 'webhook' AND p = 4 THEN 'PUT' WHEN type = 'webhook' AND p = 6 THEN 'POST' END AS method
        FROM pre""",
    ),
}
# Streams end with the tables the batch queries give.
_VALID = f"""valid AS (SELECT DISTINCT event_type,
    CASE WHEN n % 50 = 11 THEN event_time + INTERVAL 2 SECOND ELSE event_time END AS event_time, event_id
  FROM raw WHERE n % 50 NOT IN (3, 7))"""
_FIRST = "(SELECT min(event_time) FROM fin WHERE event_time >= TIMESTAMP '{at}')"
_INSIDE = (
    f"event_time >= {_FIRST.format(at='2024-01-05 03:00:00')} AND event_time < {_FIRST.format(at='2024-01-09 15:30:00')}"
)
ORACLE |= {
    "src1_stream_ingest": _with(
        EV,
        _VALID,
        "SELECT CAST(event_time AS DATE) AS event_day, event_type, count(*) AS cnt FROM valid GROUP BY 1, 2",
    ),
    "ded2_stream_dedupe": _log("SELECT event_type, event_time, event_id, job_id, worker_id FROM fin"),
    "ru7_stream_rollups": ORACLE["ru1_job_minute_stats"],
    "ru7_stream_workers": ORACLE["ru2_worker_minute_stats"],
    "ru7_delta_rollups": ORACLE["ru1_job_minute_stats"],
    # Copies of old events change nothing, copies of new ones are removed.
    "ru7_late_after_expiry": ORACLE["ru1_job_minute_stats"],
    "ru7_late_events": _log(
        f"""SELECT CAST(event_time AS DATE) AS event_day, count(*) AS cnt FROM fin
        WHERE CAST(event_time AS DATE) <= CAST({LOG_NOW} - INTERVAL 30 DAY AS DATE) GROUP BY 1"""
    ),
    "ttl1_trimmed_log": _log(
        f"""SELECT CAST(event_time AS DATE) AS event_day, count(*) AS cnt FROM raw
        WHERE CAST(event_time AS DATE) >= CAST({LOG_NOW} - INTERVAL 30 DAY AS DATE) GROUP BY 1"""
    ),
    "aq1a_throughput_inside": ORACLE["aq1a_throughput_minutes"].replace(WHOLE, _INSIDE),
    "aq2a_latency_inside": ORACLE["aq2a_latency_summary"].replace(WHOLE, _INSIDE),
    # Sketches are checked by the query; here all of them hold.
    "ru6_minute_sketches": _with(EV, MINUTE_STATS, "SELECT *, TRUE AS jobs_hold, TRUE AS quantiles_hold FROM minutes"),
    "ru6_merged_sketches": _log(
        f"""SELECT event_type, {_COUNTERS}, TRUE AS jobs_hold, TRUE AS quantiles_hold FROM fin GROUP BY 1"""
    ),
    "aq2a_latency_approx": f"""SELECT "count", avg_ms, TRUE AS percentiles_hold
      FROM ({ORACLE['aq2a_latency_summary']})""",
    "ru9_backfill_hours": ORACLE["ru4_job_hourly_stats"],
    "ru9_backfill_days": ORACLE["ru5_job_daily_stats"],
    "ru9_backfill_failures": ORACLE["ru3_failure_minute_stats"],
    "lay2_written_log": ORACLE["lay1_partitions"],
    "lay4_by_worker": _log("SELECT worker_id, count(*) AS cnt FROM raw WHERE worker_id <> '' GROUP BY 1"),
    "lc17_stream_states": ORACLE["lc17_states_from_log"],
}

# Waits that pass their limit: the next mark of the key is later than the limit, the limit before the watermark.
_RUN_MARKS = """marks AS (SELECT DISTINCT job_id AS key, event_time AS since, CASE event_type WHEN 'JOB_CREATED' THEN 0
      WHEN 'JOB_QUEUED' THEN 2 WHEN 'JOB_STARTED' THEN 4 WHEN 'JOB_FAILED' THEN 6 WHEN 'JOB_TIMEOUT' THEN 7
      WHEN 'JOB_RETRY_SCHEDULED' THEN 8 WHEN 'JOB_COMPLETED' THEN 9 WHEN 'JOB_CANCELLED' THEN 10 END AS place,
    event_type = 'JOB_STARTED' AS opens FROM fin WHERE job_id <> '')"""
_LIFE_MARKS = """marks AS (SELECT DISTINCT worker_id AS key, event_time AS since, 0 AS place, TRUE AS opens
    FROM fin WHERE event_type = 'WORKER_REGISTERED' AND worker_id <> '')"""


def _overdue(marks: str, limits: str) -> str:
    return _with(
        EV,
        marks,
        f"""waits AS (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since, place) AS next FROM marks),
        limits(label, most) AS (VALUES {limits}),
        due AS (SELECT key, since, next, since + most AS due, label FROM waits, limits WHERE opens)""",
        """SELECT key, since, due, label FROM due
        WHERE (next IS NULL OR next > due) AND due < (SELECT max(since) - INTERVAL 3 DAY FROM marks)""",
    )


_UNTIL = "event_time < TIMESTAMP '2024-01-24'"
ORACLE |= {
    "ru1_exact_jobs": _log("""SELECT event_type, count(DISTINCT job_id) AS uniq_jobs FROM fin WHERE job_id <> ''
      AND event_time >= TIMESTAMP '2024-01-05 03:00:00' AND event_time < TIMESTAMP '2024-01-20 15:30:00' GROUP BY 1"""),
    "aq2a_latency_from_bins": ORACLE["aq2a_latency_summary"],
    "ru8_folded_deltas": ORACLE["ru1_job_minute_stats"],
    "snk3_merged_log": _log("SELECT CAST(event_time AS DATE) AS event_day, count(*) AS cnt FROM fin GROUP BY 1"),
    "lay3_one_job": _log("""SELECT job_id, event_type, event_time, event_id, ingested_at FROM raw
      WHERE job_id = (SELECT min(job_id) FROM ev WHERE job_id <> '')"""),
    "store11_written_transitions": ORACLE["store11_transitions"],
    "store13_written_workers": ORACLE["store13_upserted_workers"],
    "snk5_written_published": ORACLE["snk5_published"],
    "ded2_late_copies": ORACLE["ded2_stream_dedupe"],
    "ru1_live_minutes": f"""SELECT * FROM ({ORACLE['ru1_job_minute_stats']}) WHERE minute + INTERVAL 1 MINUTE <=
      (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 1 DAY FROM events)""",
    "aq5a_stream_pairs": ORACLE["aq5a_queue_pairs"].replace(WHOLE, _UNTIL),
    "aq5a_never_started": _log(f"""SELECT DISTINCT job_id, CAST(1 AS BIGINT) AS attempt, event_time AS queued_at
      FROM fin q WHERE event_type = 'JOB_QUEUED' AND job_id <> '' AND {_UNTIL} AND NOT EXISTS (
        SELECT 1 FROM fin s WHERE s.event_type = 'JOB_STARTED' AND s.job_id = q.job_id
          AND s.event_time BETWEEN q.event_time AND q.event_time + INTERVAL 12 HOUR)"""),
    "lc7_stream_timeouts": _overdue(_RUN_MARKS, "('TIMEOUT', INTERVAL 6 HOUR)"),
    "store9_stream_silence": _overdue(_LIFE_MARKS, "('SUSPECTED', INTERVAL 18 HOUR), ('UNAVAILABLE', INTERVAL 24 HOUR)"),
}
