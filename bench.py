"""Headline queries, timed: one warm-up, then the median of three runs each.

Prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from jobtrail.plans.queries import QUERIES
from jobtrail.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3

BATCH = [
    "aq1a_throughput_minutes",
    "aq1a_throughput_hours",
    "aq2a_latency_summary",
    "aq2b_latency_series",
    "aq3b_outcome_rates",
    "aq4_workers",
    "aq5a_queue_wait",
    "aq6c_capacity",
    "aq7b_anomalies",
    "db3_p95_per_minute",
    "ru1_job_minute_stats",
    "ru6_minute_sketches",
    "ru6_merged_sketches",
    "store4_due_jobs",
    "lc4_gated_messages",
    "lc5_job_updates",
    "lc8_recovered_jobs",
    "lc9_next_runs",
    "lc13_dispatch_order",
]
# Streams start, work off the tables and stop, so they are run once after a warm-up.
STREAMS = ["ru7_stream_rollups", "ru7_delta_rollups"]


def seconds(spark, name: str) -> float:
    begun = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    spark = local_session(CPUS, "bench")
    times = {}
    for name in BATCH:
        seconds(spark, name)
        times[name] = round(statistics.median(seconds(spark, name) for _ in range(RUNS)), 3)
    for name in STREAMS:
        seconds(spark, name)
        times[name] = round(seconds(spark, name), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "master": f"local[{CPUS}]",
                "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                "runs": RUNS,
            }
        )
    )


if __name__ == "__main__":
    main()
