"""Compare named queries with their SQL: ``python tests/oracle_check.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if hasattr(value, "item"):
        return _cell(value.item())
    if isinstance(value, pd.Timestamp):
        return value.tz_localize(None).isoformat() if value.tzinfo else value.isoformat()
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' when equal, else what differs."""
    left_cols, left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    right_cols, right = rows_of(list(rel.columns), rel.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} / {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference {left_cols}: {a} / {b}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from jobtrail.session import local_session

    spark = local_session()
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        begun = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                problem = compare(df, con, oracle[name])
            else:
                problem = "" if df.count() >= 0 else "?"
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        mark = "FAIL" if problem else ("ok" if name in oracle else "rows")
        bad += bool(problem)
        print(f"{mark:5}{time.time() - begun:6.2f}s {name} {problem}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
