"""Every named query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from jobtrail.plans.queries import QUERIES
from jobtrail.streaming.queries import QUERIES as STREAMS
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE and n not in STREAMS])
def test_query(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, ORACLE[name]) == ""


@pytest.mark.parametrize("name", ["src1_stream_ingest", "ded2_stream_dedupe", "ru7_stream_rollups", "ru7_delta_rollups",
                                  "ru9_backfill_days", "lc17_stream_states", "ded2_late_copies", "ru1_live_minutes",
                                  "aq5a_stream_pairs", "aq5a_never_started", "lc7_stream_timeouts", "store9_stream_silence"])
def test_stream(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, ORACLE[name]) == ""


def test_every_query_is_checked():
    assert set(QUERIES) <= set(ORACLE)
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
