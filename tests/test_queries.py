"""Registered queries against their SQL at the smallest scale: one per family here,
all of them with ``python tests/run_oracles.py``."""

import pytest

import __spark_entry__ as entry
from compare import connect, diff

SF = "/root/testdata/sf0.001"
NAMES = [
    "group_sources",
    "source_events",
    "filter_sources",
    "sort_sources_duration",
    "busiest_sources",
    "describe_sources",
    "series_all",
    "sources_active_at",
    "sources_active_at_fine",
    "match_begin_end_chunked",
    "event_trace",
    "trace_search",
    "params_long",
    "decode_flags",
    "http_exchanges",
    "proxy_config_text",
    "socket_pools",
    "reporting_endpoints",
    "validate_events",
    "read_captures",
    "stream_source_state",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    assert diff(df.columns, df.collect(), con, entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    from wiretrace.plans.catalog import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
