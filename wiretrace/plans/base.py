"""Query registry and the SQL shared by the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import sample_tables as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL equivalent if there is one."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_DUCK = {
    "k": "CAST(json_extract_string(props, '$.k') AS INTEGER)",
    "day": "strftime(ts, '%Y-%m-%d')",
    "ticks": "(CAST(epoch_us(ts) AS DOUBLE) / 1000.0)",
}


def _ev_columns() -> str:
    cols = {**st.SAMPLE_EVENT_COLUMNS, **st.SAMPLE_PARAM_COLUMNS, "dep_id": st.SAMPLE_DEPENDENCY}
    return ", ".join(f"{e.format(**_DUCK)} AS {n}" for n, e in cols.items())


# ev: the sample events as network events, one column per param
EV = (
    f"WITH RECURSIVE ev AS (SELECT {_ev_columns()}, {_DUCK['k']} AS k, user_id, event_type FROM events)"
)

# src: sources with state and timing, by plain windows
SRC = (
    EV
    + """, firsts AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id, source_id ORDER BY event_index) AS rn,
    first_value(type_name) OVER (PARTITION BY capture_id, source_id ORDER BY event_index) AS first_type
  FROM ev),
lasts AS (SELECT capture_id, arg_max(time_ticks, event_index) AS last_event_ticks FROM ev GROUP BY capture_id),
grouped AS (
  SELECT capture_id, source_id, min(source_type) AS source_type, min(source_type_name) AS source_type_name,
    coalesce(bool_or(net_error <> 0), false) AS is_error,
    bool_or(rn = 1 AND phase_name = 'PHASE_BEGIN')
      AND NOT bool_or(rn > 1 AND phase_name = 'PHASE_END' AND type_name = first_type) AS is_active,
    arg_min(coalesce(start_time, time_ticks), event_index) AS start_ticks,
    arg_max(time_ticks, event_index) AS last_ticks,
    count(*) AS event_count, min(event_index) AS first_event_index
  FROM firsts GROUP BY capture_id, source_id),
src AS (
  SELECT g.capture_id, source_id, source_type, source_type_name, is_error, is_active, start_ticks,
    CASE WHEN is_active THEN last_event_ticks ELSE last_ticks END AS end_ticks,
    CASE WHEN is_active THEN last_event_ticks ELSE last_ticks END - start_ticks AS duration,
    event_count, first_event_index
  FROM grouped g JOIN lasts USING (capture_id))
"""
)
SRC_COLUMNS = (
    "capture_id, source_id, source_type, source_type_name, is_error, is_active, start_ticks, end_ticks,"
    " duration, event_count, first_event_index"
)


def events(spark: SparkSession, sf_dir: str, with_params: bool = False) -> DataFrame:
    return st.network_events(spark, sf_dir, with_params)


def enum_cte() -> str:
    return f"enum_rows(enum, name, id) AS (VALUES {st.enum_values_sql()})"
