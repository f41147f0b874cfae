"""Sources: grouping, state, timing, dependencies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import grouping as g
from ..session import checkpoint_dir
from ..sources import captures as cap
from ..sources import sample_tables as st
from .base import EV, SRC, SRC_COLUMNS, events, query


@query("group_sources", f"{SRC} SELECT {SRC_COLUMNS} FROM src")
def group_sources(spark, sf_dir):
    ev = events(spark, sf_dir)
    return g.group_sources(ev, st.enum_rows(ev))


@query("group_sources_stored_parts", f"{SRC} SELECT {SRC_COLUMNS} FROM src")
def group_sources_stored_parts(spark, sf_dir):
    """Each third of the events adds its own parts; the sources come from these alone."""
    ev = events(spark, sf_dir)
    folder = f"{checkpoint_dir(spark)}/parts-{uuid.uuid4().hex}"
    for k in range(3):
        cap.write_parts(ev.where(F.col("event_index") % 3 == k), folder, f"batch={k}")
    return g.sources_of_parts(cap.read_parts(spark, folder), st.enum_rows(ev))


@query("source_is_active", f"{SRC} SELECT capture_id, source_id, is_active FROM src")
def source_is_active(spark, sf_dir):
    return g.source_is_active(events(spark, sf_dir))


@query("source_is_error", f"{SRC} SELECT capture_id, source_id, is_error FROM src")
def source_is_error(spark, sf_dir):
    return g.source_is_error(events(spark, sf_dir))


@query("source_timing", f"{SRC} SELECT capture_id, source_id, start_ticks, end_ticks, duration FROM src")
def source_timing(spark, sf_dir):
    return g.source_timing(events(spark, sf_dir))


@query("source_event_count", "SELECT strftime(ts, '%Y-%m-%d') AS capture_id, user_id AS source_id, count(*) AS event_count FROM events GROUP BY 1, 2")
def source_event_count(spark, sf_dir):
    return g.source_event_count(events(spark, sf_dir))


@query(
    "source_events",
    SRC
    + """, picked AS (SELECT capture_id, source_id, event_count FROM src WHERE is_error),
    ranked AS (SELECT ev.capture_id, ev.source_id, event_index, type_name, time_ticks, event_count AS total,
      row_number() OVER (PARTITION BY ev.capture_id, ev.source_id ORDER BY event_index) AS rn
      FROM ev JOIN picked ON ev.capture_id = picked.capture_id AND ev.source_id = picked.source_id)
    SELECT capture_id, source_id, event_index, type_name, time_ticks, total, total > 3 AS truncated
    FROM ranked WHERE rn <= 3""",
)
def source_events(spark, sf_dir):
    ev = events(spark, sf_dir)
    failed = g.group_sources(ev).where("is_error")
    kept = g.source_events(ev, failed, cap=3)
    return kept.select("capture_id", "source_id", "event_index", "type_name", "time_ticks", "total", "truncated")


@query(
    "source_dependencies",
    f"""{EV} SELECT capture_id, event_index, source_id, dep_id,
    CASE dep_id % 7 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 7 END AS dep_type
    FROM ev WHERE dep_id IS NOT NULL""",
)
def source_dependencies(spark, sf_dir):
    return g.source_dependencies(events(spark, sf_dir, with_params=True))


@query(
    "event_source_rank",
    f"""{EV} SELECT capture_id, source_id, event_index,
    row_number() OVER (PARTITION BY capture_id, source_id ORDER BY event_index) AS position FROM ev""",
)
def event_source_rank(spark, sf_dir):
    from ..operators.scan import row_rank

    return row_rank(
        events(spark, sf_dir).select("capture_id", "source_id", "event_index"),
        g.SOURCE_KEY,
        "event_index",
        "position",
    )
