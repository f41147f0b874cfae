"""Predicates, sorts, limits and counts over sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as f
from ..operators import grouping as g
from ..operators import ranking as r
from .base import SRC, SRC_COLUMNS, events, query
from .describe_queries import DESC

IDS = "capture_id, source_id"


def _sources(spark, sf_dir):
    return g.group_sources(events(spark, sf_dir))


def _described(spark, sf_dir):
    from ..operators.describe import with_descriptions

    ev = events(spark, sf_dir, with_params=True)
    return with_descriptions(g.group_sources(ev), ev)


def _keys(df):
    return df.select("capture_id", "source_id")


@query(
    "filter_type",
    f"{SRC} SELECT {IDS} FROM src WHERE contains(lower(source_type_name), 'socket') OR contains(lower(source_type_name), 'url_')",
)
def filter_type(spark, sf_dir):
    return _keys(_sources(spark, sf_dir).where(f.filter_type(["Socket", "URL_"])))


@query("filter_id", f"{SRC} SELECT {IDS} FROM src WHERE source_id IN (1, 5, 77)")
def filter_id(spark, sf_dir):
    return _keys(_sources(spark, sf_dir).where(f.filter_id([1, 5, 77])))


@query("filter_active", f"{SRC} SELECT {IDS} FROM src WHERE is_active")
def filter_active(spark, sf_dir):
    return _keys(_sources(spark, sf_dir).where(f.filter_active()))


@query("filter_error", f"{SRC} SELECT {IDS} FROM src WHERE is_error")
def filter_error(spark, sf_dir):
    return _keys(_sources(spark, sf_dir).where(f.filter_error()))


NOON = 1705320000000.0  # 2024-01-15 12:00 UTC


@query("filter_active_at", f"{SRC} SELECT {IDS} FROM src WHERE start_ticks <= {NOON} AND {NOON} <= start_ticks + duration")
def filter_active_at(spark, sf_dir):
    return _keys(_sources(spark, sf_dir).where(f.filter_active_at(NOON)))


@query(
    "filter_text",
    f"""{DESC} SELECT src.capture_id, src.source_id FROM src JOIN described USING (capture_id, source_id)
    WHERE contains(lower(description), '7') OR contains(lower(source_type_name), '7')
       OR contains(CAST(source_id AS VARCHAR), '7')""",
)
def filter_text(spark, sf_dir):
    return _keys(_described(spark, sf_dir).where(f.filter_text("7")))


@query(
    "has_param_text",
    SRC
    + """SELECT DISTINCT capture_id, source_id FROM ev WHERE contains(coalesce(host, '') || '|' || coalesce(url, ''), 'h7')
    OR (has_params AND user_id % 7 = 0 AND event_type = 'view' AND k % 2 = 0 AND contains('h' || k, 'h7'))""",
)
def has_param_text(spark, sf_dir):
    return f.has_param_text(events(spark, sf_dir, with_params=True), "H7")


@query(
    "filter_sources",
    SRC
    + """, hits AS (SELECT DISTINCT capture_id, source_id FROM ev WHERE contains(coalesce(host, ''), '.example')
      OR contains(coalesce(url, ''), '.example')
      OR (has_params AND user_id % 7 = 0 AND event_type = 'view' AND k % 2 = 0))
    SELECT capture_id, source_id, duration FROM src SEMI JOIN hits USING (capture_id, source_id)
    WHERE (contains(lower(source_type_name), 'url') OR contains(lower(source_type_name), 'host'))
      AND is_error AND NOT is_active""",
)
def filter_sources(spark, sf_dir):
    ev = events(spark, sf_dir, with_params=True)
    found = f.filter_sources(
        g.group_sources(ev),
        types=["url", "host"],
        error=True,
        exclude=[f.filter_active()],
        has=".example",
        events=ev,
    )
    return found.select("capture_id", "source_id", "duration")


@query(
    "filter_rows_any_column",
    """SELECT page_id, url, html FROM pages WHERE contains(lower(CAST(page_id AS VARCHAR)), '.net/en')
    OR contains(lower(url), '.net/en') OR contains(lower(html), '.net/en')""",
)
def filter_rows_any_column(spark, sf_dir):
    return f.filter_rows_any_column(spark.read.parquet(f"{sf_dir}/pages.parquet"), ".NET/en")


def _sorted_query(name, by, backwards, order):
    @query(
        f"sort_sources_{name}",
        f"""{SRC}, ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM src)
        SELECT capture_id, source_id, position FROM ranked""",
    )
    def run(spark, sf_dir):
        ordered = r.sort_sources(_sources(spark, sf_dir), by, backwards).select("capture_id", "source_id")
        return r.with_position(ordered)

    return run


_sorted_query("time", "time", False, "start_ticks, source_id, first_event_index, capture_id")
_sorted_query("id_backwards", "id", True, "source_id DESC, first_event_index DESC, capture_id DESC")
_sorted_query("active", "active", False, "NOT is_active, first_event_index, capture_id")
_sorted_query("duration", "duration", True, "duration DESC, first_event_index DESC, capture_id DESC")
_sorted_query("type", "type", False, "source_type_name, first_event_index, capture_id")


@query(
    "sort_sources_desc",
    f"""{DESC}, ranked AS (SELECT src.capture_id, src.source_id,
      row_number() OVER (ORDER BY description, first_event_index, src.capture_id) AS position
      FROM src JOIN described USING (capture_id, source_id))
    SELECT capture_id, source_id, position FROM ranked""",
)
def sort_sources_desc(spark, sf_dir):
    return r.with_position(r.sort_sources(_described(spark, sf_dir), "desc").select("capture_id", "source_id"))


@query(
    "sort_rows",
    """SELECT page_id, url, html, row_number() OVER (ORDER BY lower(url) DESC, page_id DESC) AS position FROM pages""",
)
def sort_rows(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return r.with_position(r.sort_rows(pages, "url", desc=True, tie="page_id"))


@query(
    "top_sources",
    f"""{SRC} SELECT capture_id, source_id, (SELECT count(*) FROM src WHERE is_error) AS total_matches
    FROM src WHERE is_error ORDER BY start_ticks, source_id, first_event_index, capture_id LIMIT 2000""",
)
def top_sources(spark, sf_dir):
    failed = _sources(spark, sf_dir).where(f.filter_error())
    return r.top_sources(failed, 2000).select("capture_id", "source_id", "total_matches")


@query("order_details", f"{SRC} SELECT {SRC_COLUMNS} FROM src WHERE source_id IN (3, 1, 2)")
def order_details(spark, sf_dir):
    return r.order_details(_sources(spark, sf_dir).where(f.filter_id([3, 1, 2])))


@query(
    "error_count",
    f"{SRC} SELECT capture_id, count(*) FILTER (WHERE is_error) AS error_sources, count(*) AS sources FROM src GROUP BY 1",
)
def error_count(spark, sf_dir):
    return r.error_count(_sources(spark, sf_dir))


@query(
    "capture_stats",
    f"{SRC} SELECT capture_id, count(*) AS event_count, count(DISTINCT source_id) AS source_count FROM ev GROUP BY 1",
)
def capture_stats(spark, sf_dir):
    return r.capture_stats(events(spark, sf_dir))


@query(
    "busiest_sources",
    f"""{SRC}, tot AS (SELECT capture_id, sum(event_count) AS events, count(*) AS sources,
      count(*) FILTER (WHERE is_error) AS error_sources FROM src GROUP BY 1),
    ranked AS (SELECT capture_id, source_id, event_count,
      row_number() OVER (PARTITION BY capture_id ORDER BY event_count DESC, first_event_index) AS rank FROM src)
    SELECT capture_id, source_id, event_count, rank, events, sources, error_sources
    FROM ranked JOIN tot USING (capture_id) WHERE rank <= 3""",
)
def busiest_sources(spark, sf_dir):
    return r.busiest_sources(_sources(spark, sf_dir))


@query(
    "union_parts",
    f"{SRC} SELECT capture_id, source_id, event_index FROM ev",
)
def union_parts(spark, sf_dir):
    # parts of a split capture concatenated again
    ev = events(spark, sf_dir).select("capture_id", "source_id", "event_index", "phase_name")
    parts = [ev.where(F.col("phase_name") == p).drop("phase_name") for p in ("PHASE_BEGIN", "PHASE_END", "PHASE_NONE")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
