"""Event traces and text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping as g
from ..operators import trace as tr
from ..sources import sample_tables as st
from ..operators import params as pr
from .base import SRC, events, query
from .param_queries import PARAM_LINES

# steps: the open BEGINs of each source as a list, one event per recursion step
PAIRS = (
    SRC
    + """, caps AS (SELECT capture_id, arg_min(time_ms, event_index) AS base_ms, arg_max(time_ms, event_index) AS export_ms
  FROM ev GROUP BY 1),
steps AS (
  SELECT capture_id, source_id, rn, event_index, CAST(NULL AS BIGINT) AS parent_index, 0 AS depth,
    CAST(NULL AS BIGINT) AS begin_index, CAST([] AS BIGINT[]) AS closed,
    CASE WHEN phase_name = 'PHASE_BEGIN' THEN [{'t': type, 'i': event_index}]
      ELSE CAST([] AS STRUCT(t INTEGER, i BIGINT)[]) END AS stack
  FROM firsts WHERE rn = 1
  UNION ALL
  SELECT capture_id, source_id, rn, event_index, rest[len(rest)].i AS parent_index, CAST(len(rest) AS INTEGER) AS depth,
    CASE WHEN spot > 0 THEN stack[spot].i END AS begin_index,
    CASE WHEN spot > 0 THEN list_transform(stack[spot:], lambda x: x.i) ELSE CAST([] AS BIGINT[]) END AS closed,
    CASE WHEN phase_name = 'PHASE_BEGIN' THEN list_append(rest, {'t': type, 'i': event_index}) ELSE rest END AS stack
  FROM (
    SELECT *, CASE WHEN spot > 0 THEN stack[1:spot - 1] ELSE stack END AS rest FROM (
      SELECT e.capture_id, e.source_id, e.rn, e.event_index, e.type, e.phase_name, s.stack,
        CASE WHEN e.phase_name = 'PHASE_END' AND list_contains(list_transform(s.stack, lambda x: x.t), e.type)
          THEN len(s.stack) + 1 - list_position(list_reverse(list_transform(s.stack, lambda x: x.t)), e.type)
          ELSE 0 END AS spot
      FROM steps s JOIN firsts e ON e.capture_id = s.capture_id AND e.source_id = s.source_id AND e.rn = s.rn + 1))),
ends AS (SELECT capture_id, source_id, event_index AS end_index, rn AS end_rn, unnest(closed) AS begin_index FROM steps),
paired AS (
  SELECT f.capture_id, f.source_id, f.event_index, f.rn, f.phase_name, f.type_name, f.time_ticks, f.has_params,
    s.depth, s.parent_index, s.begin_index, e.end_index, x.time_ticks AS end_ticks,
    coalesce(e.end_rn = f.rn + 1 AND NOT (f.has_params AND x.has_params), false) AS collapsible
  FROM firsts f JOIN steps s ON s.capture_id = f.capture_id AND s.source_id = f.source_id AND s.rn = f.rn
  LEFT JOIN ends e ON e.capture_id = f.capture_id AND e.source_id = f.source_id AND e.begin_index = f.event_index
  LEFT JOIN firsts x ON x.capture_id = f.capture_id AND x.source_id = f.source_id AND x.event_index = e.end_index),
matched AS (
  SELECT p.*, coalesce(b.collapsible, false) AS hidden FROM paired p
  LEFT JOIN paired b ON b.capture_id = p.capture_id AND b.source_id = p.source_id AND b.event_index = p.begin_index),
traced AS (
  SELECT m.capture_id, m.source_id, event_index, m.time_ticks - base_ms AS t, m.time_ticks - start_ticks AS st, depth,
    CASE WHEN phase_name = 'PHASE_BEGIN' AND NOT collapsible THEN '+' WHEN phase_name = 'PHASE_END' THEN '-' ELSE ' ' END AS marker,
    CASE WHEN phase_name = 'PHASE_BEGIN' THEN coalesce(m.end_ticks - m.time_ticks, export_ms - m.time_ticks) END AS dt,
    phase_name = 'PHASE_BEGIN' AND m.end_index IS NULL AS is_open, type_name
  FROM matched m JOIN src ON src.capture_id = m.capture_id AND src.source_id = m.source_id
  JOIN caps ON caps.capture_id = m.capture_id WHERE NOT hidden)
"""
)


def _trace(spark, sf_dir):
    ev = events(spark, sf_dir)
    return tr.event_trace(ev, g.group_sources(ev), st.capture_scalars(ev))


@query(
    "match_begin_end",
    f"""{PAIRS} SELECT capture_id, source_id, event_index, depth, parent_index, begin_index, end_index, end_ticks,
    collapsible, hidden FROM matched""",
)
def match_begin_end(spark, sf_dir):
    return tr.match_begin_end(events(spark, sf_dir))


@query(
    "match_begin_end_chunked",
    f"""{PAIRS} SELECT capture_id, source_id, event_index, depth, parent_index, begin_index, end_index, end_ticks,
    collapsible, hidden FROM matched""",
)
def match_begin_end_chunked(spark, sf_dir):
    # sources of more than four events take the path of giant sources
    return tr.match_begin_end(events(spark, sf_dir), chunk_rows=4)


_CLOCK = "CASE WHEN dt = floor(dt) THEN CAST(CAST(dt AS BIGINT) AS VARCHAR) ELSE CAST(dt AS VARCHAR) END"


_TEXT = f"""marker || type_name || CASE WHEN dt IS NULL THEN '' ELSE '  [dt=' || {_CLOCK} || CASE WHEN is_open THEN '+' ELSE '' END || ']' END"""


@query(
    "event_trace",
    f"""{PAIRS} SELECT capture_id, source_id, event_index, round(t, 3) AS t, round(st, 3) AS st, depth, marker,
    round(dt, 3) AS dt, is_open, {_TEXT} AS text FROM traced""",
)
def event_trace(spark, sf_dir):
    rounded = [F.round(c, 3).alias(c) for c in ("t", "st", "dt")]
    return _trace(spark, sf_dir).select("capture_id", "source_id", "event_index", "depth", "marker", "is_open", "text", *rounded)


@query(
    "begin_duration",
    f"""{PAIRS} SELECT m.capture_id, source_id, event_index, end_index,
    round(coalesce(end_ticks - time_ticks, export_ms - time_ticks), 3) AS dt, end_index IS NULL AS is_open
    FROM matched m JOIN caps ON caps.capture_id = m.capture_id WHERE phase_name = 'PHASE_BEGIN'""",
)
def begin_duration(spark, sf_dir):
    ev = events(spark, sf_dir)
    return tr.begin_duration(ev, st.capture_scalars(ev)).withColumn("dt", F.round("dt", 3))


@query("collapse_pairs", f"{PAIRS} SELECT capture_id, source_id, event_index, end_index FROM matched WHERE collapsible")
def collapse_pairs(spark, sf_dir):
    return tr.collapse_pairs(events(spark, sf_dir))


@query(
    "trace_open_tail",
    f"""{PAIRS} SELECT m.capture_id, m.source_id, round(export_ms - base_ms, 3) AS t, round(export_ms - start_ticks, 3) AS st
    FROM (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY capture_id, source_id ORDER BY rn DESC) = 1) m
    JOIN src ON src.capture_id = m.capture_id AND src.source_id = m.source_id
    JOIN caps ON caps.capture_id = m.capture_id WHERE depth <> 0 OR phase_name = 'PHASE_BEGIN'""",
)
def trace_open_tail(spark, sf_dir):
    ev = events(spark, sf_dir)
    tail = tr.trace_open_tail(ev, g.group_sources(ev), st.capture_scalars(ev))
    return tail.select("capture_id", "source_id", F.round("t", 3).alias("t"), F.round("st", 3).alias("st"))


@query(
    "trace_search",
    f"""{PAIRS}, hits AS (SELECT capture_id, source_id, event_index, marker || type_name AS head FROM traced
      WHERE contains(type_name, 'URL_REQUEST'))
    SELECT capture_id, source_id, event_index, 0 AS match_no, 1 AS match_start, 12 AS match_end,
      count(*) OVER (PARTITION BY capture_id, source_id) > 2 AS truncated FROM hits
    QUALIFY row_number() OVER (PARTITION BY capture_id, source_id ORDER BY event_index) <= 2""",
)
def trace_search(spark, sf_dir):
    return tr.trace_search(_trace(spark, sf_dir), "url_request", max_matches=2)


@query(
    "trace_search_lines",
    f"""{PAIRS}, {PARAM_LINES}, below AS (
      SELECT capture_id, source_id, event_index, chr(10) || string_agg(line, chr(10) ORDER BY key, line_no) AS b FROM lined GROUP BY ALL),
    block AS (SELECT capture_id, source_id, event_index, {_TEXT} || coalesce(b, '') AS text
      FROM traced LEFT JOIN below USING (capture_id, source_id, event_index)),
    placed AS (SELECT *, string_split(lower(text), 'example') AS p,
      sum(length(text) + 1) OVER (PARTITION BY capture_id, source_id ORDER BY event_index) - length(text) - 1 AS before FROM block),
    hits AS (SELECT *, unnest(range(1, len(p))) AS j FROM placed),
    spots AS (SELECT *, CAST(list_sum(list_transform(p[1:j], lambda x: length(x))) + (j - 1) * 7 AS INTEGER) AS match_start FROM hits)
    SELECT capture_id, source_id, event_index, CAST(j - 1 AS INTEGER) AS match_no, match_start, match_start + 7 AS match_end,
      CAST(len(string_split(text[1:match_start], chr(10))) - 1 AS INTEGER) AS line_no,
      CAST(length(string_split(text[1:match_start], chr(10))[-1]) AS INTEGER) AS line_start,
      CAST(before + match_start AS BIGINT) AS text_start, false AS truncated FROM spots""",
)
def trace_search_lines(spark, sf_dir):
    ev = events(spark, sf_dir, with_params=True)
    return tr.trace_search(_trace(spark, sf_dir), "Example", lines=pr.param_lines(ev, st.enum_rows(ev)))


@query(
    "find_matches",
    """WITH parts AS (SELECT doc_id, string_split(text, 'the') AS p FROM documents),
    hits AS (SELECT doc_id, p, unnest(range(1, len(p))) AS j FROM parts)
    SELECT doc_id, CAST(j - 1 AS INTEGER) AS match_no,
      CAST(list_sum(list_transform(p[1:j], lambda x: length(x))) + (j - 1) * 3 AS INTEGER) AS match_start,
      CAST(list_sum(list_transform(p[1:j], lambda x: length(x))) + (j - 1) * 3 + 3 AS INTEGER) AS match_end FROM hits""",
)
def find_matches(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tr.find_matches(docs, "text", "the", case_sensitive=True)


@query(
    "find_matches_regex",
    """SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n, array_to_string(regexp_extract_all(text, '[0-9]+'), ',') AS found
    FROM documents WHERE regexp_matches(text, '[0-9]')""",
)
def find_matches_regex(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("text").alias("shown"))
    found = tr.find_matches(docs, "text", "[0-9]+", use_regex=True)
    # what lies at the offsets, in the order of the matches
    hit = F.substring("shown", F.col("match_start") + 1, F.col("match_end") - F.col("match_start"))
    listed = F.array_sort(F.collect_list(F.struct("match_no", hit.alias("hit"))))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda r: r["hit"]), ",").alias("found"))
