"""Descriptions."""

from __future__ import annotations

from ..operators import describe as d
from .base import SRC, events, query

# described: versions per start-event change, parents as of the moment, by recursion
DESC = (
    SRC
    + """, texts AS (
  SELECT *, CASE
    WHEN NOT has_params THEN ''
    WHEN source_type_name = 'URL_REQUEST' THEN coalesce(url, '')
    WHEN source_type_name = 'HOST_RESOLVER_IMPL_JOB' THEN coalesce(host, '')
    WHEN source_type_name = 'DISK_CACHE_ENTRY' THEN coalesce(key, '')
    WHEN source_type_name = 'UDP_SOCKET' THEN coalesce(address, '')
    WHEN source_type_name = 'HTTP_STREAM_POOL_ATTEMPT_MANAGER' AND event_type = 'signup' THEN 'https://d' || k
    WHEN source_type_name = 'DOWNLOAD' AND type_name = 'DOWNLOAD_FILE_RENAMED' THEN coalesce(new_filename, '')
    WHEN source_type_name = 'DOWNLOAD' AND type_name IN ('DOWNLOAD_FILE_OPENED', 'DOWNLOAD_ITEM_ACTIVE')
      THEN coalesce(file_name, '')
    ELSE '' END AS own_text
  FROM firsts),
running AS (
  SELECT *,
    max(CASE WHEN type_name = 'DOWNLOAD_FILE_RENAMED' AND phase_name <> 'PHASE_END' THEN event_index END) OVER w AS r,
    min(CASE WHEN type_name = 'DOWNLOAD_FILE_OPENED' THEN event_index END) OVER w AS o,
    min(CASE WHEN type_name = 'DOWNLOAD_ITEM_ACTIVE' THEN event_index END) OVER w AS a,
    min(CASE WHEN rn = 1 THEN event_index END) OVER w AS e0,
    min(CASE WHEN rn = 2 AND type_name = 'UDP_CONNECT' THEN event_index END) OVER w AS e1
  FROM texts WINDOW w AS (PARTITION BY capture_id, source_id ORDER BY event_index
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
chosen AS (
  SELECT *, CASE WHEN source_type_name = 'DOWNLOAD' THEN coalesce(r, o, a, e1, e0) ELSE coalesce(e1, e0) END AS start_idx
  FROM running),
changed AS (
  SELECT *, lag(start_idx) OVER (PARTITION BY capture_id, source_id ORDER BY event_index) AS prev_start FROM chosen),
versions AS (
  SELECT c.capture_id, c.source_id, c.event_index AS eval_index, s.own_text, c.source_type_name, s.dep_id AS start_dep,
    f.dep_id AS first_dep, s.address,
    CASE WHEN c.source_type_name IN ('SOCKET', 'HTTP_STREAM_POOL_ATTEMPT_MANAGER') AND s.dep_id IS NOT NULL THEN 'copy'
      WHEN c.source_type_name = 'UDP_SOCKET' AND s.address IS NOT NULL AND f.type_name = 'SOCKET_ALIVE'
        AND f.dep_id IS NOT NULL THEN 'wrap' ELSE 'own' END AS use
  FROM changed c
  JOIN texts s ON s.capture_id = c.capture_id AND s.source_id = c.source_id AND s.event_index = c.start_idx
  JOIN texts f ON f.capture_id = c.capture_id AND f.source_id = c.source_id AND f.rn = 1
  WHERE c.prev_start IS NULL OR c.prev_start <> c.start_idx),
linked AS (
  SELECT v.capture_id, v.source_id, v.eval_index, v.own_text, v.use, max(p.eval_index) AS to_index,
    CASE WHEN v.use = 'copy' THEN v.start_dep WHEN v.use = 'wrap' THEN v.first_dep END AS to_source
  FROM versions v LEFT JOIN versions p ON p.capture_id = v.capture_id AND p.eval_index < v.eval_index
    AND p.source_id = CASE WHEN v.use = 'copy' THEN v.start_dep WHEN v.use = 'wrap' THEN v.first_dep END
    AND (v.use = 'copy' OR p.source_type_name = 'HOST_RESOLVER_IMPL_JOB')
  GROUP BY ALL),
resolved AS (
  SELECT capture_id, source_id, eval_index, CASE WHEN use = 'copy' THEN '' ELSE own_text END AS text
  FROM linked WHERE to_index IS NULL
  UNION ALL
  SELECT l.capture_id, l.source_id, l.eval_index,
    CASE WHEN l.use = 'copy' THEN p.text WHEN p.text <> '' THEN l.own_text || ' [' || p.text || ']' ELSE l.own_text END
  FROM linked l JOIN resolved p ON p.capture_id = l.capture_id AND p.source_id = l.to_source AND p.eval_index = l.to_index),
described AS (SELECT capture_id, source_id, arg_max(text, eval_index) AS description FROM resolved GROUP BY ALL)
"""
)


@query("describe_sources", f"{DESC} SELECT capture_id, source_id, description FROM described")
def describe_sources(spark, sf_dir):
    return d.describe_sources(events(spark, sf_dir, with_params=True))


@query(
    "source_start_event",
    f"""{DESC} SELECT c.capture_id, c.source_id, max(c.event_index) AS start_event_index,
      arg_max(s.type_name, c.event_index) AS start_type_name
    FROM changed c JOIN texts s ON s.capture_id = c.capture_id AND s.source_id = c.source_id AND s.event_index = c.start_idx
    WHERE c.prev_start IS NULL OR c.prev_start <> c.start_idx GROUP BY ALL""",
)
def source_start_event(spark, sf_dir):
    return d.source_start_event(events(spark, sf_dir, with_params=True))
