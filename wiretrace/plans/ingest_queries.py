"""Ingestion: raw elements built from the sample events, decoded and validated again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import jsvalue as js
from ..functions.text import format_time
from ..operators import decode as d
from ..sources import captures as cap
from ..sources import sample_tables as st
from ..session import checkpoint_dir
from .base import EV, events, query
from .polled_queries import _WHEN

_CONSTANTS = {
    "logFormatVersion": 1,
    "logEventTypes": st.ENUMS["logEventType"],
    "logEventPhase": st.ENUMS["logEventPhase"],
    "logSourceType": st.ENUMS["logSourceType"],
    **{n: st.ENUMS[n] for n in ("netError", "loadFlag", "loadState", "certStatusFlag", "quicError")},
    "addressFamily": {},
    "clientInfo": {"name": "Browser", "version": "1.0"},
}
# faults in the raw elements, by k: broken text, unknown type, passive capture
VERDICT = (
    "CASE WHEN {k} % 17 = 3 THEN 'malformed' WHEN {k} % 19 = 5 THEN 'invalid' WHEN {k} % 23 = 7 THEN 'passive' ELSE 'valid' END"
)


def _elements(spark, sf_dir):
    """``capture_id, event_index, text``: one JSON element per sample event."""
    raw = st.load(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    ev = events(spark, sf_dir).join(raw, F.col("event_id") == F.col("event_index"))
    element = F.to_json(
        F.struct(
            F.struct(F.col("source_id").alias("id"), F.col("source_type").alias("type"), F.col("start_time").cast("string").alias("start_time")).alias("source"),
            F.when(F.col("k") % 19 == 5, F.lit(999)).otherwise(F.col("type")).alias("type"),
            F.col("time_ticks").cast("string").alias("time"),
            "phase",
            F.when(F.col("net_error").isNotNull(), F.struct("net_error")).alias("params"),
            F.when(F.col("k") % 23 == 7, F.lit(True)).alias("wasPassivelyCaptured"),
        )
    )
    text = F.when(F.col("k") % 17 == 3, F.lit('{"source": bad}')).otherwise(element)
    return ev.select("capture_id", "event_index", "time_ticks", text.alias("text"))


def _heads(spark, sf_dir):
    """Captures with constants; every capture has one event type of its own, and a
    second name for an id."""
    own = F.concat(
        F.lit(json.dumps(_CONSTANTS)[:-1] + ', "timeTickOffset": "0", "certVerifierFlags": {"V'),
        F.col("capture_id"), F.lit('": 5, "A": 5, "text": "x"}, "logCaptureMode": "M'), F.col("capture_id"), F.lit('"}'),
    )
    days = events(spark, sf_dir).select("capture_id").distinct()
    return days.select("capture_id", js.parsed(own, "constants"))


def _checked(spark, sf_dir):
    names = d.enum_names(d.decode_enums(_heads(spark, sf_dir)))
    raw = _elements(spark, sf_dir).select("capture_id", "event_index", js.parsed(F.col("text"), "element"))
    return d.validate_events(raw, names)


_VERDICTS = f"{EV}, verdicts AS (SELECT *, {VERDICT.format(k='k')} AS verdict FROM ev)"


@query("validate_events", f"{_VERDICTS} SELECT capture_id, event_index, verdict FROM verdicts")
def validate_events(spark, sf_dir):
    return _checked(spark, sf_dir).select("capture_id", "event_index", "verdict")


@query(
    "discard_passive",
    f"""{_VERDICTS} SELECT capture_id, event_index, type_name, source_type_name, phase_name, source_id,
    round(time_ticks, 3) AS time_ticks FROM verdicts WHERE verdict = 'valid'""",
)
def discard_passive(spark, sf_dir):
    return d.discard_passive(_checked(spark, sf_dir)).select(
        "capture_id", "event_index", "type_name", "source_type_name", "phase_name", "source_id",
        F.round("time_ticks", 3).alias("time_ticks"),
    )


_COUNTS = f"""{_VERDICTS}, counts AS (SELECT capture_id, count(*) FILTER (WHERE verdict <> 'malformed') AS n_seen,
    count(*) FILTER (WHERE verdict = 'valid') AS n_valid, count(*) FILTER (WHERE verdict = 'invalid') AS n_invalid,
    count(*) FILTER (WHERE verdict = 'passive') AS n_passive, count(*) FILTER (WHERE verdict = 'malformed') AS n_malformed
  FROM verdicts GROUP BY 1)"""


@query("verdict_counts", f"{_COUNTS} SELECT * FROM counts")
def verdict_counts(spark, sf_dir):
    return d.verdict_counts(_checked(spark, sf_dir))


@query(
    "load_report",
    f"""{_COUNTS} SELECT capture_id,
    CASE WHEN n_valid > 300 THEN 'Reached the maximum of 300 events; the rest were not loaded.' || chr(10) || chr(10) ELSE '' END
    || CASE WHEN n_malformed > 0 THEN 'Skipped ' || n_malformed || ' unparseable event records.' || chr(10) || chr(10) ELSE '' END
    || CASE WHEN n_invalid > 0 THEN 'Unable to load ' || n_invalid || ' events, due to invalid data.' || chr(10) || chr(10) ELSE '' END
    || CASE WHEN n_passive > 0 THEN 'Discarded ' || n_passive || ' passively collected events.' || chr(10) || chr(10) ELSE '' END
    || 'Log loaded.' AS load_log FROM counts""",
)
def load_report(spark, sf_dir):
    table = d.verdict_counts(_checked(spark, sf_dir)).select(
        "*", F.lit("ok").alias("status"), F.lit(False).alias("truncated"), (F.col("n_valid") > 300).alias("cap_reached"),
        F.lit(1.0).alias("client_date_ms"),
    )
    return d.load_report(table, 300).select("capture_id", "load_log")


def _enum_sql(rows: str) -> str:
    listed = ", ".join(
        f"('{e if e != 'logEventType' else 'logEventTypes'}', '{n}', {i})" for e, names in st.ENUMS.items() for n, i in names.items()
    )
    return f"""{EV}, fixed(enum, name, id) AS (VALUES {listed}), days AS (SELECT DISTINCT capture_id FROM ev),
      all_names AS (SELECT capture_id, enum, name, id FROM days, fixed
        UNION ALL SELECT capture_id, 'certVerifierFlags', unnest(['V' || capture_id, 'A']), 5 FROM days) {rows}"""


@query("decode_enums", _enum_sql("SELECT * FROM all_names"))
def decode_enums(spark, sf_dir):
    return d.decode_enums(_heads(spark, sf_dir))


@query("enum_names", _enum_sql("SELECT capture_id, enum, id, max(name) AS name FROM all_names GROUP BY 1, 2, 3"))
def enum_names(spark, sf_dir):
    return d.enum_names(d.decode_enums(_heads(spark, sf_dir)))


@query(
    "resolve_names",
    f"""{EV} SELECT capture_id, event_index, CASE WHEN k % 19 = 5 THEN '' ELSE type_name END AS type_name,
    source_type_name, phase_name FROM ev""",
)
def resolve_names(spark, sf_dir):
    k5 = st.load(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    ids = events(spark, sf_dir).join(k5, F.col("at") == F.col("event_index")).select(
        "capture_id", "event_index", F.when(F.col("k") % 19 == 5, 999).otherwise(F.col("type")).alias("type"), "source_type", "phase"
    )
    named = d.resolve_names(ids, d.decode_enums(_heads(spark, sf_dir)))
    return named.select("capture_id", "event_index", "type_name", "source_type_name", "phase_name")


@query(
    "validate_constants",
    f"""{EV} SELECT DISTINCT capture_id, CASE CAST(substr(capture_id, 9) AS INTEGER) % 4
      WHEN 1 THEN 'Unable to load different log version. Found 2, Expected 1'
      WHEN 2 THEN 'Load failed:' || chr(10) || chr(10) || 'Invalid constants object.' || chr(10)
      WHEN 3 THEN 'Unable to parse log dump as JSON file.' END AS error,
    CASE WHEN CAST(substr(capture_id, 9) AS INTEGER) % 4 = 0 THEN 'ok' ELSE 'error' END AS status FROM ev""",
)
def validate_constants(spark, sf_dir):
    days = events(spark, sf_dir).select("capture_id").distinct()
    case = F.substring("capture_id", 9, 2).cast("int") % 4
    good = json.dumps(_CONSTANTS)[:-1] + ', "timeTickOffset": 0}'
    text = (
        F.when(case == 0, F.lit(good))
        .when(case == 1, F.lit(good.replace('"logFormatVersion": 1', '"logFormatVersion": 2')))
        .when(case == 2, F.lit("{}"))
    )
    return d.validate_constants(days.select("capture_id", js.parsed(text, "constants"))).select("capture_id", "status", "error")


def _captures(spark, sf_dir):
    """Capture scalars: a tick offset, client dates on even days only."""
    ev = events(spark, sf_dir)
    return ev.groupBy("capture_id").agg(
        F.lit(1000.0).alias("time_tick_offset"),
        (F.min_by("time_ticks", "event_index") + 1000.0).alias("base_time_ms"),
        F.max_by("time_ticks", "event_index").alias("last_event_ticks"),
        F.count("*").alias("n"),
    ).withColumn("client_date_ms", F.when(F.col("n") % 2 == 0, F.col("base_time_ms")))


_CAPS = f"""{EV}, caps AS (SELECT capture_id, arg_min(time_ticks, event_index) + 1000.0 AS base_ms,
    arg_max(time_ticks, event_index) AS last_ticks, count(*) AS n FROM ev GROUP BY 1),
  dated AS (SELECT *, CASE WHEN n % 2 = 0 THEN base_ms ELSE last_ticks + 1000.0 END AS numeric_date_ms FROM caps)"""


@query(
    "with_wall_time",
    f"""{_CAPS} SELECT capture_id, event_index, round(time_ticks + 1000.0, 3) AS time_ms,
    round(time_ticks + 1000.0 - base_ms, 3) AS relative_ms FROM ev JOIN caps USING (capture_id)""",
)
def with_wall_time(spark, sf_dir):
    timed = d.with_wall_time(events(spark, sf_dir), _captures(spark, sf_dir))
    return timed.select("capture_id", "event_index", *[F.round(c, 3).alias(c) for c in ("time_ms", "relative_ms")])


@query("export_date", f"{_CAPS} SELECT capture_id, numeric_date_ms FROM dated")
def export_date(spark, sf_dir):
    return d.export_date(_captures(spark, sf_dir)).select("capture_id", "numeric_date_ms")


@query(
    "format_time",
    f"{EV} SELECT capture_id, event_index, {_WHEN.format(ms='CAST(trunc(time_ms) AS BIGINT)')} AS shown FROM ev",
)
def format_time_query(spark, sf_dir):
    return events(spark, sf_dir).select("capture_id", "event_index", format_time(F.col("time_ms")).alias("shown"))


@query(
    "capture_metadata",
    f"""{_CAPS} SELECT capture_id, {_WHEN.format(ms='CAST(trunc(numeric_date_ms) AS BIGINT)')} AS export_date,
    CASE WHEN n % 3 = 0 THEN '(Not Recorded)' ELSE 'Default' END AS capture_mode, 'Browser' AS client_name, '' AS client_version,
    '' AS official, '' AS cl, '' AS version_mod, '' AS os_type, '' AS command_line, 'n ' || n AS user_comments FROM dated""",
)
def capture_metadata(spark, sf_dir):
    none = [F.lit(None).cast("string").alias(c) for c in ("client_version", "official", "cl", "version_mod", "os_type", "command_line")]
    caps = d.export_date(_captures(spark, sf_dir)).select(
        "*", F.when(F.col("n") % 3 != 0, F.lit("Default")).alias("capture_mode"), F.lit("Browser").alias("client_name"),
        F.concat(F.lit("n "), "n").alias("user_comments"), *none,
    )
    return d.capture_metadata(caps)


@query(
    "cap_events",
    f"{EV} SELECT capture_id, event_index FROM ev QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY event_index) <= 200",
)
def cap_events(spark, sf_dir):
    return d.cap_events(events(spark, sf_dir).select("capture_id", "event_index"), 200)


@query(
    "reindex_events",
    f"""{EV} SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY event_index) - 1 AS event_index, source_id
    FROM ev WHERE phase_name <> 'PHASE_NONE'""",
)
def reindex_events(spark, sf_dir):
    shown = events(spark, sf_dir).where("phase_name <> 'PHASE_NONE'").select("capture_id", "event_index", "source_id")
    return d.reindex_events(shown)


@query(
    "slim_events",
    f"""{EV} SELECT capture_id, event_index, has_params AND type_name IN ('SOCKET_BYTES_RECEIVED', 'UDP_BYTES_RECEIVED',
    'SOCKET_BYTES_SENT', 'UDP_BYTES_SENT', 'ENTRY_READ_DATA', 'ENTRY_WRITE_DATA') AS kept FROM ev""",
)
def slim_events(spark, sf_dir):
    slim = d.slim_events(events(spark, sf_dir, with_params=True))
    return slim.select("capture_id", "event_index", F.col("params").isNotNull().alias("kept"))


# --- files ------------------------------------------------------------------------

_PER_FILE = 2000
_FILES = f"""{_VERDICTS}, filed AS (SELECT *, 'c' || (event_index // {_PER_FILE}) AS file FROM verdicts)"""


def write_capture_files(spark, sf_dir) -> str:
    """Capture files of 2,000 events each, made from the sample events, in a folder of
    their own under the cluster's scratch folder."""
    folder = f"{checkpoint_dir(spark)}/capture-files-{uuid.uuid4().hex}"
    rows = _elements(spark, sf_dir).withColumn("file", F.concat(F.lit("c"), F.floor(F.col("event_index") / _PER_FILE)))
    lines = rows.select("file", F.col("event_index").alias("at"), F.concat("text", F.lit(",")).alias("value"))
    head = '{"constants": ' + json.dumps(_CONSTANTS)[:-1] + ', "timeTickOffset": 0},'
    edges = rows.select("file").distinct().select(
        "file",
        F.inline(F.array(
            F.struct(F.lit(-2).cast("bigint").alias("at"), F.lit(head).alias("value")),
            F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit('"events": [').alias("value")),
            F.struct(F.lit(1 << 62).alias("at"), F.concat(F.lit('], "polledData": {"name": "'), "file", F.lit('"}}')).alias("value")),
        )),
    )
    (
        lines.unionByName(edges)
        .repartition("file")
        .sortWithinPartitions("file", "at")
        .drop("at")
        .write.partitionBy("file")
        .text(folder)
    )
    return folder


def _file(column="capture_id"):
    return F.regexp_extract(column, "file=([^/]+)", 1).alias("file")


_READ = f"""{_FILES} SELECT file, row_number() OVER (PARTITION BY file ORDER BY event_index) AS position, source_id, type_name,
    phase_name, source_type_name, round(time_ticks, 3) AS time_ticks, net_error FROM filed WHERE verdict = 'valid'"""


def _read_events(events):
    dense = d.reindex_events(events)
    return dense.select(
        _file(), (F.col("event_index") + 1).alias("position"), "source_id", "type_name", "phase_name", "source_type_name",
        F.round("time_ticks", 3).alias("time_ticks"), "net_error",
    )


@query("read_captures", _READ)
def read_captures(spark, sf_dir):
    return _read_events(cap.read_captures(spark, write_capture_files(spark, sf_dir), select_files=False).events)


@query(
    "read_captures_report",
    f"""{_FILES} SELECT file, 'ok' AS status, count(*) FILTER (WHERE verdict <> 'malformed') AS n_seen,
    count(*) FILTER (WHERE verdict = 'valid') AS n_valid, count(*) FILTER (WHERE verdict = 'malformed') AS n_malformed,
    false AS truncated, file AS polled_name FROM filed GROUP BY file""",
)
def read_captures_report(spark, sf_dir):
    tables = cap.read_captures(spark, write_capture_files(spark, sf_dir), select_files=False)
    state = tables.polled.where("key = 'name'").select("capture_id", js.as_string(F.col("value")).alias("polled_name"))
    return tables.captures.join(state, "capture_id").select(
        _file(), "status", "n_seen", "n_valid", "n_malformed", "truncated", "polled_name"
    )


@query("read_captures_document", _READ)
def read_captures_document(spark, sf_dir):
    tables = cap.read_captures(spark, write_capture_files(spark, sf_dir), layout="document", select_files=False)
    return _read_events(tables.events)


@query("write_tables", _READ)
def write_tables(spark, sf_dir):
    tables = cap.read_captures(spark, write_capture_files(spark, sf_dir), select_files=False)
    folder = f"{checkpoint_dir(spark)}/capture-tables-{uuid.uuid4().hex}"
    cap.write_tables(tables, folder)
    return _read_events(cap.read_tables(spark, folder).events)
