"""Network-event shape for the plain sample tables.

The ``events`` table is a generic click stream. ``SAMPLE_EVENT_COLUMNS`` restates
it as network events: one expression per column, written so that Spark and any
ANSI engine agree. ``{k}``, ``{day}`` and ``{ticks}`` are the three places where
engines differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.jsvalue import parsed

SOURCE_TYPES = (
    "NONE",
    "URL_REQUEST",
    "SOCKET",
    "HOST_RESOLVER_IMPL_JOB",
    "UDP_SOCKET",
    "DISK_CACHE_ENTRY",
    "DOWNLOAD",
    "HTTP_STREAM_POOL_ATTEMPT_MANAGER",
)
EVENT_TYPES = (
    "REQUEST_ALIVE",
    "URL_REQUEST_START_JOB",
    "SOCKET_ALIVE",
    "SOCKET_IN_USE",
    "HOST_RESOLVER_IMPL_JOB",
    "HOST_RESOLVER_IMPL_ATTEMPT",
    "UDP_CONNECT",
    "DISK_CACHE_ENTRY_IMPL",
    "ENTRY_READ_DATA",
    "ENTRY_WRITE_DATA",
    "DOWNLOAD_ITEM_ACTIVE",
    "DOWNLOAD_FILE_OPENED",
    "DOWNLOAD_FILE_RENAMED",
    "HTTP_STREAM_POOL_ATTEMPT_MANAGER_ALIVE",
    "HTTP_STREAM_POOL_ATTEMPT_MANAGER_START_JOB",
    "SSL_CONNECT",
    "SOCKET_BYTES_RECEIVED",
    "SOCKET_BYTES_SENT",
    "UDP_BYTES_RECEIVED",
    "UDP_BYTES_SENT",
    "FAILED",
    "SSL_CERTIFICATES_RECEIVED",
)
PHASES = ("PHASE_NONE", "PHASE_BEGIN", "PHASE_END")

ENUMS: dict[str, dict[str, int]] = {
    "logSourceType": {name: i for i, name in enumerate(SOURCE_TYPES)},
    "logEventType": {name: i for i, name in enumerate(EVENT_TYPES)},
    "logEventPhase": {name: i for i, name in enumerate(PHASES)},
    "netError": {"OK": 0, "ERR_IO_PENDING": -1, "ERR_FAILED": -2, "ERR_ABORTED": -3, "ERR_TIMED_OUT": -7},
    "loadFlag": {"NORMAL": 0, "VALIDATE_CACHE": 1, "BYPASS_CACHE": 2, "SKIP_CACHE_VALIDATION": 4, "ONLY_FROM_CACHE": 8},
    "loadState": {"IDLE": 0, "WAITING_FOR_DELEGATE": 1, "CONNECTING": 2, "SSL_HANDSHAKE": 3},
    "certStatusFlag": {"COMMON_NAME_INVALID": 1, "DATE_INVALID": 2, "AUTHORITY_INVALID": 4, "REVOKED": 64},
    "quicError": {"QUIC_NO_ERROR": 0, "QUIC_INTERNAL_ERROR": 1, "QUIC_STREAM_DATA_AFTER_TERMINATION": 2},
}

_SOURCE_TYPE = (
    "CASE user_id % 7 WHEN 0 THEN 'URL_REQUEST' WHEN 1 THEN 'SOCKET' WHEN 2 THEN 'HOST_RESOLVER_IMPL_JOB'"
    " WHEN 3 THEN 'UDP_SOCKET' WHEN 4 THEN 'DISK_CACHE_ENTRY' WHEN 5 THEN 'DOWNLOAD'"
    " ELSE 'HTTP_STREAM_POOL_ATTEMPT_MANAGER' END"
)
_LIFE_TYPE = (
    "CASE user_id % 7 WHEN 0 THEN 'REQUEST_ALIVE' WHEN 1 THEN 'SOCKET_ALIVE' WHEN 2 THEN 'HOST_RESOLVER_IMPL_JOB'"
    " WHEN 3 THEN 'SOCKET_ALIVE' WHEN 4 THEN 'DISK_CACHE_ENTRY_IMPL' WHEN 5 THEN 'DOWNLOAD_ITEM_ACTIVE'"
    " ELSE 'HTTP_STREAM_POOL_ATTEMPT_MANAGER_ALIVE' END"
)
_WORK_TYPE = (
    "CASE user_id % 7 WHEN 0 THEN 'URL_REQUEST_START_JOB' WHEN 1 THEN 'SOCKET_IN_USE'"
    " WHEN 2 THEN 'HOST_RESOLVER_IMPL_ATTEMPT' WHEN 3 THEN 'UDP_CONNECT'"
    " WHEN 4 THEN CASE WHEN {k} % 2 = 0 THEN 'ENTRY_WRITE_DATA' ELSE 'ENTRY_READ_DATA' END"
    " WHEN 5 THEN CASE WHEN {k} % 3 = 0 THEN 'DOWNLOAD_FILE_OPENED' ELSE 'DOWNLOAD_FILE_RENAMED' END"
    " ELSE 'HTTP_STREAM_POOL_ATTEMPT_MANAGER_START_JOB' END"
)
_ERROR_TYPE = (
    "CASE WHEN user_id % 7 = 1 AND {k} % 4 = 1 THEN 'SOCKET_BYTES_RECEIVED'"
    " WHEN user_id % 7 = 1 AND {k} % 4 = 2 THEN 'SOCKET_BYTES_SENT'"
    " WHEN user_id % 7 = 1 AND {k} % 4 = 3 THEN 'SSL_CONNECT'"
    " WHEN user_id % 7 = 1 THEN 'SSL_CERTIFICATES_RECEIVED'"
    " WHEN user_id % 7 = 3 AND {k} % 4 = 1 THEN 'UDP_BYTES_RECEIVED'"
    " WHEN user_id % 7 = 3 AND {k} % 4 = 2 THEN 'UDP_BYTES_SENT' ELSE 'FAILED' END"
)


def _ids(name_sql: str, names: tuple[str, ...]) -> str:
    return f"CASE {name_sql} " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names)) + " END"


_TYPE = (
    f"CASE WHEN event_type IN ('signup', 'purchase') THEN {_LIFE_TYPE}"
    f" WHEN event_type IN ('view', 'click') THEN {_WORK_TYPE} ELSE {_ERROR_TYPE} END"
)
_PHASE = (
    "CASE WHEN event_type IN ('signup', 'view') THEN 'PHASE_BEGIN'"
    " WHEN event_type IN ('purchase', 'click') THEN 'PHASE_END'"
    " WHEN user_id % 7 = 1 AND {k} % 4 = 3 THEN 'PHASE_END' ELSE 'PHASE_NONE' END"
)
# events whose k is a multiple of 11 carry no params at all
_HAS = "{k} % 11 <> 0"


def _param(condition: str, value: str) -> str:
    return f"CASE WHEN {_HAS} AND {condition} THEN {value} END"


_BYTES = "CAST(FLOOR(value * 1000) AS DOUBLE)"

SAMPLE_EVENT_COLUMNS: dict[str, str] = {
    "capture_id": "{day}",
    "event_index": "event_id",
    "time_ticks": "{ticks}",
    "time_ms": "{ticks}",
    "type": _ids(_TYPE, EVENT_TYPES),
    "type_name": _TYPE,
    "phase": _ids(_PHASE, PHASES),
    "phase_name": _PHASE,
    "source_id": "user_id",
    "source_type": _ids(_SOURCE_TYPE, SOURCE_TYPES),
    "source_type_name": _SOURCE_TYPE,
    "start_time": "CASE WHEN {k} % 13 = 0 THEN {ticks} - 5.0 END",
    "has_params": _HAS,
}
SAMPLE_PARAM_COLUMNS: dict[str, str] = {
    "net_error": _param("event_type = 'error'", "CAST(-{k} AS DOUBLE)"),
    "byte_count": _param("event_type = 'error' AND user_id % 7 IN (1, 3) AND {k} % 4 IN (1, 2)", _BYTES),
    "bytes_copied": _param("event_type = 'click' AND user_id % 7 = 4", _BYTES),
    "url": _param("user_id % 7 = 0 AND event_type IN ('signup', 'view')", "'https://h' || {k} || '.example/'"),
    "method": _param("user_id % 7 = 0 AND event_type = 'signup' AND {k} % 3 = 0", "'GET'"),
    "line": _param(
        "user_id % 7 = 0 AND event_type = 'view' AND {k} % 2 = 0", "'POST /p' || {k} || ' HTTP/1.1' || chr(13) || chr(10)"
    ),
    "host": _param("user_id % 7 = 2 AND event_type <> 'error'", "'h' || {k} || '.example'"),
    "address": _param("user_id % 7 = 3 AND event_type IN ('view', 'click')", "'10.0.0.' || {k}"),
    "key": _param("user_id % 7 = 4 AND event_type <> 'error'", "'entry-' || {k}"),
    "file_name": _param("user_id % 7 = 5 AND event_type <> 'error'", "'part-' || {k}"),
    "new_filename": _param("user_id % 7 = 5 AND event_type IN ('view', 'click')", "'final-' || {k}"),
    "load_flags": _param("user_id % 7 = 0 AND event_type = 'purchase'", "CAST({k} AS BIGINT)"),
    "load_state": _param("user_id % 7 = 0 AND event_type = 'view'", "CAST({k} % 6 AS BIGINT)"),
    "cert_status": _param("user_id % 7 = 1 AND event_type = 'error' AND {k} % 4 = 0", "CAST({k} * 3 AS BIGINT)"),
    "ocsp_response": _param(
        "user_id % 7 = 1 AND event_type = 'error' AND {k} % 8 = 0", "'ocsp ' || {k} || chr(10) || 'end'"
    ),
    "quic_error": _param("user_id % 7 = 3 AND event_type = 'error'", "CAST({k} % 5 AS BIGINT)"),
}
# who a source depends on: sockets on resolver jobs or attempt managers, UDP sockets
# on resolver jobs, attempt managers on sockets
SAMPLE_DEPENDENCY = (
    "CASE WHEN {k} % 11 <> 0 AND {k} % 4 <> 0 AND event_type = 'signup' THEN CASE user_id % 7"
    " WHEN 1 THEN CASE WHEN {k} % 2 = 0 THEN user_id + 1 ELSE user_id + 5 END"
    " WHEN 3 THEN user_id - 1 WHEN 6 THEN user_id - 5 END END"
)

_SPARK = {
    "k": "cast(get_json_object(props, '$.k') as int)",
    "day": "date_format(ts, 'yyyy-MM-dd')",
    "ticks": "(cast(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as double) / 1000D)",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _params_json() -> F.Column:
    """The params object of a sample event as JSON text (absent keys omitted)."""
    request = "user_id % 7 = 0 AND event_type = 'view' AND k % 2 = 0"
    response = "user_id % 7 = 0 AND event_type = 'click'"
    fields = [f"{name} AS {name}" for name in SAMPLE_PARAM_COLUMNS]
    fields.append(
        f"CASE WHEN {request} THEN array('Host: h' || k || '.example', 'Accept: */*')"
        f" WHEN {response} AND k % 2 = 1 THEN array('HTTP/1.1 ' || (200 + k) || ' OK', 'Content-Length: ' || k)"
        f" WHEN {response} THEN array('X-Note: ' || k) END AS headers"
    )
    fields.append(
        "CASE WHEN dep_id IS NOT NULL THEN named_struct('id', dep_id, 'type',"
        " CASE dep_id % 7 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 7 END) END AS source_dependency"
    )
    fields.append(
        "CASE WHEN user_id % 7 = 1 AND event_type = 'error' AND k % 4 = 0"
        " THEN array('-BEGIN-' || chr(10) || 'c' || k, '-END-') END AS certificates"
    )
    fields.append(
        "CASE WHEN user_id % 7 = 6 AND event_type = 'signup'"
        " THEN named_struct('destination', 'https://d' || k) END AS stream_key"
    )
    return F.when(F.col("has_params"), F.to_json(F.struct(*[F.expr(f) for f in fields])))


def network_events(spark: SparkSession, sf_dir: str, with_params: bool = True) -> DataFrame:
    """The sample ``events`` table as network events."""
    return as_network_events(load(spark, sf_dir, "events"), with_params)


def as_network_events(clicks: DataFrame, with_params: bool = True) -> DataFrame:
    """Rows of the sample ``events`` table (batch or stream) as network events.

    ``net_error``, ``byte_count`` and ``bytes_copied`` are also there as plain
    columns, as a stored events table has them, so that aggregations which need
    only these never parse the params text.
    """
    # k, day and ticks are computed once below, so the CASE expressions stay cheap
    raw = clicks.select(
        "event_id", "user_id", "event_type", "value", *[F.expr(e).alias(n) for n, e in _SPARK.items()]
    )
    names = {n: n for n in _SPARK}
    cols = {n: e.format(**names) for n, e in {**SAMPLE_EVENT_COLUMNS, **SAMPLE_PARAM_COLUMNS}.items()}
    events = raw.select(
        *[F.expr(e).alias(n) for n, e in cols.items()],
        F.expr(SAMPLE_DEPENDENCY.format(**names)).alias("dep_id"),
        "k",
        "user_id",
        "event_type",
    )
    events = events.withColumn("source_type", F.col("source_type").cast("int"))
    keep = list(SAMPLE_EVENT_COLUMNS) + ["net_error", "byte_count", "bytes_copied"]
    if not with_params:
        return events.select(*keep)
    return events.select(*keep, parsed(_params_json(), "params"))


def enum_rows(events: DataFrame) -> DataFrame:
    """The enum table of the sample captures: ``(capture_id, enum, name, id)``."""
    entries = [
        F.struct(F.lit(enum).alias("enum"), F.lit(name).alias("name"), F.lit(i).alias("id"))
        for enum, names in ENUMS.items()
        for name, i in names.items()
    ]
    return (
        events.select("capture_id")
        .distinct()
        .select("capture_id", F.inline(F.array(*entries)))
    )


def enum_values_sql() -> str:
    """The same enum entries as a VALUES list ``(enum, name, id)``."""
    return ", ".join(f"('{e}', '{n}', {i})" for e, names in ENUMS.items() for n, i in names.items())


def capture_scalars(events: DataFrame) -> DataFrame:
    """Scalars of the sample captures: no tick offset, exported at the last event."""
    return events.groupBy("capture_id").agg(
        F.min_by("time_ms", "event_index").alias("base_time_ms"),
        F.lit(0.0).alias("time_tick_offset"),
        F.max_by("time_ms", "event_index").alias("numeric_date_ms"),
    )
