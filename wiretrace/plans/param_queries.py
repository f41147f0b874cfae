"""Params, flags, headers, proxy text, HTTP exchanges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsvalue as js
from ..functions.proxy import proxy_config_text
from ..operators import exchanges as x
from ..operators import params as p
from ..sources import sample_tables as st
from .base import EV, enum_cte, events, query

_REQUEST = "has_params AND user_id % 7 = 0 AND event_type = 'view' AND k % 2 = 0"
_RESPONSE = "has_params AND user_id % 7 = 0 AND event_type = 'click' AND k % 2 = 1"
_CERTS = "has_params AND user_id % 7 = 1 AND event_type = 'error' AND k % 4 = 0"
_KEY = "capture_id, source_id, event_index"

_NUMBERS = ("net_error", "byte_count", "bytes_copied", "load_flags", "load_state", "cert_status", "quic_error")
_TEXTS = ("url", "method", "line", "host", "address", "key", "file_name", "new_filename", "ocsp_response")
_LONG = " UNION ALL ".join(
    [f"SELECT {_KEY}, '{c}' AS key, CAST(CAST({c} AS BIGINT) AS VARCHAR) AS shown FROM ev WHERE {c} IS NOT NULL" for c in _NUMBERS]
    + [f"SELECT {_KEY}, '{c}' AS key, {c} AS shown FROM ev WHERE {c} IS NOT NULL" for c in _TEXTS]
    + [
        f"SELECT {_KEY}, 'headers', 'Host: h' || k || '.example,Accept: */*' FROM ev WHERE {_REQUEST}",
        f"SELECT {_KEY}, 'headers', 'HTTP/1.1 ' || (200 + k) || ' OK,Content-Length: ' || k FROM ev WHERE {_RESPONSE}",
        f"SELECT {_KEY}, 'headers', 'X-Note: ' || k FROM ev WHERE has_params AND user_id % 7 = 0 AND event_type = 'click' AND k % 2 = 0",
        f"SELECT {_KEY}, 'certificates', '-BEGIN-' || chr(10) || 'c' || k || ',-END-' FROM ev WHERE {_CERTS}",
        f"SELECT {_KEY}, 'stream_key', '[object Object]' FROM ev WHERE has_params AND user_id % 7 = 6 AND event_type = 'signup'",
        f"SELECT {_KEY}, 'source_dependency', '[object Object]' FROM ev WHERE dep_id IS NOT NULL",
    ]
)


def _with_params(spark, sf_dir):
    return events(spark, sf_dir, with_params=True)


@query("params_long", f"{EV} {_LONG}")
def params_long(spark, sf_dir):
    long = p.params_long(_with_params(spark, sf_dir))
    return long.select("capture_id", "source_id", "event_index", "key", js.to_text(F.col("value")).alias("shown"))


_CODED = " UNION ALL ".join(
    f"SELECT {_KEY}, '{c}' AS key, '{p.NAMED_PARAMS[c]}' AS enum, CAST({c} AS BIGINT) AS code FROM ev WHERE {c} IS NOT NULL"
    for c in ("net_error", "quic_error", "load_state")
)


@query(
    "decode_params",
    f"""{EV}, {enum_cte()}, coded AS ({_CODED})
    SELECT {_KEY}, key, code, coalesce((SELECT min(name) FROM enum_rows e WHERE e.enum = coded.enum AND e.id = code), '?') AS name
    FROM coded""",
)
def decode_params(spark, sf_dir):
    ev = _with_params(spark, sf_dir)
    return p.decode_params(p.params_long(ev), st.enum_rows(ev))


@query(
    "decode_flags",
    f"""{EV}, {enum_cte()}, coded AS (
      SELECT {_KEY}, 'load_flags' AS key, 'loadFlag' AS enum, load_flags AS bits FROM ev WHERE load_flags IS NOT NULL
      UNION ALL SELECT {_KEY}, 'cert_status', 'certStatusFlag', cert_status FROM ev WHERE cert_status IS NOT NULL)
    SELECT {_KEY}, key, bits, coalesce(
      (SELECT string_agg(name, ' | ' ORDER BY name) FROM enum_rows e WHERE e.enum = coded.enum AND (e.id & bits) <> 0),
      CASE WHEN key = 'load_flags' THEN coalesce(
        (SELECT min(name) FROM enum_rows e WHERE e.enum = coded.enum AND e.id = bits), '?') ELSE '' END) AS names
    FROM coded""",
)
def decode_flags(spark, sf_dir):
    ev = _with_params(spark, sf_dir)
    return p.decode_flags(p.params_long(ev), st.enum_rows(ev))


@query(
    "decode_value",
    f"""{EV}, {enum_cte()} SELECT capture_id, event_index, CAST(-k AS BIGINT) AS code,
    coalesce((SELECT min(name) FROM enum_rows WHERE enum = 'netError' AND id = -k), '?') AS name FROM ev""",
)
def decode_value(spark, sf_dir):
    from ..operators.decode import decode_value as decode

    ev = events(spark, sf_dir)
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.date_format("ts", "yyyy-MM-dd").alias("capture_id"),
        F.col("event_id").alias("event_index"),
        (-F.get_json_object("props", "$.k").cast("bigint")).alias("code"),
    )
    return decode(raw, st.enum_rows(ev), "netError", "code", "name")


@query(
    "request_header_lines",
    f"""{EV}, r AS (SELECT {_KEY}, unnest(['POST /p' || k || ' HTTP/1.1', 'Host: h' || k || '.example', 'Accept: */*']) AS line,
      unnest([0, 1, 2]) AS line_no FROM ev WHERE {_REQUEST}) SELECT * FROM r""",
)
def request_header_lines(spark, sf_dir):
    return p.request_header_lines(_with_params(spark, sf_dir), ("URL_REQUEST_START_JOB",))


@query(
    "certificate_lines",
    f"""{EV}, r AS (SELECT {_KEY}, 'certificates' AS key, unnest(['-BEGIN-', 'c' || k, '-END-']) AS line,
      unnest([0, 1, 2]) AS line_no FROM ev WHERE {_CERTS}
      UNION ALL SELECT {_KEY}, 'ocsp_response', unnest(['ocsp ' || k, 'end']), unnest([0, 1]) FROM ev
      WHERE ocsp_response IS NOT NULL) SELECT * FROM r""",
)
def certificate_lines(spark, sf_dir):
    return p.certificate_lines(_with_params(spark, sf_dir))


_QUOTED = "CASE WHEN key = 'line' THEN replace(shown, chr(13) || chr(10), '\\r\\n') ELSE shown END"
_FLAGS = f"""SELECT {_KEY}, 'load_flags' AS key, 'loadFlag' AS enum, load_flags AS bits FROM ev WHERE load_flags IS NOT NULL
      UNION ALL SELECT {_KEY}, 'cert_status', 'certStatusFlag', cert_status FROM ev WHERE cert_status IS NOT NULL"""
_FLAG_NAMES = """coalesce(
      (SELECT string_agg(name, ' | ' ORDER BY name) FROM enum_rows e WHERE e.enum = flagged.enum AND (e.id & bits) <> 0),
      CASE WHEN key = 'load_flags' THEN coalesce(
        (SELECT min(name) FROM enum_rows e WHERE e.enum = flagged.enum AND e.id = bits), '?') ELSE '' END)"""
# what a reader sees below each event
PARAM_LINES = f"""{enum_cte()}, long AS ({_LONG}), coded AS ({_CODED}), flagged AS ({_FLAGS}), lined AS (
      SELECT {_KEY}, key, key || ' = "' || {_QUOTED} || '"' AS line, 0 AS line_no FROM long
        WHERE key IN ('url', 'method', 'line', 'host', 'address', 'key', 'file_name', 'new_filename')
      UNION ALL SELECT {_KEY}, key, key || ' = ' || shown, 0 FROM long WHERE key IN ('byte_count', 'bytes_copied')
      UNION ALL SELECT {_KEY}, key, key || ' = ' || bits || ' (' || {_FLAG_NAMES} || ')', 0 FROM flagged
      UNION ALL SELECT {_KEY}, key, key || ' = ' || code || ' (' ||
        coalesce((SELECT min(name) FROM enum_rows e WHERE e.enum = coded.enum AND e.id = code), '?') || ')', 0 FROM coded
      UNION ALL SELECT {_KEY}, 'source_dependency', 'source_dependency = ' || dep_id || ' (' ||
        CASE dep_id % 7 WHEN 1 THEN 'SOCKET' WHEN 2 THEN 'HOST_RESOLVER_IMPL_JOB' ELSE 'HTTP_STREAM_POOL_ATTEMPT_MANAGER' END || ')', 0
        FROM ev WHERE dep_id IS NOT NULL
      UNION ALL SELECT {_KEY}, 'headers', unnest(['Host: h' || k || '.example', 'Accept: */*']), unnest([0, 1]) FROM ev WHERE {_REQUEST}
      UNION ALL SELECT {_KEY}, 'headers', unnest(['HTTP/1.1 ' || (200 + k) || ' OK', 'Content-Length: ' || k]), unnest([0, 1]) FROM ev WHERE {_RESPONSE}
      UNION ALL SELECT {_KEY}, 'headers', 'X-Note: ' || k, 0 FROM ev WHERE has_params AND user_id % 7 = 0 AND event_type = 'click' AND k % 2 = 0
      UNION ALL SELECT {_KEY}, 'certificates', unnest(['-BEGIN-', 'c' || k, '-END-']), unnest([0, 1, 2]) FROM ev WHERE {_CERTS}
      UNION ALL SELECT {_KEY}, 'ocsp_response', unnest(['ocsp ' || k, 'end']), unnest([0, 1]) FROM ev WHERE ocsp_response IS NOT NULL
      UNION ALL SELECT {_KEY}, 'stream_key', 'stream_key = {{"destination":"https://d' || k || '"}}', 0 FROM ev
        WHERE has_params AND user_id % 7 = 6 AND event_type = 'signup')"""


@query("param_lines", f"{EV}, {PARAM_LINES} SELECT * FROM lined")
def param_lines(spark, sf_dir):
    ev = _with_params(spark, sf_dir)
    return p.param_lines(ev, st.enum_rows(ev))


@query(
    "bytes_param",
    """WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS capture_id, turn AS source_id, turn AS event_index, hex(encode(text)) AS h
      FROM conversations)
    SELECT capture_id, source_id, event_index, rtrim(regexp_replace(h, '(..)', '\\1 ', 'g')) AS hex,
      ' ' || array_to_string(list_transform(regexp_extract_all(h, '..'), lambda b: CASE
        WHEN b = '00' THEN ' ' WHEN b BETWEEN '20' AND '7E' THEN CAST(unhex(b) AS VARCHAR) ELSE '.' END), '') AS searchable
    FROM t""",
)
def bytes_param(spark, sf_dir):
    text = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ev = text.select(
        F.col("conv_id").cast("string").alias("capture_id"),
        F.col("turn").alias("source_id"),
        F.col("turn").alias("event_index"),
        F.try_parse_json(F.to_json(F.struct(F.base64(F.encode("text", "UTF-8")).alias("bytes")))).alias("params"),
    )
    return p.bytes_param(ev)


# proxy settings invented from customers: every mode and their combinations
_PROXY = {
    "auto_detect": "CASE WHEN c_custkey % 3 = 0 THEN true END",
    "pac_url": "CASE WHEN c_custkey % 5 = 0 THEN 'http://pac/' || c_nationkey END",
    "single_proxy": "CASE WHEN c_custkey % 4 = 1 THEN 'p' || c_nationkey || ':8080' END",
    "source": "CASE WHEN c_custkey % 2 = 0 THEN 'SYSTEM' WHEN c_custkey % 7 = 0 THEN 'UNKNOWN' END",
}
_PROXY_EXTRA = [
    "CASE WHEN c_custkey % 4 = 2 THEN named_struct('http', array('a' || c_nationkey, 'b'), 'https', array('s:1'),"
    " 'fallback', CASE WHEN c_custkey % 8 = 2 THEN array('f1') END) END AS proxy_per_scheme",
    "CASE WHEN c_custkey % 4 IN (1, 2) AND c_custkey % 3 = 1 THEN array('*.local', 'h' || c_nationkey) END AS bypass_list",
    "CASE WHEN c_custkey % 9 = 1 THEN true END AS reverse_bypass",
]
PROXY_TEXT = """proxy AS (SELECT *, array_to_string(list_filter([
    CASE WHEN c_custkey % 3 = 0 THEN 'Auto-detect' END,
    CASE WHEN c_custkey % 5 = 0 THEN 'PAC script: http://pac/' || c_nationkey END,
    CASE WHEN c_custkey % 4 = 1 THEN 'Proxy server: p' || c_nationkey || ':8080'
      WHEN c_custkey % 4 = 2 THEN 'Proxy server for HTTP: [a' || c_nationkey || ', b]' || chr(10) || 'Proxy server for HTTPS: s:1'
        || CASE WHEN c_custkey % 8 = 2 THEN chr(10) || 'Proxy server for everything else: f1' ELSE '' END END
      || CASE WHEN c_custkey % 3 = 1 THEN chr(10) || CASE WHEN c_custkey % 9 = 1 THEN 'Reversed bypass list: ' ELSE 'Bypass list: ' END
        || chr(10) || '  *.local' || chr(10) || '  h' || c_nationkey ELSE '' END
  ], lambda m: m IS NOT NULL), chr(1)) AS modes FROM customer),
proxy_text AS (SELECT c_custkey, CASE WHEN modes = '' THEN 'Use DIRECT connections.'
    WHEN NOT contains(modes, chr(1)) THEN modes
    ELSE array_to_string(list_transform(string_split(modes, chr(1)), lambda m, i: '(' || i || ') ' || replace(m, chr(10), chr(10) || '    ')), chr(10)) END
  || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'Source: SYSTEM' ELSE '' END AS text FROM proxy)"""


def proxy_json():
    fields = [f"{e} AS {n}" for n, e in _PROXY.items()] + _PROXY_EXTRA
    return F.to_json(F.struct(*[F.expr(f) for f in fields]))


@query("proxy_config_text", f"WITH {PROXY_TEXT} SELECT c_custkey, text FROM proxy_text")
def proxy_text(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    config = customers.select("c_custkey", js.parsed(proxy_json(), "config"))
    return config.select("c_custkey", proxy_config_text(F.col("config")).alias("text"))


@query(
    "proxy_config_changes",
    f"""WITH {PROXY_TEXT} SELECT CAST(c_custkey AS VARCHAR) AS capture_id, c_custkey AS source_id, c_custkey AS event_index,
    CASE WHEN c_custkey % 6 <> 0 THEN 'Auto-detect' END AS old_config, text AS new_config FROM proxy_text""",
)
def proxy_config_changes(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    old = F.when(F.col("c_custkey") % 6 != 0, F.lit('"old_config":{"auto_detect":true},')).otherwise(F.lit(""))
    ev = customers.select(
        F.col("c_custkey").cast("string").alias("capture_id"),
        F.col("c_custkey").alias("source_id"),
        F.col("c_custkey").alias("event_index"),
        F.lit("PROXY_CONFIG_CHANGED").alias("type_name"),
        js.parsed(F.concat(F.lit("{"), old, F.lit('"new_config":'), proxy_json(), F.lit("}")), "params"),
    )
    return p.proxy_config_changes(ev)


_EXCHANGES = f"""{EV}, ex AS (SELECT capture_id, source_id,
    coalesce(arg_min(method, event_index) FILTER (WHERE method IS NOT NULL),
      CASE WHEN count(*) FILTER (WHERE {_REQUEST}) > 0 THEN 'POST' END, '') AS method,
    arg_min(url, event_index) FILTER (WHERE url IS NOT NULL) AS url,
    arg_min('POST /p' || k || ' HTTP/1.1', event_index) FILTER (WHERE {_REQUEST}) AS request_line,
    coalesce(arg_min('Host: h' || k || '.example|Accept: */*', event_index) FILTER (WHERE {_REQUEST}), '') AS request_headers,
    arg_min('HTTP/1.1 ' || (200 + k) || ' OK', event_index) FILTER (WHERE {_RESPONSE}) AS status_line,
    coalesce(arg_min('Content-Length: ' || k, event_index) FILTER (WHERE {_RESPONSE}), '') AS response_headers,
    arg_min(time_ticks, event_index) FILTER (WHERE {_REQUEST}) AS request_ticks,
    arg_min(time_ticks, event_index) FILTER (WHERE {_RESPONSE}) AS response_ticks
  FROM ev GROUP BY 1, 2)"""


@query("http_exchanges", f"{_EXCHANGES} SELECT * FROM ex WHERE url IS NOT NULL")
def http_exchanges(spark, sf_dir):
    found = x.http_exchanges(_with_params(spark, sf_dir))
    flat = {c: F.array_join(c, "|") for c in ("request_headers", "response_headers")}
    return found.withColumns(flat)


@query(
    "time_to_headers",
    f"""{_EXCHANGES} SELECT capture_id, source_id, round(response_ticks - request_ticks, 3) AS time_to_headers
    FROM ex WHERE url IS NOT NULL AND response_ticks IS NOT NULL AND request_ticks IS NOT NULL""",
)
def time_to_headers(spark, sf_dir):
    waits = x.time_to_headers(x.http_exchanges(_with_params(spark, sf_dir)))
    return waits.withColumn("time_to_headers", F.round("time_to_headers", 3))
