"""State tables. The snapshots are built from ``lineitem``: one capture per order, one
list element per line, so that the expected rows follow from the table directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsvalue as js
from ..operators import polled as p
from .base import query

OFFSET = 1700000000000.0
EXPORT = OFFSET + 25_000.0

LI = """WITH li AS (SELECT CAST(l_orderkey AS VARCHAR) AS capture_id, CAST(row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS pos, CAST(l_quantity AS BIGINT) AS qty,
    * FROM lineitem),
  ords AS (SELECT capture_id, count(*) AS n, min(l_partkey) AS part FROM li GROUP BY 1)"""
_WHEN = "strftime(make_timestamp(CAST(({ms}) * 1000 AS BIGINT)), '%Y-%m-%d %H:%M:%S.%g')"


def _wall(ticks: str) -> str:
    return _WHEN.format(ms=f"1700000000000 + {ticks}")


def _lines(spark, sf_dir, fields: dict[str, str]):
    """Orders with ``items``: the JSON list of one object per line (an order has few lines)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("qty", F.expr("cast(l_quantity as bigint)"))
    obj = F.struct(*[F.expr(e).alias(n) for n, e in fields.items()]).alias("o")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", obj)
    return li.groupBy(F.col("l_orderkey").cast("string").alias("capture_id")).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["o"])).alias("items"),
        F.count("*").alias("n"),
        F.min("l_partkey").alias("part"),
    )


def _polled(orders, **blobs: str):
    """``polled`` rows; each blob is SQL for its JSON text over ``items``, ``n``, ``part``."""
    each = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(t).alias("json")) for k, t in blobs.items()])
    return orders.select("capture_id", F.inline(each)).select("capture_id", "key", js.parsed(F.col("json"), "value"))


def _captures(orders):
    return orders.select(
        "capture_id", F.lit(OFFSET).alias("time_tick_offset"), F.lit(EXPORT).alias("numeric_date_ms")
    )


BAD = {"proxy_chain_uri": "'p' || l_partkey", "bad_until": "qty * 1000"}


@query(
    "proxy_settings",
    f"""{LI} SELECT capture_id, unnest(['effective', 'original']) AS which,
    unnest(['Proxy server: p' || part || ':1', 'Use DIRECT connections.']) AS text FROM ords""",
)
def proxy_settings(spark, sf_dir):
    orders = _lines(spark, sf_dir, BAD)
    settings = """'{"effective":{"single_proxy":"p' || part || ':1"},"original":{}}'"""
    return p.proxy_settings(_polled(orders, proxySettings=settings, badProxies="items"))


@query(
    "bad_proxies",
    f"{LI} SELECT capture_id, pos, 'p' || l_partkey AS proxy_chain_uri, {_wall('qty * 1000')} AS bad_until FROM li",
)
def bad_proxies(spark, sf_dir):
    orders = _lines(spark, sf_dir, BAD)
    return p.bad_proxies(_polled(orders, proxySettings="'{}'", badProxies="items"), _captures(orders))


HOSTS = {
    "hostname": "'h' || l_partkey",
    "address_family": "l_linenumber",
    "ip_endpoints": "case when qty % 2 = 0 then array('e' || l_suppkey, 'x') end",
    "addresses": "array('a' || l_suppkey)",
    "ttl": "l_discount",
    "expiration": "qty * 1000",
    "network_changes": "qty",
}
RESOLVER = (
    """'{"cache":{"capacity":' || n || ',"network_changes":"c' || part || '","entries":' || items || """
    """'},"dns_config":{"nameservers":["8.8.8.8","n' || part || '"],"search":["a","b"],"ndots":' || n || ',"rotate":true}}'"""
)


@query(
    "dns_cache_summary",
    f"{LI} SELECT capture_id, CAST(n AS VARCHAR) AS capacity, 'c' || part AS network_changes FROM ords",
)
def dns_cache_summary(spark, sf_dir):
    return p.dns_cache_summary(_polled(_lines(spark, sf_dir, HOSTS), hostResolverInfo=RESOLVER))


@query(
    "dns_config",
    f"""{LI} SELECT capture_id, unnest(['nameservers', 'search', 'ndots', 'rotate']) AS key,
    unnest(['8.8.8.8, n' || part, 'a, b', CAST(n AS VARCHAR), 'true']) AS value, unnest([0, 1, 1, 1]) AS position FROM ords""",
)
def dns_config(spark, sf_dir):
    return p.dns_config(_polled(_lines(spark, sf_dir, HOSTS), hostResolverInfo=RESOLVER))


@query(
    "host_cache",
    f"""{LI} SELECT capture_id, pos, 'h' || l_partkey AS hostname, CAST(l_linenumber AS VARCHAR) AS family,
    CASE WHEN qty % 2 = 0 THEN 'e' || l_suppkey || ', x' ELSE 'a' || l_suppkey END AS addresses,
    CASE WHEN l_discount = 0 THEN '0' ELSE CAST(l_discount AS VARCHAR) END AS ttl, {_wall('qty * 1000')} AS expiration,
    CAST(qty AS VARCHAR) AS network_changes FROM li""",
)
def host_cache(spark, sf_dir):
    orders = _lines(spark, sf_dir, HOSTS)
    return p.host_cache(_polled(orders, hostResolverInfo=RESOLVER), _captures(orders))


POOLS = {
    "name": "'pool' || l_partkey",
    "type": "l_returnflag",
    "handed_out_socket_count": "qty",
    "idle_socket_count": "l_linenumber",
    "max_socket_count": "256",
    "nested_pools": "case when qty % 3 = 0 then array(named_struct('name', 'inner' || l_partkey, 'type', 'n',"
    " 'nested_pools', array(named_struct('name', 'deep', 'type', 'd')))) end",
    "groups": "case when qty % 2 = 0 then named_struct('g1', named_struct('pending_request_count', qty, 'idle_sockets',"
    " array(1, 2), 'is_stalled', true), 'g2', named_struct('active_socket_count', l_linenumber)) end",
}


@query(
    "socket_pools",
    f"""{LI} SELECT capture_id, CAST(pos AS VARCHAR) AS path, 'pool' || l_partkey || ' (' || l_returnflag || ')' AS name,
      CAST(qty AS VARCHAR) AS handed_out, CAST(l_linenumber AS VARCHAR) AS idle, '' AS connecting, '256' AS max,
      '' AS max_per_group, '' AS generation FROM li
    UNION ALL SELECT capture_id, pos || '.0', 'inner' || l_partkey || ' (n)', '', '', '', '', '', '' FROM li WHERE qty % 3 = 0
    UNION ALL SELECT capture_id, pos || '.0.0', 'deep (d)', '', '', '', '', '', '' FROM li WHERE qty % 3 = 0""",
)
def socket_pools(spark, sf_dir):
    pools = p.socket_pools(_polled(_lines(spark, sf_dir, POOLS), socketPoolInfo="items"))
    return pools.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "."))


@query(
    "socket_groups",
    f"""{LI} SELECT capture_id, CAST(pos AS VARCHAR) AS path, 'pool' || l_partkey AS pool, 'g1' AS "group",
      CAST(qty AS VARCHAR) AS pending, '' AS top_priority, '' AS active, '1, 2' AS idle_sockets, '' AS connect_jobs,
      '' AS backup_timer, 'true' AS stalled FROM li WHERE qty % 2 = 0
    UNION ALL SELECT capture_id, CAST(pos AS VARCHAR), 'pool' || l_partkey, 'g2', '', '', CAST(l_linenumber AS VARCHAR), '', '', '', ''
      FROM li WHERE qty % 2 = 0""",
)
def socket_groups(spark, sf_dir):
    groups = p.socket_groups(_polled(_lines(spark, sf_dir, POOLS), socketPoolInfo="items"))
    return groups.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "."))


STREAMS = (
    """'{"idle_socket_count":' || n || ',"max_socket_count":256,"groups":{"g' || part || '":{"active_socket_count":' || n"""
    """ || ',"attempt_manager_alive":true,"attempt_state":{"a":' || n || '}},"h":{"idle_socket_count":2}}}'"""
)


@query(
    "stream_pool",
    f"""{LI} SELECT capture_id, '' AS connecting, '' AS handed_out, CAST(n AS VARCHAR) AS idle, '256' AS max,
    '' AS max_per_group FROM ords""",
)
def stream_pool(spark, sf_dir):
    return p.stream_pool(_polled(_lines(spark, sf_dir, BAD), httpStreamPoolInfo=STREAMS))


@query(
    "stream_pool_groups",
    f"""{LI} SELECT capture_id, 'g' || part AS "group", CAST(n AS VARCHAR) AS active, '' AS handed_out, '' AS idle,
      'true' AS attempt_manager_alive, '{{"a":' || n || '}}' AS attempt_state FROM ords
    UNION ALL SELECT capture_id, 'h', '', '', '2', '', NULL FROM ords""",
)
def stream_pool_groups(spark, sf_dir):
    return p.stream_pool_groups(_polled(_lines(spark, sf_dir, BAD), httpStreamPoolInfo=STREAMS))


@query(
    "alt_svc",
    f"{LI} SELECT capture_id, pos, 's' || l_suppkey AS server, 'quic :' || qty AS alternative_service FROM li",
)
def alt_svc(spark, sf_dir):
    orders = _lines(spark, sf_dir, {"server": "'s' || l_suppkey", "alternative_service": "'quic :' || qty"})
    return p.alt_svc(_polled(orders, altSvcMappings="items"))


SPDY = {
    "host_port_pair": "'h' || l_partkey",
    "proxy": "'direct://'",
    "source_id": "l_suppkey",
    "negotiated_protocol": "'h2'",
    "active_streams": "l_linenumber",
    "frames_received": "qty",
    "is_secure": "qty % 2 = 0",
    "error": "-qty",
}


@query("http2_status", f"{LI} SELECT capture_id, 'true' AS enable_http2, 'h2,p' || part AS alpn_protos FROM ords")
def http2_status(spark, sf_dir):
    status = """'{"enable_http2":true,"alpn_protos":"h2,p' || part || '"}'"""
    return p.http2_status(_polled(_lines(spark, sf_dir, SPDY), spdyStatus=status, spdySessionInfo="items"))


@query(
    "http2_sessions",
    f"""{LI} SELECT capture_id, pos, 'h' || l_partkey AS host, 'direct://' AS proxy, CAST(l_suppkey AS VARCHAR) AS id,
    'h2' AS protocol, CAST(l_linenumber AS VARCHAR) AS active, '' AS max, '' AS initiated, '' AS pushed, '' AS abandoned,
    CAST(qty AS VARCHAR) AS frames, CASE WHEN qty % 2 = 0 THEN 'true' ELSE 'false' END AS secure, '' AS send_window,
    '' AS recv_window, CAST(-qty AS VARCHAR) AS error FROM li""",
)
def http2_sessions(spark, sf_dir):
    return p.http2_sessions(_polled(_lines(spark, sf_dir, SPDY), spdyStatus="'{}'", spdySessionInfo="items"))


QUIC = {
    "aliases": "array('a' || l_partkey, 'b')",
    "version": "'v' || l_linenumber",
    "peer_address": "'1.1.1.' || l_suppkey",
    "connection_id": "'c'",
    "open_streams": "qty",
    "active_streams": "array(l_linenumber, 7)",
    "packets_sent": "l_partkey",
    "connected": "true",
}


@query(
    "quic_status",
    f"""{LI} SELECT capture_id, 'true' AS quic_enabled, 'v1' AS supported_versions, '' AS connection_options,
    CAST(part AS VARCHAR) AS max_packet_length, '' AS idle_timeout_s FROM ords""",
)
def quic_status(spark, sf_dir):
    info = """'{"quic_enabled":true,"supported_versions":"v1","connection_options":5,"max_packet_length":' || part || '}'"""
    return p.quic_status(_polled(_lines(spark, sf_dir, QUIC), quicInfo=info))


@query(
    "quic_sessions",
    f"""{LI} SELECT capture_id, pos, 'a' || l_partkey || ', b' AS aliases, 'v' || l_linenumber AS version,
    '1.1.1.' || l_suppkey AS peer_address, 'c' AS connection_id, CAST(qty AS VARCHAR) AS open, l_linenumber || ', 7' AS active,
    '' AS total, CAST(l_partkey AS VARCHAR) AS sent, '' AS lost, '' AS received, 'true' AS connected FROM li""",
)
def quic_sessions(spark, sf_dir):
    return p.quic_sessions(_polled(_lines(spark, sf_dir, QUIC), quicInfo="""'{"sessions":' || items || '}'"""))


def _reporting(name):
    return f"""'{{"reportingEnabled":true,"{name}":' || items || '}}'"""


@query(
    "reporting_reports",
    f"""{LI} SELECT capture_id, pos, {_wall('qty * 1000')} AS queued, 'u' || l_partkey AS url,
    'queued (g' || l_suppkey || CASE WHEN l_linenumber > 1 THEN ', depth: ' || l_linenumber ELSE '' END
      || CASE WHEN qty % 2 = 1 THEN ', attempts: ' || qty ELSE '' END || ')' AS status,
    CASE WHEN qty % 2 = 0 THEN 'network-error' ELSE 'csp' END AS type, 'nak' || qty AS network_key,
    CASE WHEN qty % 2 = 0 THEN 'tcp.reset' || CASE WHEN l_linenumber > 1 THEN ' (' || l_linenumber || ')' ELSE '' END
      ELSE '' END AS content FROM li""",
)
def reporting_reports(spark, sf_dir):
    level = "case when l_linenumber > 1 then l_linenumber else 0 end"
    orders = _lines(spark, sf_dir, {
        "queued": "qty * 1000", "url": "'u' || l_partkey", "status": "'queued'", "group": "'g' || l_suppkey",
        "depth": level, "attempts": "case when qty % 2 = 1 then qty end",
        "type": "case when qty % 2 = 0 then 'network-error' else 'csp' end", "networkIsolationKey": "'nak' || qty",
        "body": f"named_struct('type', 'tcp.reset', 'status_code', {level})",
    })
    return p.reporting_reports(_polled(orders, reportingInfo=_reporting("reports")), _captures(orders))


CLIENTS = {
    "origin": "'https://o' || l_partkey",
    "network_anonymization_key": "'k' || l_suppkey",
    "groups": "array(named_struct('name', 'g', 'includeSubdomains', qty % 2 = 0, 'expires', qty * 1000, 'endpoints',"
    " array(named_struct('url', 'u' || l_suppkey, 'priority', l_linenumber, 'successful', named_struct('uploads', qty,"
    " 'reports', 2)), named_struct('url', 'v', 'priority', cast(null as int), 'successful', null))))",
}


@query(
    "reporting_endpoints",
    f"""{LI}, e AS (SELECT capture_id, pos AS client_pos, 0 AS group_pos, unnest([0, 1]) AS pos, 'https://o' || l_partkey AS origin,
      'k' || l_suppkey AS network_key, 'g' AS "group", CASE WHEN qty % 2 = 0 THEN 'yes' ELSE 'no' END AS subdomains,
      unnest(['u' || l_suppkey, 'v']) AS url, unnest([CAST(l_linenumber AS VARCHAR), '0']) AS priority, '1' AS weight,
      unnest([qty || ' (2)', '-']) AS uploads_succeeded, '-' AS uploads_failed, {_wall('qty * 1000')} AS expires,
      qty * 1000 < 25000 AS expired FROM li) SELECT * FROM e""",
)
def reporting_endpoints(spark, sf_dir):
    orders = _lines(spark, sf_dir, CLIENTS)
    return p.reporting_endpoints(_polled(orders, reportingInfo=_reporting("clients")), _captures(orders))


@query(
    "client_row_counts",
    f"{LI} SELECT capture_id, pos AS client_pos, 2 AS endpoints, 2 * n AS total_endpoints FROM li JOIN ords USING (capture_id)",
)
def client_row_counts(spark, sf_dir):
    return p.client_row_counts(_polled(_lines(spark, sf_dir, CLIENTS), reportingInfo=_reporting("clients")))


@query(
    "nel_policies",
    f"""{LI} SELECT capture_id, pos, 'o' || l_partkey AS origin, CASE WHEN qty % 2 = 0 THEN 'yes' ELSE 'no' END AS subdomains,
    {_wall('qty * 1000')} AS expires, qty * 1000 < 25000 AS expired, 'r' || l_suppkey AS report_to, '' AS network_key,
    qty || '.00%' AS success, '0.00%' AS failure FROM li""",
)
def nel_policies(spark, sf_dir):
    orders = _lines(spark, sf_dir, {
        "origin": "'o' || l_partkey", "includeSubdomains": "qty % 2 = 0", "expires": "qty * 1000",
        "reportTo": "'r' || l_suppkey", "successFraction": "qty / 100.0D",
    })
    info = """'{"reportingEnabled":true,"networkErrorLogging":{"originPolicies":' || items || '}}'"""
    return p.nel_policies(_polled(orders, reportingInfo=info), _captures(orders))


@query(
    "http_cache_stats",
    f"{LI} SELECT capture_id, unnest(['entries', 'name']) AS key, unnest([CAST(n AS VARCHAR), 'p' || part]) AS value FROM ords",
)
def http_cache_stats(spark, sf_dir):
    info = """'{"stats":{"entries":' || n || ',"name":"p' || part || '"}}'"""
    return p.http_cache_stats(_polled(_lines(spark, sf_dir, BAD), httpCacheInfo=info))


@query(
    "extensions",
    f"""{LI} SELECT capture_id, pos, 'x' || l_partkey AS id, 'false' AS app, CASE WHEN qty % 2 = 0 THEN 'true' ELSE 'false' END AS enabled,
    'n' || l_suppkey AS name, '1.' || l_linenumber AS version, '' AS description FROM li""",
)
def extensions(spark, sf_dir):
    orders = _lines(spark, sf_dir, {
        "id": "'x' || l_partkey", "packagedApp": "false", "enabled": "qty % 2 = 0", "name": "'n' || l_suppkey",
        "version": "'1.' || l_linenumber",
    })
    return p.extensions(_polled(orders, extensionInfo="items"))


@query(
    "service_providers",
    f"""{LI} SELECT 'service' AS provider, capture_id, pos, 'n' || l_partkey AS name, CAST(qty AS VARCHAR) AS version,
      CASE l_linenumber WHEN 1 THEN 'Base' ELSE 'Chain' END AS kind,
      CASE qty % 4 WHEN 1 THEN 'SOCK_STREAM' WHEN 2 THEN 'SOCK_DGRAM' WHEN 3 THEN 'SOCK_RAW' ELSE '0' END AS socket_type,
      'IPPROTO_TCP' AS protocol, NULL AS active FROM li
    UNION ALL SELECT 'namespace', capture_id, pos, 'n' || l_partkey, CAST(qty AS VARCHAR), 'NS_DNS', NULL, NULL, '' FROM li""",
)
def service_providers(spark, sf_dir):
    orders = _lines(spark, sf_dir, {
        "name": "'n' || l_partkey", "version": "qty", "chain_length": "l_linenumber", "socket_type": "qty % 4",
        "socket_protocol": "6", "type": "12",
    })
    info = """'{"service_providers":' || items || ',"namespace_providers":' || items || '}'"""
    return p.service_providers(_polled(orders, serviceProviders=info))


PRERENDER = {
    "url": "'u' || l_partkey",
    "duration": "qty || ' s'",
    "is_loaded": "qty % 2 = 0",
    "origin": "'link'",
    "final_status": "'Used'",
    "end_time": "cast(1700000000000 + qty as string)",
}
PRERENDER_INFO = (
    """'{"enabled":true,"enabled_note":"n' || part || '","omnibox_enabled":0,"active":' || items || ',"history":' || items || '}'"""
)


@query(
    "prerender_status",
    f"{LI} SELECT capture_id, 'true' AS enabled, 'n' || part AS enabled_note, '0' AS omnibox_enabled FROM ords",
)
def prerender_status(spark, sf_dir):
    return p.prerender_status(_polled(_lines(spark, sf_dir, PRERENDER), prerenderInfo=PRERENDER_INFO))


@query(
    "prerender_active",
    f"""{LI} SELECT capture_id, pos, 'u' || l_partkey AS url, qty || ' s' AS duration,
    CASE WHEN qty % 2 = 0 THEN 'true' ELSE 'false' END AS loaded FROM li""",
)
def prerender_active(spark, sf_dir):
    return p.prerender_active(_polled(_lines(spark, sf_dir, PRERENDER), prerenderInfo=PRERENDER_INFO))


@query(
    "prerender_history",
    f"{LI} SELECT capture_id, pos, 'link' AS origin, 'u' || l_partkey AS url, 'Used' AS final_status, {_wall('qty')} AS end_time FROM li",
)
def prerender_history(spark, sf_dir):
    return p.prerender_history(_polled(_lines(spark, sf_dir, PRERENDER), prerenderInfo=PRERENDER_INFO))
