"""Subsystem state snapshots of captures as flat tables.

Input is ``polled(capture_id, key, value)``; output rows carry ``capture_id`` and the
position of the element. A capture without the snapshot gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import jsvalue as js
from ..functions.jsvalue import field, joined, shown, text_or_blank
from ..functions.proxy import proxy_config_text
from ..functions.text import format_time
from ..session import stored

Read = Callable[[Column | js.Members, str], Column]


def _blob(polled: DataFrame, key: str) -> DataFrame:
    return polled.where(F.col("key") == key).select("capture_id", F.col("value").alias("blob"))


def _object_blob(polled: DataFrame, key: str) -> DataFrame:
    return _blob(polled, key).where(js.is_object(F.col("blob")))


# the element of a list at hand
ITEM = js.Members("item")


def _listed(keys: Iterable[str]) -> str:
    """Type of a list of objects of which these members are wanted; ``key: type`` names a type."""
    return "array<struct<" + ", ".join(k if ":" in k else f"{k}: variant" for k in keys) + ">>"


def _opened(df: DataFrame, listed: Column, *keep: str | Column) -> DataFrame:
    # outer, so that no filter on the list can be inferred, which would make it again
    return df.select("capture_id", *keep, F.posexplode_outer(listed).alias("pos", "item")).where("pos is not null")


def _elements(df: DataFrame, path: str, keys: Iterable[str]) -> DataFrame:
    """One row per element of the list at ``path`` of the blob, with these members of it.

    Everything a VARIANT gives out as VARIANT is built anew, so no list or element is taken whole
    to take members of it.
    """
    return _opened(df, F.try_variant_get("blob", path, _listed(keys)))


def _members(df: DataFrame, value: Column, *keep: str) -> DataFrame:
    """One row per member of an object: ``name``, ``item``."""
    held = df.select("capture_id", *keep, value.alias("held")).where(js.is_map(F.col("held")))
    return held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col("held").outer())).where(
        "key is not null"
    ).select("capture_id", *keep, F.col("key").alias("name"), F.col("value").alias("item"))


def _columns(item: Column | js.Members, spec: dict[str, tuple[Read, str]]) -> list[Column]:
    return [read(item, key).alias(name) for name, (read, key) in spec.items()]


def _table(df: DataFrame, path: str, spec: dict[str, tuple[Read, str]]) -> DataFrame:
    return _elements(df, path, [key for _, key in spec.values()]).select("capture_id", "pos", *_columns(ITEM, spec))


def _properties(df: DataFrame, spec: dict[str, tuple[Read, str]]) -> DataFrame:
    """One row per capture with a column per property."""
    return df.select("capture_id", *_columns(F.col("blob"), spec))


def _wall_text(df: DataFrame, captures: DataFrame, ticks: str, out: str) -> DataFrame:
    """Replace tick numbers by wall time text ("" when there is none)."""
    # no list of all captures' elements is sent to every task, however small it is taken to be
    offsets = captures.select("capture_id", "time_tick_offset").hint("merge")
    text = F.coalesce(format_time(F.col("time_tick_offset") + F.col(ticks)), F.lit(""))
    return df.join(offsets, "capture_id").withColumn(out, text).drop("time_tick_offset", *([ticks] if ticks != out else []))


def _number(value: Column | js.Members, key: str) -> Column:
    return js.as_number(field(value, key))


# --- proxy, DNS -------------------------------------------------------------------


def _proxy_captures(polled: DataFrame) -> DataFrame:
    with_bad = polled.where("key = 'badProxies'").select("capture_id").distinct()
    return _object_blob(polled, "proxySettings").join(with_bad, "capture_id", "left_semi")


def proxy_settings(polled: DataFrame) -> DataFrame:
    """Effective and original proxy settings as text."""
    each = F.array(*[
        F.struct(F.lit(w).alias("which"), field(F.col("blob"), w).alias("config")) for w in ("effective", "original")
    ])
    rows = _proxy_captures(polled).select("capture_id", F.inline(each))
    return rows.select("capture_id", "which", proxy_config_text(F.col("config")).alias("text"))


def bad_proxies(polled: DataFrame, captures: DataFrame) -> DataFrame:
    with_settings = _object_blob(polled, "proxySettings").select("capture_id").distinct()
    blobs = _blob(polled, "badProxies").join(with_settings, "capture_id", "left_semi")
    rows = _elements(blobs, "$", ("proxy_chain_uri", "bad_until")).select(
        "capture_id",
        "pos",
        text_or_blank(ITEM, "proxy_chain_uri").alias("proxy_chain_uri"),
        _number(ITEM, "bad_until").alias("ticks"),
    )
    return _wall_text(rows, captures, "ticks", "bad_until")


def _resolver(polled: DataFrame) -> DataFrame:
    return _object_blob(polled, "hostResolverInfo").where(js.is_object(field(F.col("blob"), "cache")))


def dns_cache_summary(polled: DataFrame) -> DataFrame:
    cache = field(F.col("blob"), "cache")
    return _resolver(polled).select(
        "capture_id", shown(cache, "capacity").alias("capacity"), shown(cache, "network_changes").alias("network_changes")
    )


def dns_config(polled: DataFrame) -> DataFrame:
    """Settings as key and text; ``position`` 0 is for the name servers, which come first."""
    item = F.col("item")
    text = F.when(js.is_array(item), F.array_join(js.element_texts(item), ", ")).otherwise(js.to_text(item))
    return _members(_resolver(polled), field(F.col("blob"), "dns_config")).select(
        "capture_id",
        F.col("name").alias("key"),
        F.coalesce(text, F.lit("")).alias("value"),
        F.when(F.col("name") == "nameservers", 0).otherwise(1).alias("position"),
    )


def host_cache(polled: DataFrame, captures: DataFrame) -> DataFrame:
    item = ITEM
    endpoints = joined(item, "ip_endpoints")
    keys = ("hostname", "address_family", "ip_endpoints", "addresses", "ttl", "expiration", "network_changes")
    rows = _elements(_resolver(polled), "$.cache.entries", keys).select(
        "capture_id",
        "pos",
        text_or_blank(item, "hostname").alias("hostname"),
        shown(item, "address_family").alias("family"),
        F.when(endpoints != "", endpoints).otherwise(joined(item, "addresses")).alias("addresses"),
        shown(item, "ttl").alias("ttl"),
        _number(item, "expiration").alias("ticks"),
        shown(item, "network_changes").alias("network_changes"),
    )
    return _wall_text(rows, captures, "ticks", "expiration")


# --- sockets ----------------------------------------------------------------------


_POOL = ("name", "type", "handed_out_socket_count", "idle_socket_count", "connecting_socket_count", "max_socket_count",
         "max_sockets_per_group", "pool_generation_number", "groups")


def _all_pools(polled: DataFrame) -> DataFrame:
    """Pools with their nested pools, ``path`` giving parent-before-children order.

    Levels are stored one by one, so that the snapshots are made and read once.
    """
    keys = [*_POOL, "nested_pools: array<variant>"]
    level = _opened(_blob(polled, "socketPoolInfo"), F.try_variant_get("blob", "$", _listed(keys)))
    level = stored(level.select("capture_id", F.array("pos").alias("path"), "item"), "pools")
    pools = level
    while True:
        inner = level.where(F.size("item.nested_pools") > 0).select("capture_id", "path", F.posexplode("item.nested_pools").alias("pos", "pool"))
        item = F.try_variant_get("pool", "$", _listed(keys)[len("array<") : -1])
        level = stored(inner.select("capture_id", F.concat("path", F.array("pos")).alias("path"), item.alias("item")), "pools")
        if level.isEmpty():
            return pools
        pools = pools.unionByName(level)


def socket_pools(polled: DataFrame) -> DataFrame:
    item = ITEM
    spec = {
        "handed_out": (shown, "handed_out_socket_count"),
        "idle": (shown, "idle_socket_count"),
        "connecting": (shown, "connecting_socket_count"),
        "max": (shown, "max_socket_count"),
        "max_per_group": (shown, "max_sockets_per_group"),
        "generation": (shown, "pool_generation_number"),
    }
    name = F.concat(text_or_blank(item, "name"), F.lit(" ("), text_or_blank(item, "type"), F.lit(")"))
    return _all_pools(polled).select("capture_id", "path", name.alias("name"), *_columns(item, spec))


def socket_groups(polled: DataFrame) -> DataFrame:
    spec = {
        "pending": (shown, "pending_request_count"),
        "top_priority": (shown, "top_pending_priority"),
        "active": (shown, "active_socket_count"),
        "idle_sockets": (joined, "idle_sockets"),
        "connect_jobs": (joined, "connect_jobs"),
        "backup_timer": (shown, "backup_job_timer_is_running"),
        "stalled": (shown, "is_stalled"),
    }
    pools = _all_pools(polled).withColumn("pool", text_or_blank(ITEM, "name"))
    groups = _members(pools, field(ITEM, "groups"), "path", "pool")
    return groups.select("capture_id", "path", "pool", F.col("name").alias("group"), *_columns(F.col("item"), spec))


def stream_pool(polled: DataFrame) -> DataFrame:
    spec = {
        "connecting": (shown, "connecting_socket_count"),
        "handed_out": (shown, "handed_out_socket_count"),
        "idle": (shown, "idle_socket_count"),
        "max": (shown, "max_socket_count"),
        "max_per_group": (shown, "max_sockets_per_group"),
    }
    return _properties(_object_blob(polled, "httpStreamPoolInfo"), spec)


def stream_pool_groups(polled: DataFrame) -> DataFrame:
    spec = {
        "active": (shown, "active_socket_count"),
        "handed_out": (shown, "handed_out_socket_count"),
        "idle": (shown, "idle_socket_count"),
        "attempt_manager_alive": (shown, "attempt_manager_alive"),
    }
    groups = _members(_object_blob(polled, "httpStreamPoolInfo"), field(F.col("blob"), "groups"))
    attempt = field(F.col("item"), "attempt_state")
    state = F.when(js.is_object(attempt), F.to_json(attempt)).alias("attempt_state")
    return groups.select("capture_id", F.col("name").alias("group"), *_columns(F.col("item"), spec), state)


# --- protocols --------------------------------------------------------------------


def alt_svc(polled: DataFrame) -> DataFrame:
    spec = {"server": (text_or_blank, "server"), "alternative_service": (text_or_blank, "alternative_service")}
    return _table(_blob(polled, "altSvcMappings"), "$", spec)


def _http2_captures(polled: DataFrame, key: str, other: str, object_key: str) -> DataFrame:
    with_other = polled.where(F.col("key") == other)
    if other == object_key:
        with_other = with_other.where(js.is_object(F.col("value")))
    return _blob(polled, key).join(with_other.select("capture_id").distinct(), "capture_id", "left_semi")


def http2_status(polled: DataFrame) -> DataFrame:
    spec = {"enable_http2": (shown, "enable_http2"), "alpn_protos": (text_or_blank, "alpn_protos")}
    status = _http2_captures(polled, "spdyStatus", "spdySessionInfo", "spdyStatus")
    return _properties(status.where(js.is_object(F.col("blob"))), spec)


def http2_sessions(polled: DataFrame) -> DataFrame:
    spec = {
        "host": (text_or_blank, "host_port_pair"),
        "proxy": (text_or_blank, "proxy"),
        "id": (shown, "source_id"),
        "protocol": (text_or_blank, "negotiated_protocol"),
        "active": (shown, "active_streams"),
        "max": (shown, "max_concurrent_streams"),
        "initiated": (shown, "streams_initiated_count"),
        "pushed": (shown, "streams_pushed_count"),
        "abandoned": (shown, "streams_abandoned_count"),
        "frames": (shown, "frames_received"),
        "secure": (shown, "is_secure"),
        "send_window": (shown, "send_window_size"),
        "recv_window": (shown, "recv_window_size"),
        "error": (shown, "error"),
    }
    return _table(_http2_captures(polled, "spdySessionInfo", "spdyStatus", "spdyStatus"), "$", spec)


def quic_status(polled: DataFrame) -> DataFrame:
    spec = {
        "quic_enabled": (shown, "quic_enabled"),
        "supported_versions": (text_or_blank, "supported_versions"),
        "connection_options": (text_or_blank, "connection_options"),
        "max_packet_length": (shown, "max_packet_length"),
        "idle_timeout_s": (shown, "idle_connection_timeout_seconds"),
    }
    return _properties(_object_blob(polled, "quicInfo"), spec)


def quic_sessions(polled: DataFrame) -> DataFrame:
    spec = {
        "aliases": (joined, "aliases"),
        "version": (text_or_blank, "version"),
        "peer_address": (text_or_blank, "peer_address"),
        "connection_id": (text_or_blank, "connection_id"),
        "open": (shown, "open_streams"),
        "active": (joined, "active_streams"),
        "total": (shown, "total_streams"),
        "sent": (shown, "packets_sent"),
        "lost": (shown, "packets_lost"),
        "received": (shown, "packets_received"),
        "connected": (shown, "connected"),
    }
    return _table(_object_blob(polled, "quicInfo"), "$.sessions", spec)


# --- reporting --------------------------------------------------------------------

NETWORK_KEYS = ("network_anonymization_key", "network_isolation_key", "NetworkAnonymizationKey", "networkIsolationKey")


def _network_key(value: Column | js.Members) -> Column:
    return F.coalesce(*[js.to_text(field(value, k)) for k in NETWORK_KEYS], F.lit(""))


def _yes_no(value: Column | js.Members, key: str) -> Column:
    return F.when(js.truthy(field(value, key)), F.lit("yes")).otherwise(F.lit("no"))


def _reporting(polled: DataFrame) -> DataFrame:
    return _object_blob(polled, "reportingInfo").where(js.truthy(field(F.col("blob"), "reportingEnabled")))


def _with_expiry(rows: DataFrame, captures: DataFrame) -> DataFrame:
    """``expires`` as text and ``expired`` against the capture's export date."""
    scalars = captures.select("capture_id", "time_tick_offset", "numeric_date_ms").hint("merge")
    wall = F.col("time_tick_offset") + F.col("ticks")
    return (
        rows.join(scalars, "capture_id")
        .withColumn("expires", F.coalesce(format_time(wall), F.lit("")))
        .withColumn("expired", F.coalesce(wall < F.col("numeric_date_ms"), F.lit(False)))
        .drop("ticks", "time_tick_offset", "numeric_date_ms")
    )


def reporting_reports(polled: DataFrame, captures: DataFrame) -> DataFrame:
    """Queued reports with status text; network errors show their type and status code."""
    item = ITEM
    count = lambda key: F.when(_number(item, key) > 0.0, js.as_int(field(item, key)).cast("string"))
    extra = lambda label, key: F.coalesce(F.concat(F.lit(f", {label}: "), count(key)), F.lit(""))
    status = F.concat(
        text_or_blank(item, "status"), F.lit(" ("), text_or_blank(item, "group"),
        extra("depth", "depth"), extra("attempts", "attempts"), F.lit(")"),
    )
    body = js.Members("item.body")
    code = F.when(_number(body, "status_code") != 0.0, js.as_int(field(body, "status_code")).cast("string"))
    content = F.concat(
        text_or_blank(body, "type"), F.coalesce(F.concat(F.lit(" ("), code, F.lit(")")), F.lit(""))
    )
    members = ("queued", "url", "status", "group", "depth", "attempts", "type", *NETWORK_KEYS)
    rows = _elements(_reporting(polled), "$.reports", [*members, "body: struct<type: variant, status_code: variant>"]).select(
        "capture_id",
        "pos",
        _number(item, "queued").alias("ticks"),
        text_or_blank(item, "url").alias("url"),
        status.alias("status"),
        text_or_blank(item, "type").alias("type"),
        _network_key(item).alias("network_key"),
        F.when(text_or_blank(item, "type") == "network-error", content).otherwise(F.lit("")).alias("content"),
    )
    return _wall_text(rows, captures, "ticks", "queued")


_COUNTS = "struct<uploads: variant, reports: variant>"
_ENDPOINTS = _listed(["url", "priority", "weight", f"successful: {_COUNTS}", f"failed: {_COUNTS}"])
_GROUPS = _listed(["name", "includeSubdomains", "expires", f"endpoints: {_ENDPOINTS}"])


def _endpoints(polled: DataFrame) -> DataFrame:
    """Clients, their groups, their endpoints: one row per endpoint.

    What is shown of a client or group is taken before its list is opened, so that only
    that goes along, and the list itself.
    """
    clients = _elements(_reporting(polled), "$.clients", ["origin", *NETWORK_KEYS, f"groups: {_GROUPS}"]).select(
        "capture_id",
        F.col("pos").alias("client_pos"),
        text_or_blank(ITEM, "origin").alias("origin"),
        _network_key(ITEM).alias("network_key"),
        F.col("item.groups").alias("groups"),
    )
    client = ("client_pos", "origin", "network_key")
    groups = _opened(clients, F.col("groups"), *client).select(
        "capture_id",
        *client,
        F.col("pos").alias("group_pos"),
        text_or_blank(ITEM, "name").alias("group"),
        _yes_no(ITEM, "includeSubdomains").alias("subdomains"),
        _number(ITEM, "expires").alias("ticks"),
        F.col("item.endpoints").alias("endpoints"),
    )
    return _opened(groups, F.col("endpoints"), *client, "group_pos", "group", "subdomains", "ticks")


def _uploads(counts: js.Members) -> Column:
    number = lambda key: F.coalesce(js.as_int(field(counts, key)), F.lit(0))
    text = F.concat(number("uploads").cast("string"), F.lit(" ("), number("reports").cast("string"), F.lit(")"))
    return F.when((number("uploads") == 0) & (number("reports") == 0), F.lit("-")).otherwise(text)


def reporting_endpoints(polled: DataFrame, captures: DataFrame) -> DataFrame:
    item = ITEM
    rows = _endpoints(polled).select(
        "capture_id",
        "client_pos",
        "group_pos",
        "pos",
        *("origin", "network_key", "group", "subdomains", "ticks"),
        text_or_blank(item, "url").alias("url"),
        F.coalesce(js.to_text(field(item, "priority")), F.lit("0")).alias("priority"),
        F.coalesce(js.to_text(field(item, "weight")), F.lit("1")).alias("weight"),
        _uploads(js.Members("item.successful")).alias("uploads_succeeded"),
        _uploads(js.Members("item.failed")).alias("uploads_failed"),
    )
    return _with_expiry(rows, captures)


def client_row_counts(polled: DataFrame) -> DataFrame:
    """Endpoints per reporting client, and of the capture in total."""
    per_client = _endpoints(polled).groupBy("capture_id", "client_pos").agg(F.count("*").alias("endpoints"))
    # a window, not a join, which would open all lists twice; a capture has few clients
    total = F.sum("endpoints").over(Window.partitionBy("capture_id"))
    return per_client.where("capture_id is not null").withColumn("total_endpoints", total)


def nel_policies(polled: DataFrame, captures: DataFrame) -> DataFrame:
    item = ITEM
    share = lambda key: F.format_string("%.2f%%", F.coalesce(_number(item, key), F.lit(0.0)) * 100.0)
    keys = ("origin", "includeSubdomains", "expires", "reportTo", *NETWORK_KEYS, "successFraction", "failureFraction")
    rows = _elements(_reporting(polled), "$.networkErrorLogging.originPolicies", keys).select(
        "capture_id",
        "pos",
        text_or_blank(item, "origin").alias("origin"),
        _yes_no(item, "includeSubdomains").alias("subdomains"),
        _number(item, "expires").alias("ticks"),
        text_or_blank(item, "reportTo").alias("report_to"),
        _network_key(item).alias("network_key"),
        share("successFraction").alias("success"),
        share("failureFraction").alias("failure"),
    )
    return _with_expiry(rows, captures)


# --- cache, modules, prerender ------------------------------------------------------

# fixed values: names of Winsock codes
SOCKET_TYPE_NAMES = {"1": "SOCK_STREAM", "2": "SOCK_DGRAM", "3": "SOCK_RAW", "4": "SOCK_RDM", "5": "SOCK_SEQPACKET"}
PROTOCOL_NAMES = {"1": "IPPROTO_ICMP", "6": "IPPROTO_TCP", "17": "IPPROTO_UDP", "58": "IPPROTO_ICMPV6"}
NAMESPACE_NAMES = {
    "12": "NS_DNS",
    "15": "NS_NLA",
    "16": "NS_BTH",
    "32": "NS_NTDS",
    "37": "NS_EMAIL",
    "38": "NS_PNRPNAME",
    "39": "NS_PNRPCLOUD",
}


def _coded(value: Column | js.Members, key: str, names: dict[str, str]) -> Column:
    raw = shown(value, key)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, raw), raw)


def http_cache_stats(polled: DataFrame) -> DataFrame:
    stats = _members(_object_blob(polled, "httpCacheInfo"), field(F.col("blob"), "stats"))
    return stats.select(
        "capture_id", F.col("name").alias("key"), F.coalesce(js.to_text(F.col("item")), F.lit("")).alias("value")
    )


def extensions(polled: DataFrame) -> DataFrame:
    spec = {
        "id": (text_or_blank, "id"),
        "app": (shown, "packagedApp"),
        "enabled": (shown, "enabled"),
        "name": (text_or_blank, "name"),
        "version": (text_or_blank, "version"),
        "description": (text_or_blank, "description"),
    }
    return _table(_blob(polled, "extensionInfo"), "$", spec)


def service_providers(polled: DataFrame) -> DataFrame:
    """Layered (``kind`` Layer, Base, Chain) and namespace providers in one table."""
    item = ITEM
    info = _object_blob(polled, "serviceProviders")
    chain = F.coalesce(js.as_int(field(item, "chain_length")), F.lit(0))
    kind = F.when(chain == 0, F.lit("Layer")).when(chain == 1, F.lit("Base")).otherwise(F.lit("Chain"))
    common = ["capture_id", "pos", text_or_blank(item, "name").alias("name"), shown(item, "version").alias("version")]
    # both lists are opened together, so that the snapshot is made and read once
    listed = _listed(("name", "version", "chain_length", "socket_type", "socket_protocol", "type", "active"))
    each = F.array(*[
        F.struct(F.lit(n).alias("provider"), F.try_variant_get("blob", f"$.{n}_providers", listed).alias("items"))
        for n in ("service", "namespace")
    ])
    rows = _opened(info.select("capture_id", F.inline(each)), F.col("items"), "provider")
    layer = F.col("provider") == "service"
    return rows.select(
        "provider",
        *common,
        F.when(layer, kind).otherwise(_coded(item, "type", NAMESPACE_NAMES)).alias("kind"),
        F.when(layer, _coded(item, "socket_type", SOCKET_TYPE_NAMES)).alias("socket_type"),
        F.when(layer, _coded(item, "socket_protocol", PROTOCOL_NAMES)).alias("protocol"),
        F.when(~layer, shown(item, "active")).alias("active"),
    )


def prerender_status(polled: DataFrame) -> DataFrame:
    spec = {
        "enabled": (shown, "enabled"),
        "enabled_note": (text_or_blank, "enabled_note"),
        "omnibox_enabled": (shown, "omnibox_enabled"),
    }
    return _properties(_object_blob(polled, "prerenderInfo"), spec)


def prerender_active(polled: DataFrame) -> DataFrame:
    spec = {"url": (text_or_blank, "url"), "duration": (text_or_blank, "duration"), "loaded": (shown, "is_loaded")}
    return _table(_object_blob(polled, "prerenderInfo"), "$.active", spec)


def prerender_history(polled: DataFrame) -> DataFrame:
    moment = lambda value, key: F.coalesce(format_time(js.to_number(field(value, key))), F.lit(""))
    spec = {
        "origin": (text_or_blank, "origin"),
        "url": (text_or_blank, "url"),
        "final_status": (text_or_blank, "final_status"),
        "end_time": (moment, "end_time"),
    }
    return _table(_object_blob(polled, "prerenderInfo"), "$.history", spec)
