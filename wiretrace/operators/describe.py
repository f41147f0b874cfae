"""Source descriptions, including those taken over from other sources.

A description is fixed when a source's start event changes, from the start event's
params or from the description another source has *at that moment*. So the work is
on *versions*: one row per source and change of start event.

1. The text a start event gives by itself, or the source it copies from.
2. An as-of lookup finds the version of that other source in force at the time.
   It is a scan over the union of lookups and versions, so a source that very many
   others depend on costs no more than its rows.
3. Copy chains are shortened by pointer doubling until every row has its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import jsvalue as js
from ..session import cut_lineage
from .grouping import SOURCE_KEY
from .scan import BUCKET_ROWS, previous_value

# --- fixed values: source types by the params member their description shows ---
URL_TYPES = ("URL_REQUEST", "DOH_URL_REQUEST", "HTTP_STREAM_JOB", "HTTP_STREAM_JOB_CONTROLLER", "BIDIRECTIONAL_STREAM")
GROUP_TYPES = (
    "TRANSPORT_CONNECT_JOB",
    "SSL_CONNECT_JOB",
    "SOCKS_CONNECT_JOB",
    "HTTP_PROXY_CONNECT_JOB",
    "WEB_SOCKET_TRANSPORT_CONNECT_JOB",
)
HOST_TYPES = (
    "HOST_RESOLVER_IMPL_JOB",
    "HOST_RESOLVER_IMPL_PROC_TASK",
    "CERT_VERIFIER_JOB",
    "CERT_VERIFIER_TASK",
    "QUIC_SESSION",
    "QUIC_SESSION_POOL_JOB",
)
CACHE_TYPES = ("DISK_CACHE_ENTRY", "MEMORY_CACHE_ENTRY")
HOSTNAME_TYPES = ("ASYNC_HOST_RESOLVER_REQUEST", "DNS_TRANSACTION", "DNS_OVER_HTTPS")
DESTINATION_TYPES = ("HTTP_STREAM_POOL_GROUP", "HTTP_STREAM_POOL_JOB")
# types that show the description of the source they depend on
COPYING_TYPES = ("SOCKET", "PROXY_CLIENT_SOCKET", "HTTP_STREAM_POOL_QUIC_TASK", "HTTP_STREAM_POOL_ATTEMPT_MANAGER")
# a second event of one of these types is the start event
SECOND_EVENT_STARTS = ("UDP_CONNECT", "IPV6_PROBE_RUNNING", "SOCKET_POOL_CONNECT_JOB_CREATED", "CERT_VERIFY_PROC")
DOWNLOAD_NAME_FIELDS = {
    "DOWNLOAD_FILE_RENAMED": "new_filename",
    "DOWNLOAD_FILE_OPENED": "file_name",
    "DOWNLOAD_ITEM_ACTIVE": "file_name",
}
MOVING_TYPES = ("FILESTREAM", "DOWNLOAD")


def _param(name: str) -> Column:
    return js.text_or_blank(F.col("params"), name)


def _destination() -> Column:
    return js.text_or_blank(js.field(F.col("params"), "stream_key"), "destination")


def _own_text() -> Column:
    """The text an event gives as a start event, without other sources."""
    kind, name = F.col("source_type_name"), F.col("type_name")
    host = js.as_string(js.field(F.col("params"), "host"))
    proxy = F.coalesce(js.to_text(js.field(F.col("params"), "proxy")), F.lit("undefined"))
    by_kind = [
        (URL_TYPES, _param("url")),
        (GROUP_TYPES, F.coalesce(js.as_string(js.field(F.col("params"), "group_id")), _param("group_name"))),
        (("TCP_STREAM_ATTEMPT",), _param("ip_endpoint")),
        (("TLS_STREAM_ATTEMPT",), _param("host_port")),
        ((*DESTINATION_TYPES, "HTTP_STREAM_POOL_ATTEMPT_MANAGER"), _destination()),
        (HOST_TYPES, _param("host")),
        (CACHE_TYPES, _param("key")),
        (("HTTP2_SESSION",), F.concat(host, F.lit(" ("), proxy, F.lit(")"))),
        (("HTTP_PIPELINED_CONNECTION",), _param("host_and_port")),
        (("UDP_SOCKET",), js.to_text(js.field(F.col("params"), "address"))),
        (HOSTNAME_TYPES, _param("hostname")),
        (("WEB_TRANSPORT_CLIENT",), _param("url")),
    ]
    text = F.when(kind == "NONE", name).when(F.col("params").isNull(), F.lit(""))
    for kinds, column in by_kind:
        text = text.when(kind.isin(*kinds), column)
    for event_type, field in DOWNLOAD_NAME_FIELDS.items():
        text = text.when((kind == "DOWNLOAD") & (name == event_type), _param(field))
    return F.coalesce(text, F.lit(""))


def _facts(events: DataFrame) -> DataFrame:
    """Per event, the few strings and ids a description can need."""
    dependency = js.field(F.col("params"), "source_dependency")
    parent = F.when(js.is_object(dependency), js.as_int(js.field(dependency, "id")))
    return events.select(
        *SOURCE_KEY,
        F.col("event_index").alias("eval_index"),
        "type_name",
        "source_type_name",
        (F.col("phase_name") == "PHASE_END").alias("ends"),
        _own_text().alias("text"),
        parent.alias("parent_id"),
        js.field(F.col("params"), "address").isNotNull().alias("has_address"),
    )


def _versions(events: DataFrame) -> DataFrame:
    """One row per source and change of start event."""
    facts = _facts(events)
    order = Window.partitionBy(*SOURCE_KEY).orderBy("eval_index")
    # two passes over the events, each reduced and written before it is used again:
    # two rows per source (cut on the map side), and the few rows that can move a start
    heads = cut_lineage(facts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= 2))
    candidates = cut_lineage(facts.where(F.col("type_name").isin("FILE_STREAM_OPEN", *DOWNLOAD_NAME_FIELDS)))
    of_source = Window.partitionBy(*SOURCE_KEY)
    first = F.when(F.col("rn") == 1, F.struct("type_name", "source_type_name", "parent_id"))
    heads = heads.withColumn("first", F.first(first, ignorenulls=True).over(of_source)).where(
        (F.col("rn") == 1) | F.col("type_name").isin(*SECOND_EVENT_STARTS)
    )

    # downloads and file streams pick later events as well
    origin = heads.where((F.col("rn") == 1) & F.col("source_type_name").isin(*MOVING_TYPES)).select(
        *SOURCE_KEY, "first"
    )
    name, kind, index = F.col("type_name"), F.col("first.source_type_name"), F.col("eval_index")
    stage = (
        F.when((kind == "FILESTREAM") & (name == "FILE_STREAM_OPEN"), F.lit(3))
        .when(kind == "FILESTREAM", F.lit(None))
        .when((name == "DOWNLOAD_FILE_RENAMED") & ~F.col("ends"), F.lit(3))
        .when(name == "DOWNLOAD_FILE_OPENED", F.lit(2))
        .when(name == "DOWNLOAD_ITEM_ACTIVE", F.lit(1))
    )
    moves = (
        candidates.join(origin, list(SOURCE_KEY))
        .withColumn("stage", stage)
        .where(F.col("stage").isNotNull())
    )
    firsts = moves.groupBy(*SOURCE_KEY).agg(
        *[F.min(F.when(F.col("stage") == s, index)).alias(f"at{s}") for s in (1, 2, 3)]
    )
    never = F.lit((1 << 62) - 1)
    at = {s: F.coalesce(F.col(f"at{s}"), never) for s in (1, 2, 3)}
    takes_over = (
        F.when(F.col("stage") == 3, (kind == "DOWNLOAD") | (index == at[3]))
        .when(F.col("stage") == 2, (index == at[2]) & (index < at[3]))
        .otherwise((index == at[1]) & (index < at[2]) & (index < at[3]))
    )
    moves = moves.join(firsts, list(SOURCE_KEY)).where(takes_over)

    # a default start event counts until the first move; at a move itself the move counts
    heads = heads.join(firsts, list(SOURCE_KEY), "left").where(index < F.least(at[1], at[2], at[3]))
    columns = [*SOURCE_KEY, "eval_index", "type_name", "source_type_name", "text", "parent_id", "has_address", "first"]
    return cut_lineage(heads.select(*columns).unionByName(moves.select(*columns)))


def _with_parents(versions: DataFrame, bucket_rows: int) -> DataFrame:
    """Add ``use`` (copy / wrap / own) and the parent version in force at the time."""
    copies = F.col("source_type_name").isin(*COPYING_TYPES) & F.col("parent_id").isNotNull()
    wraps = (
        (F.col("source_type_name") == "UDP_SOCKET")
        & F.col("has_address")
        & (F.col("first.type_name") == "SOCKET_ALIVE")
        & F.col("first.parent_id").isNotNull()
    )
    versions = versions.select(
        *SOURCE_KEY,
        "eval_index",
        "text",
        F.col("first.source_type_name").alias("source_kind"),
        F.when(copies, F.lit("copy")).when(wraps, F.lit("wrap")).otherwise(F.lit("own")).alias("use"),
        F.when(copies, F.col("parent_id")).when(wraps, F.col("first.parent_id")).alias("wanted"),
    )
    # strictly earlier versions only: at one index, lookups sort before versions
    lookups = versions.where("wanted is not null").select(
        "capture_id",
        F.col("wanted").alias("on_source"),
        (F.col("eval_index") * 2).alias("moment"),
        F.lit(None).cast("struct<at:bigint,kind:string>").alias("version"),
        F.col("source_id").alias("asking"),
    )
    offers = versions.select(
        "capture_id",
        F.col("source_id").alias("on_source"),
        (F.col("eval_index") * 2 + 1).alias("moment"),
        F.struct(F.col("eval_index").alias("at"), F.col("source_kind").alias("kind")).alias("version"),
        F.lit(None).cast("bigint").alias("asking"),
    )
    found = (
        previous_value(
            lookups.unionByName(offers), ["capture_id", "on_source"], "moment", F.col("version"), "found", bucket_rows
        )
        .where("asking is not null and found is not null")
        .select(
            "capture_id",
            F.col("asking").alias("source_id"),
            F.floor(F.col("moment") / 2).alias("eval_index"),
            F.col("on_source").alias("to_source"),
            F.col("found.at").alias("to_index"),
            F.col("found.kind").alias("to_kind"),
        )
    )
    joined = versions.join(found, [*SOURCE_KEY, "eval_index"], "left")
    # a UDP socket shows only resolver jobs; a copy of nothing is blank
    lost = F.col("to_source").isNull() | ((F.col("use") == "wrap") & (F.col("to_kind") != "HOST_RESOLVER_IMPL_JOB"))
    use = F.when(lost, F.lit("own")).otherwise(F.col("use"))
    return joined.select(
        *SOURCE_KEY,
        "eval_index",
        use.alias("use"),
        F.when((F.col("use") == "copy"), F.lit("")).otherwise(F.col("text")).alias("text"),
        F.when(use != "own", F.col("to_source")).alias("to_source"),
        F.when(use != "own", F.col("to_index")).alias("to_index"),
    )


def _resolve(versions: DataFrame) -> DataFrame:
    """Fill in the text of copying and wrapping versions.

    Each round looks one pointer ahead: a pointer to a finished version takes its
    text, a copy of a copy moves on to what that one points at, so chains halve.
    Rounds are written to the checkpoint folder; the table has a row or two per
    source.
    """
    versions = cut_lineage(versions)
    while not versions.where("use <> 'own'").isEmpty():
        target = versions.select(
            "capture_id",
            F.col("source_id").alias("to_source"),
            F.col("eval_index").alias("to_index"),
            F.col("use").alias("t_use"),
            F.col("text").alias("t_text"),
            F.col("to_source").alias("t_source"),
            F.col("to_index").alias("t_index"),
        )
        done = versions.where("use = 'own'")
        ahead = versions.where("use <> 'own'").join(target, ["capture_id", "to_source", "to_index"], "left")
        ready = F.col("t_use") == "own"
        skips = F.col("t_use") == "copy"
        wrapped = F.when(F.length("t_text") > 0, F.concat("text", F.lit(" ["), "t_text", F.lit("]"))).otherwise(
            F.col("text")
        )
        ahead = ahead.select(
            *SOURCE_KEY,
            "eval_index",
            F.when(ready, F.lit("own")).otherwise(F.col("use")).alias("use"),
            F.when(ready & (F.col("use") == "copy"), F.col("t_text"))
            .when(ready, wrapped)
            .otherwise(F.col("text"))
            .alias("text"),
            F.when(skips, F.col("t_source")).otherwise(F.col("to_source")).alias("to_source"),
            F.when(skips, F.col("t_index")).otherwise(F.col("to_index")).alias("to_index"),
        )
        versions = cut_lineage(done.unionByName(ahead))
    return versions


def describe_sources(events: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(capture_id, source_id, description)`` for every source."""
    versions = _resolve(_with_parents(_versions(events), bucket_rows))
    return versions.groupBy(*SOURCE_KEY).agg(F.max_by("text", "eval_index").alias("description"))


def source_start_event(events: DataFrame) -> DataFrame:
    """The event each source counts as started by, once all its events are known."""
    versions = _versions(events)
    return versions.groupBy(*SOURCE_KEY).agg(
        F.max("eval_index").alias("start_event_index"), F.max_by("type_name", "eval_index").alias("start_type_name")
    )


def with_descriptions(sources: DataFrame, events: DataFrame) -> DataFrame:
    """Sources with their ``description``."""
    return sources.join(describe_sources(events), list(SOURCE_KEY), "left").withColumn(
        "description", F.coalesce("description", F.lit(""))
    )
