"""Event params: long form, symbolic names, flags, text lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsvalue as js
from ..functions.proxy import proxy_config_text
from ..functions.text import hex_bytes, searchable_bytes
from .dictionary import NAMES, first_name, flags, last_name, with_names

# --- fixed values: which enum a param's number belongs to ---
NAMED_PARAMS = {
    "net_error": "netError",
    "quic_error": "quicError",
    "quic_rst_stream_error": "quicRstStreamError",
    "load_state": "loadState",
    "digest_policy": "certPathBuilderDigestPolicy",
}
FLAG_PARAMS = {
    "load_flags": "loadFlag",
    "cert_status": "certStatusFlag",
    "verifier_flags": "certVerifierFlags",
    "verify_flags": "certVerifyFlags",
}
CERTIFICATE_EVENTS = ("CERT_VERIFIER_JOB", "SSL_CERTIFICATES_RECEIVED")
# params that are decoded only on events of these types
ONLY_ON = {
    "digest_policy": ("CERT_VERIFY_PROC_PATH_BUILD_ATTEMPT",),
    "cert_status": (*CERTIFICATE_EVENTS, "CERT_VERIFY_PROC"),
    "verifier_flags": CERTIFICATE_EVENTS,
    "verify_flags": ("CERT_VERIFY_PROC",),
}
REQUEST_HEADER_EVENTS = (
    "HTTP_TRANSACTION_SEND_REQUEST_HEADERS",
    "HTTP_TRANSACTION_SEND_TUNNEL_HEADERS",
    "HTTP_CACHE_CALLER_REQUEST_HEADERS",
)
CHECKED_CERTIFICATE_EVENTS = ("CERT_CT_COMPLIANCE_CHECKED", "EV_CERT_CT_COMPLIANCE_CHECKED")
PATH_BUILT_EVENT = "CERT_VERIFY_PROC_PATH_BUILT"
PROXY_CHANGE_EVENT = "PROXY_CONFIG_CHANGED"

EVENT_KEY = ["capture_id", "source_id", "event_index"]


def params_long(events: DataFrame) -> DataFrame:
    """One row per event and param: ``key``, ``value`` (VARIANT)."""
    rows = events.where("params is not null").select(*EVENT_KEY, "type_name", "params")
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("params").outer())).select(
        *EVENT_KEY, "type_name", F.coalesce("key", F.col("pos").cast("string")).alias("key"), "value"
    )


def _lookup(key: str, table: dict[str, str]) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.col(key))


def _applies() -> Column:
    """Whether this param is decoded on this event type."""
    limits = [(F.col("key") != key) | F.col("type_name").isin(*types) for key, types in ONLY_ON.items()]
    return reduce(lambda a, b: a & b, limits)


def decode_params(long: DataFrame, enums: DataFrame) -> DataFrame:
    """Symbolic names of error and state codes, "?" where the capture knows none."""
    coded = (
        long.withColumn("enum", _lookup("key", NAMED_PARAMS))
        .where(F.col("enum").isNotNull() & _applies())
        .withColumn("code", js.as_int(F.col("value")))
        .where("code is not null")
        .select(*EVENT_KEY, "key", "enum", "code")
    )
    named = with_names(coded, enums, list(NAMED_PARAMS.values()))
    name = F.coalesce(first_name(F.col("enum"), F.col("code")), F.lit("?"))
    return named.select(*EVENT_KEY, "key", "code", name.alias("name"))


def _flag_text(enum: Column, bits: Column) -> Column:
    """The names of the bits set, from the names the row has with it."""
    set_bits = F.transform(F.filter(flags(enum), lambda flag: bits.bitwiseAND(flag["id"]) != 0), lambda flag: flag["name"])
    whole = F.when(enum == "loadFlag", F.coalesce(first_name(enum, bits), F.lit("?"))).otherwise(F.lit(""))
    return F.when(F.size(set_bits) > 0, F.array_join(set_bits, " | ")).otherwise(whole)


def decode_flags(long: DataFrame, enums: DataFrame) -> DataFrame:
    """Names of the set bits, " | " between; without any, the value's own name or "?"
    for load flags and "" for the others."""
    coded = (
        long.withColumn("enum", _lookup("key", FLAG_PARAMS))
        .where(F.col("enum").isNotNull() & _applies())
        .withColumn("bits", js.as_int(F.col("value")))
        .where("bits is not null")
        .select(*EVENT_KEY, "key", "enum", "bits")
    )
    named = with_names(coded, enums, list(FLAG_PARAMS.values()))
    return named.select(*EVENT_KEY, "key", "bits", _flag_text(F.col("enum"), F.col("bits")).alias("names"))


# --- text lines -------------------------------------------------------------------


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def header_lines(value: Column) -> Column:
    """A headers array as lines; a headers object as "key: value" lines."""
    pairs = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    by_key = F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), js.to_text(e["value"])))
    return F.when(js.is_array(value), js.element_texts(value)).when(js.is_map(value), by_key)


def certificate_text(holder: Column) -> Column:
    """PEM lines of all ``certificates`` of an object."""
    return F.flatten(F.transform(js.element_texts(js.field(holder, "certificates")), _lines))


def certificate_lines(events: DataFrame) -> DataFrame:
    """Certificates, OCSP response, SCT list and path errors as numbered lines."""
    p, name = F.col("params"), F.col("type_name")
    on_certs = name.isin(*CERTIFICATE_EVENTS)
    text = lambda key: _lines(js.as_string(js.field(p, key)))
    blocks = {
        "certificates": F.when(on_certs, certificate_text(p)),
        "verified_cert": F.when(on_certs, certificate_text(js.field(p, "verified_cert"))),
        "ocsp_response": F.when(on_certs, text("ocsp_response")),
        "sct_list": F.when(on_certs, text("sct_list")),
        "errors": F.when(name == PATH_BUILT_EVENT, text("errors")),
        "certificate": F.when(
            name.isin(*CHECKED_CERTIFICATE_EVENTS), certificate_text(js.field(p, "certificate"))
        ),
    }
    wanted = (*CERTIFICATE_EVENTS, PATH_BUILT_EVENT, *CHECKED_CERTIFICATE_EVENTS)
    parts = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("lines")) for k, v in blocks.items()])
    return (
        events.where(name.isin(*wanted) & p.isNotNull())
        .select(*EVENT_KEY, F.inline(parts))
        .where("lines is not null")
        .select(*EVENT_KEY, "key", F.posexplode("lines").alias("line_no", "line"))
    )


def request_header_lines(events: DataFrame, event_types: tuple[str, ...] = REQUEST_HEADER_EVENTS) -> DataFrame:
    """Request line without line break, then the headers, as numbered lines."""
    line, headers = js.field(F.col("params"), "line"), js.field(F.col("params"), "headers")
    first = F.array(F.replace(js.as_string(line), F.lit("\r\n"), F.lit("")))
    rows = events.where(F.col("type_name").isin(*event_types) & js.is_string(line) & js.is_array(headers))
    return rows.select(*EVENT_KEY, F.posexplode(F.concat(first, js.element_texts(headers))).alias("line_no", "line"))


def bytes_param(events: DataFrame) -> DataFrame:
    """Base64 ``bytes`` params as searchable text and hex; JSON text when not base64."""
    raw = js.as_string(js.field(F.col("params"), "bytes"))
    return (
        events.select(*EVENT_KEY, raw.alias("raw"))
        .where("raw is not null")
        .select(
            *EVENT_KEY,
            F.coalesce(searchable_bytes(F.col("raw")), F.to_json(F.struct("raw"))).alias("searchable"),
            hex_bytes(F.col("raw")).alias("hex"),
        )
    )


def proxy_config_changes(events: DataFrame) -> DataFrame:
    """Old and new proxy settings as text, for events that change them."""
    old, new = js.field(F.col("params"), "old_config"), js.field(F.col("params"), "new_config")
    return events.where((F.col("type_name") == PROXY_CHANGE_EVENT) & js.is_object(new)).select(
        *EVENT_KEY,
        F.when(js.is_object(old), proxy_config_text(old)).alias("old_config"),
        proxy_config_text(new).alias("new_config"),
    )


def param_lines(events: DataFrame, enums: DataFrame) -> DataFrame:
    """All params of all events as text lines: ``key``, ``line_no``, ``line``.

    Values print as the symbolic forms above where one applies, else as JSON. Keys
    come in sorted order.
    """
    long = params_long(events)
    key, value = F.col("key"), F.col("value")
    depends = (key == "source_dependency") & js.is_object(value)
    number = lambda name: F.coalesce(js.as_int(js.field(value, name)), F.lit(0))
    rows = (
        long.withColumn("enum", F.when(_applies(), _lookup("key", NAMED_PARAMS)))
        .withColumn("flag_enum", F.when(_applies(), _lookup("key", FLAG_PARAMS)))
        .withColumn("code", F.when(F.coalesce("enum", "flag_enum").isNotNull(), js.as_int(value)))
        .withColumn("dep_id", F.when(depends, number("id")))
        .withColumn("dep_type", F.when(depends, number("type")))
    )
    wanted = [*NAMED_PARAMS.values(), *FLAG_PARAMS.values(), "logSourceType"]
    value_name = F.coalesce(first_name(F.col("enum"), F.col("code")), F.lit("?"))
    label = F.when(F.col("enum").isNotNull(), value_name).otherwise(_flag_text(F.col("flag_enum"), F.col("code")))
    rows = (
        with_names(rows, enums, wanted)
        .withColumn("label", F.when(F.col("code").isNotNull(), label))
        .withColumn("dep_name", F.when(depends, last_name(F.lit("logSourceType"), F.col("dep_type"))))
        .drop(NAMES)
    )
    text = js.as_string(value)
    name = F.col("type_name")
    on_certs = name.isin(*CERTIFICATE_EVENTS)
    equals = lambda shown: F.array(F.concat(key, F.lit(" = "), shown))
    bracket = lambda code, label: equals(F.concat(code.cast("string"), F.lit(" ("), label, F.lit(")")))
    split_text = (on_certs & key.isin("ocsp_response", "sct_list")) | ((name == PATH_BUILT_EVENT) & (key == "errors"))
    lines = (
        F.when(F.col("code").isNotNull(), bracket(F.col("code"), F.col("label")))
        .when(depends, bracket(F.col("dep_id"), F.coalesce("dep_name", F.lit(""))))
        .when(key == "headers", F.coalesce(header_lines(value), equals(F.to_json(value))))
        .when(on_certs & (key == "certificates"), F.coalesce(F.flatten(F.transform(js.element_texts(value), _lines)), equals(F.to_json(value))))
        .when(
            (on_certs & (key == "verified_cert")) | (name.isin(*CHECKED_CERTIFICATE_EVENTS) & (key == "certificate")),
            F.coalesce(certificate_text(value), equals(F.to_json(value))),
        )
        .when(split_text & text.isNotNull(), _lines(text))
        .when((key == "quic_crypto_handshake_message") & text.isNotNull(), _lines(text))
        .when(
            (key == "line") & name.isin(*REQUEST_HEADER_EVENTS) & text.isNotNull(),
            F.array(F.replace(text, F.lit("\r\n"), F.lit(""))),
        )
        .when(key == "bytes", F.coalesce(F.array(searchable_bytes(text)), equals(F.to_json(value))))
        .otherwise(equals(F.to_json(value)))
    )
    # a NULL inside the array means the special form did not apply after all
    lines = F.when(F.exists(lines, lambda x: x.isNull()), equals(F.to_json(value))).otherwise(lines)
    # the text of proxy settings needs Python: only such params go there
    settings = F.coalesce((name == PROXY_CHANGE_EVENT) & key.isin("old_config", "new_config") & js.is_object(value), F.lit(False))
    plain = rows.where(~settings).select(*EVENT_KEY, "key", F.posexplode(lines).alias("line_no", "line"))
    proxies = long.where(settings).select(*EVENT_KEY, "key", F.posexplode(_lines(proxy_config_text(value))).alias("line_no", "line"))
    return plain.unionByName(proxies)
