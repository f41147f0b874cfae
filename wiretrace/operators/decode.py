"""Constants, enums and raw event elements of captures decoded into typed tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsvalue as js
from ..functions.text import format_time
from .dictionary import NAMES, first_name, last_name, with_names
from .scan import BUCKET_ROWS, first_rows, row_rank

SUPPORTED_FORMAT = 1
# fixed values: enum members of a capture's constants
ENUM_NAMES = (
    "logEventTypes",
    "logEventPhase",
    "logSourceType",
    "netError",
    "loadFlag",
    "loadState",
    "certStatusFlag",
    "certVerifierFlags",
    "certVerifyFlags",
    "quicError",
    "quicRstStreamError",
    "certPathBuilderDigestPolicy",
)
REQUIRED_OBJECTS = (
    "logEventTypes",
    "clientInfo",
    "logEventPhase",
    "logSourceType",
    "loadFlag",
    "netError",
    "addressFamily",
)
# the only event types whose params the time series read
BYTE_EVENT_TYPES = (
    "SOCKET_BYTES_RECEIVED",
    "UDP_BYTES_RECEIVED",
    "SOCKET_BYTES_SENT",
    "UDP_BYTES_SENT",
    "ENTRY_READ_DATA",
    "ENTRY_WRITE_DATA",
)

# fixed values: message texts
BAD_CONSTANTS = "Load failed:\n\nInvalid constants object.\n"
NO_CONSTANTS = "Unable to parse log dump as JSON file."
TRUNCATED = "Log file truncated.  Events may be missing.\n"
NO_DATE = "Can't guess export date as there are no events.\n"


# --- constants --------------------------------------------------------------------


# Columns that a stream's batches need again and again are made once for a context, as each is
# made by dozens of calls to the JVM.


@lru_cache(maxsize=1)
def _constants_error(_: SparkContext) -> Column:
    c = F.col("constants")
    offset = js.field(c, "timeTickOffset")
    # a leading whole number is enough for a string offset to count as one
    offset_ok = js.is_number(offset) | F.coalesce(js.as_string(offset).rlike(r"^\s*[+-]?[0-9]"), F.lit(False))
    fine = js.is_object(c) & offset_ok & js.is_number(js.field(c, "logFormatVersion"))
    for name in REQUIRED_OBJECTS:
        fine = fine & js.is_object(js.field(c, name))
    version = js.as_int(js.field(c, "logFormatVersion"))
    wrong = F.concat(
        F.lit("Unable to load different log version. Found "),
        version.cast("string"),
        F.lit(f", Expected {SUPPORTED_FORMAT}"),
    )
    return (
        F.when(c.isNull(), F.lit(NO_CONSTANTS))
        .when(~fine, F.lit(BAD_CONSTANTS))
        .when(version != SUPPORTED_FORMAT, wrong)
    )


def validate_constants(heads: DataFrame) -> DataFrame:
    """Add ``status`` and ``error`` to captures with a ``constants`` VARIANT. A bad
    capture becomes an error row; it never fails the job."""
    error = _constants_error(heads.sparkSession.sparkContext)
    return heads.withColumn("error", error).withColumn(
        "status", F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("error"))
    )


def decode_enums(heads: DataFrame, key: str = "capture_id") -> DataFrame:
    """Name to id entries of all enums; entries that are no numbers are dropped."""
    blocks = F.array(*[
        F.struct(F.lit(n).alias("enum"), js.field(F.col("constants"), n).alias("entries")) for n in ENUM_NAMES
    ])
    maps = heads.select(key, F.inline(blocks)).where(js.is_map(F.col("entries")))
    exploded = maps.lateralJoin(maps.sparkSession.tvf.variant_explode(F.col("entries").outer()))
    return (
        exploded.select(key, "enum", F.col("key").alias("name"), js.as_int(F.col("value")).cast("int").alias("id"))
        .where("id is not null and name is not null")
    )


def enum_names(enums: DataFrame) -> DataFrame:
    """Id to name; of several names the last in sorted order stands."""
    return enums.groupBy("capture_id", "enum", "id").agg(F.max("name").alias("name"))


def decode_value(df: DataFrame, enums: DataFrame, enum: str, code: str, out: str) -> DataFrame:
    """Add the first name of a value, "?" when the capture has none."""
    name = F.coalesce(first_name(F.lit(enum), F.col(code)), F.lit("?"))
    return with_names(df, enums, [enum]).withColumn(out, name).drop(NAMES)


def resolve_names(events: DataFrame, enums: DataFrame) -> DataFrame:
    """Add ``type_name``, ``source_type_name`` and ``phase_name``; "" when unknown."""
    columns = {
        "type_name": ("logEventTypes", "type"),
        "source_type_name": ("logSourceType", "source_type"),
        "phase_name": ("logEventPhase", "phase"),
    }
    found = {out: F.coalesce(last_name(F.lit(enum), F.col(code)), F.lit("")) for out, (enum, code) in columns.items()}
    return with_names(events, enums, [enum for enum, _ in columns.values()]).withColumns(found).drop(NAMES)


# --- events -----------------------------------------------------------------------


@lru_cache(maxsize=1)
def _typed(_: SparkContext) -> list[Column]:
    e = F.col("element")
    source, time = js.field(e, "source"), js.field(e, "time")
    start = js.field(source, "start_time")
    params = js.field(e, "params")
    return [
        e.isNull().alias("malformed"),
        js.text_to_number(js.as_string(time)).alias("time_ticks"),
        (js.is_object(source) & js.is_string(time)).alias("shaped"),
        js.as_int(js.field(e, "type")).cast("int").alias("type"),
        js.as_int(js.field(e, "phase")).cast("int").alias("phase"),
        F.coalesce(js.as_int(js.field(source, "id")), F.lit(0)).cast("bigint").alias("source_id"),
        js.as_int(js.field(source, "type")).cast("int").alias("source_type"),
        js.to_number(start).alias("start_time"),
        js.truthy(js.field(e, "wasPassivelyCaptured")).alias("passive"),
        F.when(js.is_object(params), params).alias("params"),
    ]


def typed_events(raw: DataFrame) -> DataFrame:
    """Members of ``element`` with their type rules; NULL where a rule fails."""
    others = [c for c in raw.columns if c != "element"]
    return raw.select(*others, *_typed(raw.sparkSession.sparkContext))


def validate_events(raw: DataFrame, names: DataFrame, key: str = "capture_id") -> DataFrame:
    """Add names and ``verdict`` (valid, passive, invalid, malformed) to raw events.

    ``names`` is id-to-name by ``key``; with ``key="constants_id"`` captures that share
    their constants share the rows. A missing name makes an event invalid.
    """
    events = typed_events(raw)
    for enum, column, out in (
        ("logEventTypes", "type", "type_name"),
        ("logSourceType", "source_type", "source_type_name"),
        ("logEventPhase", "phase", "phase_name"),
    ):
        one = names.where(F.col("enum") == enum).select(key, F.col("id").alias(column), F.col("name").alias(out))
        events = events.join(one, [key, column], "left")
    known = F.col("type_name").isNotNull() & F.col("source_type_name").isNotNull() & F.col("phase_name").isNotNull()
    verdict = (
        F.when(F.col("malformed"), F.lit("malformed"))
        .when(~(F.col("shaped") & known), F.lit("invalid"))
        .when(F.col("passive"), F.lit("passive"))
        .otherwise(F.lit("valid"))
    )
    return events.withColumn("verdict", verdict).drop("malformed", "shaped", "passive")


def discard_passive(checked: DataFrame) -> DataFrame:
    """Only the valid events; passively captured ones go with the rest."""
    return checked.where("verdict = 'valid'").drop("verdict")


def verdict_counts(checked: DataFrame, *also: Column) -> DataFrame:
    """Events seen, valid, invalid, passive and malformed per capture, with further
    aggregates in the same pass."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return checked.groupBy("capture_id").agg(
        *also,
        F.count_if(F.col("verdict") != "malformed").alias("n_seen"),
        count("valid").alias("n_valid"),
        count("invalid").alias("n_invalid"),
        count("passive").alias("n_passive"),
        count("malformed").alias("n_malformed"),
    )


def load_report(captures: DataFrame, max_events: int = 0) -> DataFrame:
    """Add ``load_log``: the warnings in a fixed order, then "Log loaded."."""
    none = F.lit("")

    def said(condition: Column, *parts) -> Column:
        texts = [p if isinstance(p, Column) else F.lit(p) for p in parts]
        return F.when(condition, F.concat(*texts)).otherwise(none)

    shown = lambda name: F.col(name).cast("string")
    text = F.concat(
        said(F.col("truncated"), TRUNCATED),
        said(
            F.col("cap_reached"),
            f"Reached the maximum of {max_events} events; the rest were not loaded.\n\n",
        ),
        said(F.col("n_malformed") > 0, "Skipped ", shown("n_malformed"), " unparseable event records.\n\n"),
        said((F.col("n_valid") == 0) & F.col("client_date_ms").isNull(), NO_DATE),
        said(F.col("n_invalid") > 0, "Unable to load ", shown("n_invalid"), " events, due to invalid data.\n\n"),
        said(F.col("n_passive") > 0, "Discarded ", shown("n_passive"), " passively collected events.\n\n"),
        F.lit("Log loaded."),
    )
    return captures.withColumn("load_log", F.when(F.col("status") == "ok", text))


def cap_events(events: DataFrame, max_events: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The first ``max_events`` events of each capture in file order; 0 or less keeps all."""
    return first_rows(events, ["capture_id"], "event_index", max_events, bucket_rows)


def reindex_events(events: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Replace ``event_index`` by a dense 0-based one in the same order."""
    ranked = row_rank(events, ["capture_id"], "event_index", "__rank", bucket_rows)
    return ranked.withColumn("event_index", F.col("__rank") - 1).drop("__rank")


def slim_events(events: DataFrame) -> DataFrame:
    """Params only where the time series need them, NULL elsewhere."""
    return events.withColumn("params", F.when(F.col("type_name").isin(*BYTE_EVENT_TYPES), F.col("params")))


@lru_cache(maxsize=1)
def _promoted(_: SparkContext) -> dict[str, Column]:
    return {n: js.as_number(js.field(F.col("params"), n)) for n in ("net_error", "byte_count", "bytes_copied")}


def promote_params(events: DataFrame) -> DataFrame:
    """Add the numeric params that aggregations read as plain columns, so that a stored
    table answers them without reading ``params``."""
    return events.withColumns(_promoted(events.sparkSession.sparkContext))


# --- time -------------------------------------------------------------------------


def with_wall_time(events: DataFrame, captures: DataFrame) -> DataFrame:
    """Add ``time_ms`` (wall clock) and ``relative_ms`` (since the capture's first event)."""
    scalars = captures.select("capture_id", "time_tick_offset", "base_time_ms")
    wall = F.col("time_tick_offset") + F.col("time_ticks")
    return (
        events.drop("time_ms")
        .join(scalars, "capture_id")
        .withColumn("time_ms", wall)
        .withColumn("relative_ms", wall - F.col("base_time_ms"))
        .drop("time_tick_offset", "base_time_ms")
    )


def export_date(captures: DataFrame) -> DataFrame:
    """``numeric_date_ms``: the client's date, else the last event's wall time, else 0."""
    last = F.col("time_tick_offset") + F.col("last_event_ticks")
    return captures.withColumn("numeric_date_ms", F.coalesce("client_date_ms", last, F.lit(0.0)))


def capture_metadata(captures: DataFrame) -> DataFrame:
    """What a capture says about itself, as shown to a reader."""
    blank = lambda name: F.coalesce(name, F.lit("")).alias(name)
    mode = F.when(F.coalesce("capture_mode", F.lit("")) == "", F.lit("(Not Recorded)")).otherwise(F.col("capture_mode"))
    return captures.select(
        "capture_id",
        format_time(F.col("numeric_date_ms")).alias("export_date"),
        mode.alias("capture_mode"),
        *[blank(n) for n in ("client_name", "client_version", "official", "cl", "version_mod", "os_type")],
        *[blank(n) for n in ("command_line", "user_comments")],
    )
