"""Time series over captures: open-source counts, transfer rates, sampling.

Points keep the order of the file. Where a capture's clock steps back, a sample
sees a point only once every earlier point has been passed; ``arrival_ms`` (the
running maximum of the time) expresses that rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import format_rate
from ..session import cut_lineage
from .grouping import param_number
from .scan import BUCKET_ROWS, max_step, previous_value, running, running_max, sum_step

# fixed values: series name -> (source type, event type)
COUNT_SERIES = {
    "Open sockets": ("SOCKET", "SOCKET_ALIVE"),
    "In-use sockets": ("SOCKET", "SOCKET_IN_USE"),
    "URL requests": ("URL_REQUEST", "REQUEST_ALIVE"),
    "DNS jobs": ("HOST_RESOLVER_IMPL_JOB", "HOST_RESOLVER_IMPL_JOB"),
}
# series name -> event types that carry byte_count
NETWORK_SERIES = {
    "Bytes received": ("SOCKET_BYTES_RECEIVED", "UDP_BYTES_RECEIVED"),
    "Bytes sent": ("SOCKET_BYTES_SENT", "UDP_BYTES_SENT"),
}
# series name -> event type whose END carries bytes_copied
CACHE_SERIES = {"Disk cache read": "ENTRY_READ_DATA", "Disk cache write": "ENTRY_WRITE_DATA"}
CACHE_SOURCE = "DISK_CACHE_ENTRY"
DEFAULT_STEP_MS = 1000.0
MIN_STEP_MS = 5.0

SERIES_KEY = ["capture_id", "series"]


# --- points ---------------------------------------------------------------------


def _count_points(tagged: DataFrame, bucket_rows: int) -> DataFrame:
    """Points of the open-source counts.

    A source is open iff its latest relevant event was a BEGIN, so each change is
    found from the previous relevant event alone, and the count is their sum.
    """
    cols = [*SERIES_KEY, "source_id", "event_index", "time_ms"]
    opens = F.col("phase_name") == "PHASE_BEGIN"
    relevant = tagged.where(F.col("phase_name").isin("PHASE_BEGIN", "PHASE_END")).select(*cols, opens.alias("opens"))
    known = previous_value(relevant, [*SERIES_KEY, "source_id"], "event_index", F.col("opens"), "was_open", bucket_rows)
    was = F.coalesce("was_open", F.lit(False))
    change = F.when(F.col("opens") & ~was, 1).when(~F.col("opens") & was, -1).otherwise(0).cast("bigint")
    # written once: far fewer rows than events, and the next scan reads them twice
    changes = cut_lineage(known.select(*SERIES_KEY, "event_index", "time_ms", change.alias("change")).where("change <> 0"))
    steps = [sum_step("n", F.col("change")), max_step("arrival_ms", F.col("time_ms"))]
    counted = running(changes, SERIES_KEY, "event_index", steps, bucket_rows)
    return counted.select(*SERIES_KEY, "event_index", "time_ms", F.col("n").cast("double").alias("value"), "arrival_ms")


def _count_tag() -> Column:
    kind, name = F.col("source_type_name"), F.col("type_name")
    # the end of a TLS handshake frees a socket whatever its source type
    tag = F.when((name == "SSL_CONNECT") & (F.col("phase_name") == "PHASE_END"), F.lit("In-use sockets"))
    for series, (source_type, event_type) in COUNT_SERIES.items():
        tag = tag.when((kind == source_type) & (name == event_type), F.lit(series))
    return tag


def count_points(events: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Points of all four count series, with their ``arrival_ms``."""
    tagged = events.withColumn("series", _count_tag()).where(F.col("series").isNotNull())
    return _count_points(tagged, bucket_rows)


def active_count(
    events: DataFrame, source_type: str, event_type: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """How many sources of a type have an open BEGIN of an event type; a row per change."""
    chosen = (F.col("source_type_name") == source_type) & (F.col("type_name") == event_type)
    tagged = events.where(chosen).withColumn("series", F.lit(f"{source_type}/{event_type}"))
    return _count_points(tagged, bucket_rows)


def sockets_in_use(events: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Open SOCKET_IN_USE sources, also freed by the end of any TLS handshake."""
    tagged = events.withColumn("series", _count_tag()).where(F.col("series") == "In-use sockets")
    return _count_points(tagged, bucket_rows)


def byte_points(events: DataFrame) -> DataFrame:
    """Points of the four transfer series. Purely a filtered projection."""
    name = F.col("type_name")
    tag = F.lit(None).cast("string")
    value = F.lit(None).cast("double")
    for series, types in NETWORK_SERIES.items():
        tag = F.when(name.isin(*types), F.lit(series)).otherwise(tag)
        value = F.when(name.isin(*types), param_number(events, "byte_count")).otherwise(value)
    cached = (F.col("source_type_name") == CACHE_SOURCE) & (F.col("phase_name") == "PHASE_END")
    copied = param_number(events, "bytes_copied")
    for series, event_type in CACHE_SERIES.items():
        hit = cached & (name == event_type)
        tag = F.when(hit, F.lit(series)).otherwise(tag)
        value = F.when(hit & (copied != 0.0), copied).otherwise(value)
    wanted = [t for types in NETWORK_SERIES.values() for t in types] + list(CACHE_SERIES.values())
    return (
        events.where(name.isin(*wanted))
        .select("capture_id", tag.alias("series"), "event_index", "time_ms", value.alias("value"))
        .where("series is not null and value is not null")
    )


# --- sampling -------------------------------------------------------------------


def timeline_range(events: DataFrame) -> DataFrame:
    """Wall time of the first and last event in file order, per capture."""
    ends = events.groupBy("capture_id").agg(
        F.min_by("time_ms", "event_index").alias("first_ms"), F.max_by("time_ms", "event_index").alias("end_ms")
    )
    start = F.when(F.col("end_ms") <= F.col("first_ms"), F.col("end_ms") - 1.0).otherwise(F.col("first_ms"))
    return ends.select(
        "capture_id", start.alias("start_ms"), "end_ms", F.lit(DEFAULT_STEP_MS).alias("step_ms")
    )


def _step(step: float) -> float:
    return max(float(step), MIN_STEP_MS)


def _grid(windows: DataFrame, series: list[str], step: float, n: int) -> DataFrame:
    """Sample instants: ``n`` per capture and series."""
    return (
        windows.select("capture_id", "start_ms")
        .withColumn("series", F.explode(F.array(*[F.lit(s) for s in series])))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("sample_ms", F.col("start_ms") + F.col("i") * F.lit(step))
        .drop("start_ms")
    )


def _slotted(points: DataFrame, windows: DataFrame, step: float, n: int, bucket_rows: int) -> DataFrame:
    """Points with the number of the first sample instant after their arrival."""
    arrived = points
    if "arrival_ms" not in points.columns:
        arrived = running_max(cut_lineage(points), SERIES_KEY, "event_index", F.col("time_ms"), "arrival_ms", bucket_rows)
    slot = F.floor((F.col("arrival_ms") - F.col("start_ms")) / F.lit(step)) + 1
    return (
        arrived.join(windows.select("capture_id", "start_ms"), "capture_id")
        # a clock may jump past all numbers of instants, so only those wanted become integers
        .withColumn("slot", F.greatest(slot, F.lit(0)))
        .where(F.col("slot") < n)
        .withColumn("i", F.col("slot").cast("int"))
        .drop("slot")
    )


def sample_latest(
    points: DataFrame, windows: DataFrame, step: float, n: int, series: list[str], bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Value of the last point strictly before each instant, 0 before any.

    ``windows`` has ``capture_id`` and ``start_ms``. Points shrink to at most one per
    instant before the grid is filled, so the fill handles ``n`` rows per series.
    """
    step = _step(step)
    latest = (
        _slotted(points, windows, step, n, bucket_rows)
        .groupBy(*SERIES_KEY, "i")
        .agg(F.max_by("value", "event_index").alias("found"))
    )
    upto = Window.partitionBy(*SERIES_KEY).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    filled = _grid(windows, series, step, n).join(latest, [*SERIES_KEY, "i"], "left")
    value = F.coalesce(F.last("found", ignorenulls=True).over(upto), F.lit(0.0))
    return filled.select(*SERIES_KEY, "i", "sample_ms", value.alias("value"))


def sample_rate(
    points: DataFrame, windows: DataFrame, step: float, n: int, series: list[str], bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Mean bytes per second over the interval before each instant."""
    step = _step(step)
    sums = (
        _slotted(points, windows, step, n, bucket_rows)
        .where(F.col("arrival_ms") >= F.col("start_ms") - F.lit(step))
        .groupBy(*SERIES_KEY, "i")
        .agg(F.sum("value").alias("bytes"))
    )
    filled = _grid(windows, series, step, n).join(sums, [*SERIES_KEY, "i"], "left")
    value = F.lit(1000.0) * F.coalesce("bytes", F.lit(0.0)) / F.lit(step)
    return filled.select(*SERIES_KEY, "i", "sample_ms", value.alias("value"))


def network_rate(events: DataFrame, direction: str, windows: DataFrame, step: float, n: int) -> DataFrame:
    """Bytes ``received`` or ``sent`` per second."""
    series = f"Bytes {direction}"
    chosen = byte_points(events.where(F.col("type_name").isin(*NETWORK_SERIES[series])))
    return sample_rate(chosen, windows, step, n, [series])


def disk_cache_rate(events: DataFrame, op: str, windows: DataFrame, step: float, n: int) -> DataFrame:
    """Disk cache bytes per second, ``read`` or ``write``."""
    series = f"Disk cache {op}"
    chosen = byte_points(events.where(F.col("type_name") == CACHE_SERIES[series]))
    return sample_rate(chosen, windows, step, n, [series])


def series_all(
    events: DataFrame, windows: DataFrame, step: float, n: int, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """The eight series in long form: ``kind`` is ``count`` or ``rate``."""
    rates = [*NETWORK_SERIES, *CACHE_SERIES]
    counted = sample_latest(count_points(events, bucket_rows), windows, step, n, list(COUNT_SERIES), bucket_rows)
    moved = sample_rate(byte_points(events), windows, step, n, rates, bucket_rows)
    return counted.withColumn("kind", F.lit("count")).unionByName(moved.withColumn("kind", F.lit("rate")))


def series_peak(samples: DataFrame) -> DataFrame:
    """Greatest sampled value per kind of series."""
    return samples.groupBy("capture_id", "kind").agg(F.greatest(F.max("value"), F.lit(0.0)).alias("peak"))


def values_at(events: DataFrame, instants: DataFrame, step: float = DEFAULT_STEP_MS) -> DataFrame:
    """One sample of each series at an instant per capture (``start_ms``), with its text."""
    samples = series_all(events, instants, step, 1)
    return samples.select(
        *SERIES_KEY, "kind", "sample_ms", "value", format_rate(F.col("kind"), F.col("value")).alias("shown")
    )


# --- which sources were alive at an instant ---------------------------------------

# lifetimes that one task should hold of a block; more are dealt to several
HOT_BLOCK_ROWS = 100_000


def sources_active_at(sources: DataFrame, instants: DataFrame, cell_ms: float = 1.0, hot_rows: int = HOT_BLOCK_ROWS) -> DataFrame:
    """Pairs of an instant (``capture_id, at_ms``) and a source alive then, ends inclusive.

    ``sources`` has wall times ``start_ms`` and ``end_ms``. Lifetimes are split into
    aligned blocks of 1, 2, 4, ... cells: at most two per size, however long they
    are, and an instant lies in one block of each size. The join on blocks thus
    meets only pairs that overlap, up to the rounding of a cell at either end, which
    the last filter checks.

    There are as many sizes as the longest lifetime needs. A block with more than ``hot_rows``
    lifetimes is split into parts of about that many, and its instants go to all parts. The
    longest lifetime and the sizes of blocks are looked up when this is called.
    """
    first, past = F.floor(F.col("start_ms") / cell_ms), F.floor(F.col("end_ms") / cell_ms) + 1
    lives = sources.where("end_ms >= start_ms").select("capture_id", "source_id", "start_ms", "end_ms", first.alias("first"), past.alias("past"))
    lives = cut_lineage(lives)
    longest = lives.agg(F.max(F.col("past") - F.col("first")).alias("n")).first()["n"] or 1
    levels = f"sequence(0, {int(longest).bit_length() - 1})"
    # whole-number shifts: a double would round long counts of cells
    ends = f"transform({levels}, v -> struct(v AS level, -shiftright(-first, v) AS lo, shiftright(past, v) AS hi))"
    odd = "filter(array(CASE WHEN pmod(e.lo, 2) = 1 THEN e.lo END, CASE WHEN pmod(e.hi, 2) = 1 THEN e.hi - 1 END), b -> b IS NOT NULL)"
    made = f"flatten(transform(filter({ends}, e -> e.lo < e.hi), e -> transform({odd}, b -> struct(e.level AS level, b AS block))))"
    blocks = lives.select("capture_id", "source_id", "start_ms", "end_ms", F.expr(f"inline({made})"))
    key = ["capture_id", "level", "block"]
    # each such block has more than hot_rows rows, so they are few
    hot = cut_lineage(blocks.groupBy(*key).agg(F.ceil(F.count("*") / hot_rows).alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = blocks.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64("source_id", "start_ms", "end_ms"), parts)).drop("parts")
    points = instants.select("capture_id", "at_ms", F.floor(F.col("at_ms") / cell_ms).alias("cell"))
    points = points.select("capture_id", "at_ms", F.expr(f"inline(transform({levels}, v -> struct(v AS level, shiftright(cell, v) AS block)))"))
    points = points.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1))).drop("parts")
    return dealt.join(points, [*key, "part"]).where("start_ms <= at_ms and at_ms <= end_ms").select("capture_id", "at_ms", "source_id")
