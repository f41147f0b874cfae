"""Event traces: BEGIN/END pairing, nesting, elapsed times, text search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructType

from ..functions.jsvalue import number_text
from ..session import cut_lineage
from . import pairing
from .grouping import SOURCE_KEY
from .scan import BUCKET_ROWS, bucket_column, running_sum

_BROADCAST_KEYS = 100_000
_CHUNK = [*SOURCE_KEY, "chunk"]


def _has_params(events: DataFrame) -> Column:
    return F.col("has_params") if "has_params" in events.columns else F.col("params").isNotNull()


def _sorted(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _alone(narrow: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """Event rows in the shape the pairing reads, together with decisions if there are any."""
    if "chunk" not in narrow.columns:
        narrow = narrow.withColumn("chunk", F.lit(-1).cast("bigint"))
    if decided is not None:
        return narrow.unionByName(decided, allowMissingColumns=True)
    fields = [f.strip().split() for f in pairing.DECIDED_SCHEMA.split(",")]
    missing = [F.lit(None).cast(kind).alias(name) for name, kind in fields if name not in narrow.columns]
    return narrow.select("*", *missing)


def match_begin_end(events: DataFrame, chunk_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pair BEGIN and END events of each source.

    An END closes the nearest open BEGIN of its type and every BEGIN above it. Per
    event: ``depth``, ``parent_index``, ``begin_index`` (on an END), ``end_index`` and
    ``end_ticks`` (on a BEGIN), ``collapsible`` (a BEGIN directly followed by its END,
    one of them without params) and ``hidden`` (that END).

    Sources with more than ``chunk_rows`` events are cut into chunks, so no task
    handles more than that many events of one source at a time.
    """
    phase = F.when(F.col("phase_name") == "PHASE_BEGIN", pairing.BEGIN).when(
        F.col("phase_name") == "PHASE_END", pairing.END
    )
    narrow = events.select(
        *SOURCE_KEY,
        "event_index",
        F.col("type").cast("int").alias("type"),
        F.coalesce(phase, F.lit(pairing.OTHER)).alias("phase"),
        "time_ticks",
        _has_params(events).alias("has_params"),
    )
    # a key listed here has more than chunk_rows events, so the list is short; its
    # length is checked before it is broadcast
    large = cut_lineage(
        narrow.groupBy(*SOURCE_KEY)
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > chunk_rows)
        .select(*SOURCE_KEY, F.lit(True).alias("is_large"))
    )
    found = large.count()
    if found == 0:
        return _sorted(_alone(narrow), _CHUNK, "event_index").mapInArrow(pairing.pair, pairing.PAIRED_SCHEMA)
    if found <= _BROADCAST_KEYS:
        large = F.broadcast(large)
    chunk = F.when(F.col("is_large"), bucket_column("event_index", chunk_rows)).otherwise(F.lit(-1))
    cut = narrow.join(large, list(SOURCE_KEY), "left").withColumn("chunk", chunk)

    parts = cut.where("is_large").drop("is_large")
    left_over = _sorted(parts, _CHUNK, "event_index").mapInArrow(pairing.undecided, pairing.UNDECIDED_SCHEMA)
    decided = _sorted(left_over, list(SOURCE_KEY), "chunk", "kind", "event_index").mapInArrow(
        pairing.decide, pairing.DECIDED_SCHEMA
    )
    merged = _alone(cut.drop("is_large"), decided)
    return (
        merged.repartition(*_CHUNK)
        .sortWithinPartitions(*_CHUNK, F.col("kind").asc_nulls_last(), "event_index")
        .mapInArrow(pairing.pair, pairing.PAIRED_SCHEMA)
    )


def event_trace(
    events: DataFrame,
    sources: DataFrame,
    captures: DataFrame,
    collapse: bool = True,
    chunk_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """The trace of every source, one row per shown event.

    ``t`` is the time since the capture's first event, ``st`` the time since the
    source's start, ``dt`` the elapsed time of a BEGIN (``is_open`` when it never
    ended and the export date stands in; "?" without one). ``captures`` has
    ``base_time_ms``, ``time_tick_offset`` and ``numeric_date_ms``.
    """
    pairs = match_begin_end(events, chunk_rows)
    if collapse:
        pairs = pairs.where(~F.col("hidden"))
    facts = events.select("capture_id", "source_id", "event_index", "type_name", "phase_name", "time_ticks")
    starts = sources.select(*SOURCE_KEY, "start_ticks")
    scalars = captures.select("capture_id", "base_time_ms", "time_tick_offset", "numeric_date_ms")
    rows = (
        facts.join(pairs, [*SOURCE_KEY, "event_index"])
        .join(starts, list(SOURCE_KEY))
        .join(scalars, "capture_id")
    )
    wall = F.col("time_tick_offset") + F.col("time_ticks")
    begins = F.col("phase_name") == "PHASE_BEGIN"
    closed = F.col("end_index").isNotNull()
    dt = F.when(begins & closed, F.col("end_ticks") - F.col("time_ticks")).when(
        begins, F.col("numeric_date_ms") - wall
    )
    marker = (
        F.when(begins & F.lit(collapse) & F.col("collapsible"), F.lit(" "))
        .when(begins, F.lit("+"))
        .when(F.col("phase_name") == "PHASE_END", F.lit("-"))
        .otherwise(F.lit(" "))
    )
    shown_dt = F.when(begins & closed, number_text(dt)).otherwise(
        F.coalesce(F.concat(number_text(dt), F.lit("+")), F.lit("?"))
    )
    text = F.concat(marker, F.col("type_name"), F.when(begins, F.concat(F.lit("  [dt="), shown_dt, F.lit("]"))).otherwise(F.lit("")))
    return rows.select(
        *SOURCE_KEY,
        "event_index",
        (wall - F.col("base_time_ms")).alias("t"),
        (F.col("time_ticks") - F.col("start_ticks")).alias("st"),
        "depth",
        marker.alias("marker"),
        text.alias("text"),
        dt.alias("dt"),
        (begins & ~closed).alias("is_open"),
    )


def begin_duration(events: DataFrame, captures: DataFrame, chunk_rows: int = BUCKET_ROWS) -> DataFrame:
    """Elapsed time of every BEGIN; an unmatched one runs to the export date, if known."""
    pairs = match_begin_end(events, chunk_rows).select(*SOURCE_KEY, "event_index", "end_index", "end_ticks")
    begins = events.where("phase_name = 'PHASE_BEGIN'").select(*SOURCE_KEY, "event_index", "time_ticks")
    rows = begins.join(pairs, [*SOURCE_KEY, "event_index"]).join(
        captures.select("capture_id", "time_tick_offset", "numeric_date_ms"), "capture_id"
    )
    wall = F.col("time_tick_offset") + F.col("time_ticks")
    closed = F.col("end_index").isNotNull()
    dt = F.when(closed, F.col("end_ticks") - F.col("time_ticks")).otherwise(F.col("numeric_date_ms") - wall)
    return rows.select(*SOURCE_KEY, "event_index", "end_index", dt.alias("dt"), (~closed).alias("is_open"))


def collapse_pairs(events: DataFrame, chunk_rows: int = BUCKET_ROWS) -> DataFrame:
    """BEGIN events shown as a single row, with the END that is hidden for each."""
    pairs = match_begin_end(events, chunk_rows)
    return pairs.where("collapsible").select(*SOURCE_KEY, "event_index", "end_index")


def trace_open_tail(
    events: DataFrame, sources: DataFrame, captures: DataFrame, chunk_rows: int = BUCKET_ROWS
) -> DataFrame:
    """One closing row at the export date for sources whose last event is nested or a BEGIN."""
    pairs = match_begin_end(events, chunk_rows).select(*SOURCE_KEY, "event_index", "depth")
    lasts = events.groupBy(*SOURCE_KEY).agg(
        F.max("event_index").alias("event_index"),
        F.max_by(F.col("phase_name") == "PHASE_BEGIN", "event_index").alias("begins"),
    )
    offset, export = F.col("time_tick_offset"), F.col("numeric_date_ms")
    return (
        lasts.join(pairs, [*SOURCE_KEY, "event_index"])
        .where("depth <> 0 or begins")
        .join(sources.select(*SOURCE_KEY, "start_ticks"), list(SOURCE_KEY))
        .join(captures.where("numeric_date_ms is not null"), "capture_id")
        .select(
            *SOURCE_KEY,
            (export - F.col("base_time_ms")).alias("t"),
            (export - (offset + F.col("start_ticks"))).alias("st"),
        )
    )


# --- search ---------------------------------------------------------------------


def check_pattern(query: str, use_regex: bool) -> str | None:
    """The error text of a bad regular expression, NULL when it is fine."""
    try:
        re.compile(query if use_regex else re.escape(query))
        return None
    except re.error as error:
        return str(error)


def find_matches(
    df: DataFrame, text: str, query: str, case_sensitive: bool = False, use_regex: bool = False
) -> DataFrame:
    """Every non-empty match of ``query`` in column ``text``: the row's other columns,
    ``match_no``, ``match_start`` and ``match_end`` (end exclusive).

    A bad expression raises ValueError before any job starts; an empty query finds
    nothing. Rows that cannot match a literal are dropped before Python sees them.
    """
    problem = check_pattern(query, use_regex)
    if problem is not None:
        raise ValueError(problem)
    others = [c for c in df.columns if c != text]
    schema = StructType([*df.select(*others).schema.fields])
    for name in ("match_no", "match_start", "match_end"):
        schema.add(name, IntegerType())
    if query == "":
        df = df.where(F.lit(False))
    elif not use_regex:
        hay, needle = (F.col(text), query) if case_sensitive else (F.lower(text), query.lower())
        if needle.isascii():
            df = df.where(hay.contains(needle))
    pattern = query if use_regex else re.escape(query)
    flags = 0 if case_sensitive else re.IGNORECASE

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(pattern, flags)
        for batch in batches:
            rows, numbers, starts, ends = [], [], [], []
            for row, value in enumerate(batch.column(text).to_pylist()):
                hits = (m.span() for m in compiled.finditer(value or "") if m.end() > m.start())
                for number, (start, end) in enumerate(hits):
                    rows.append(row)
                    numbers.append(number)
                    starts.append(start)
                    ends.append(end)
            picked = batch.select(others).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, *(pa.array(v, pa.int32()) for v in (numbers, starts, ends))],
                names=[*others, "match_no", "match_start", "match_end"],
            )

    return df.select(*others, text).mapInArrow(search, schema)


def shown_text(trace: DataFrame, lines: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """What a reader sees of each shown event: its row and below it the lines of its params
    (:func:`.params.param_lines`, in that order), as one ``text`` with line feeds, and ``offset``,
    the place at which it begins in the text of its source."""
    key = [*SOURCE_KEY, "event_index"]
    below = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("key", "line_no", "line"))).alias("below"))
    rows = trace.select(*key, "text").join(below, key, "left")
    listed = F.coalesce(F.transform("below", lambda r: r["line"]), F.array().cast("array<string>"))
    blocks = rows.select(*key, F.array_join(F.concat(F.array("text"), listed), "\n").alias("text"))
    # offsets need the lengths only
    sizes = blocks.select(*key, (F.char_length("text") + 1).cast("bigint").alias("size"))
    placed = running_sum(sizes, SOURCE_KEY, "event_index", F.col("size"), "upto", bucket_rows)
    return blocks.join(placed.select(*key, (F.col("upto") - F.col("size")).alias("offset")), key)


def trace_search(
    trace: DataFrame,
    query: str,
    use_regex: bool = False,
    case_sensitive: bool = False,
    max_matches: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
    lines: DataFrame | None = None,
) -> DataFrame:
    """Matches in the trace text of each source: the first ``max_matches`` in trace
    order (all by default), and whether there were more (``truncated``).

    With ``lines`` (:func:`.params.param_lines`) the lines below each event are searched as
    well, also across line ends. A match then tells its ``line_no`` below the event (0 is the
    event's own row), the ``line_start`` inside that line and ``text_start`` in the source's text.
    The matches are written once; what is ranked and counted starts from them.
    """
    if lines is None:
        found = find_matches(trace.select(*SOURCE_KEY, "event_index", "text"), "text", query, case_sensitive, use_regex)
    else:
        shown = shown_text(trace, lines, bucket_rows)
        found = find_matches(shown.withColumn("shown", F.col("text")), "text", query, case_sensitive, use_regex)
        before = F.split(F.substring("shown", F.lit(1), F.col("match_start")), "\n", -1)
        found = found.select(
            *SOURCE_KEY, "event_index", "match_no", "match_start", "match_end",
            (F.size(before) - 1).alias("line_no"),
            F.char_length(F.element_at(before, -1)).alias("line_start"),
            (F.col("offset") + F.col("match_start")).alias("text_start"),
        )
    if max_matches is None:
        return found.withColumn("truncated", F.lit(False))
    found = cut_lineage(found)
    totals = found.groupBy(*SOURCE_KEY).agg((F.count("*") > max_matches).alias("truncated"))
    if max_matches <= 0:
        return found.where(F.lit(False)).withColumn("truncated", F.lit(True))
    # matches before an event, then the place inside it
    per_event = found.groupBy(*SOURCE_KEY, "event_index").agg(F.count("*").alias("n"))
    before = running_sum(per_event, SOURCE_KEY, "event_index", F.col("n"), "upto", bucket_rows)
    kept = (
        found.join(before, [*SOURCE_KEY, "event_index"])
        .where(F.col("upto") - F.col("n") + F.col("match_no") < max_matches)
        .drop("upto", "n")
    )
    return kept.join(totals, list(SOURCE_KEY))
