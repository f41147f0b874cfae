"""Events grouped into sources: activity, errors, timing, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import jsvalue as js
from ..session import cut_lineage
from .scan import BUCKET_ROWS, row_rank

SOURCE_KEY = ("capture_id", "source_id")
# a failed cache lookup is an ordinary miss, not an error of the source
_CACHE_LOOKUP = "HTTP_CACHE_OPEN_ENTRY"
_CACHE_MISS = "ERR_FAILED"


def param_number(events: DataFrame, name: str) -> Column:
    """A numeric param: the promoted column of that name if stored, else read from ``params``."""
    if name in events.columns:
        return F.col(name)
    return js.as_number(js.field(F.col("params"), name))


_PART_KEY = (*SOURCE_KEY, "source_type", "source_type_name", "type", "type_name")


def source_parts(events: DataFrame) -> DataFrame:
    """What is known of each source from some of its events: one row per source, source type and
    event type. Parts of other events are added by :func:`merge_parts`, in any order and grouping,
    so parts can be stored beside the events and new files need no look at old ones.

    Every aggregate has a fixed-width buffer, so this is a hash aggregation with a
    map-side combine: a source holding a third of all events shrinks to one row per
    event type before the shuffle.
    """
    code = param_number(events, "net_error").try_cast("bigint")
    failing = F.when(param_number(events, "net_error") != 0.0, code)
    ticks, index = F.col("time_ticks"), F.col("event_index")
    return events.groupBy(*_PART_KEY).agg(
        F.count("*").alias("n"),
        F.min(index).alias("first_idx"),
        F.max(index).alias("last_idx"),
        F.max(F.when(F.col("phase_name") == "PHASE_END", index)).alias("last_end_idx"),
        F.min_by(F.col("phase_name") == "PHASE_BEGIN", index).alias("first_begins"),
        F.min_by(F.coalesce("start_time", "time_ticks"), index).alias("first_ticks"),
        F.max_by(ticks, index).alias("last_ticks"),
        F.min(failing).alias("min_code"),
        F.max(failing).alias("max_code"),
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """Parts of different events of the same sources as one; the inverse of splitting the events."""
    first, last = "first_idx", "last_idx"
    return parts.groupBy(*_PART_KEY).agg(
        F.sum("n").alias("n"),
        F.min(first).alias(first),
        F.max(last).alias(last),
        F.max("last_end_idx").alias("last_end_idx"),
        F.min_by("first_begins", first).alias("first_begins"),
        F.min_by("first_ticks", first).alias("first_ticks"),
        F.max_by("last_ticks", last).alias("last_ticks"),
        F.min("min_code").alias("min_code"),
        F.max("max_code").alias("max_code"),
    )


def last_event_ticks(events: DataFrame) -> DataFrame:
    """Ticks of each capture's last event in file order."""
    return events.groupBy("capture_id").agg(F.max_by("time_ticks", "event_index").alias("last_event_ticks"))


def group_sources(events: DataFrame, enums: DataFrame | None = None) -> DataFrame:
    """One row per (capture, source) with state and timing; descriptions come from
    :func:`wiretrace.operators.describe.describe_sources`.

    ``enums`` supplies each capture's own code for the exempt cache-miss error;
    without it no error is exempt. The events are read once, when this is called.
    """
    return sources_of_parts(source_parts(events), enums)


def sources_of_parts(parts: DataFrame, enums: DataFrame | None = None) -> DataFrame:
    """:func:`group_sources` from merged parts alone."""
    if enums is None:
        parts = parts.withColumn("miss", F.lit(None).cast("bigint"))
    else:
        miss = (
            enums.where((F.col("enum") == "netError") & (F.col("name") == _CACHE_MISS))
            .groupBy("capture_id")
            .agg(F.max("id").cast("bigint").alias("miss"))
        )
        parts = parts.join(miss, "capture_id", "left")
    exempt = (
        (F.col("type_name") == _CACHE_LOOKUP)
        & (F.col("min_code") == F.col("miss"))
        & (F.col("max_code") == F.col("miss"))
    )
    failed = F.col("min_code").isNotNull() & ~F.coalesce(exempt, F.lit(False))

    # a source has at most one row per type pair here, so this window stays small
    of_source = Window.partitionBy(*SOURCE_KEY)
    parts = parts.withColumn("first_type", F.min_by("type", "first_idx").over(of_source))
    ends_first = F.when(F.col("type") == F.col("first_type"), F.col("last_end_idx"))
    rows = parts.groupBy(*SOURCE_KEY).agg(
        F.min_by(F.struct("source_type", "source_type_name", "first_begins", "first_ticks"), "first_idx").alias("head"),
        F.min("first_idx").alias("first_event_index"),
        F.sum("n").alias("event_count"),
        F.max_by("last_ticks", "last_idx").alias("last_ticks"),
        F.max("last_idx").alias("last_idx"),
        F.max(ends_first).alias("end_idx"),
        F.max(failed).alias("is_error"),
    )
    rows = rows.withColumn(
        "is_active",
        F.col("head.first_begins") & (F.coalesce("end_idx", F.lit(-1)) <= F.col("first_event_index")),
    )
    # written once: a capture's last event is the last of its sources' last events
    rows = cut_lineage(rows)
    finish = rows.groupBy("capture_id").agg(F.max_by("last_ticks", "last_idx").alias("last_event_ticks"))
    end = F.when(F.col("is_active"), F.col("last_event_ticks")).otherwise(F.col("last_ticks"))
    return rows.join(finish, "capture_id").select(
        *SOURCE_KEY,
        F.col("head.source_type").alias("source_type"),
        F.col("head.source_type_name").alias("source_type_name"),
        "is_error",
        "is_active",
        F.col("head.first_ticks").alias("start_ticks"),
        end.alias("end_ticks"),
        (end - F.col("head.first_ticks")).alias("duration"),
        "event_count",
        "first_event_index",
    )


def source_is_active(events: DataFrame) -> DataFrame:
    return group_sources(events).select(*SOURCE_KEY, "is_active")


def source_is_error(events: DataFrame, enums: DataFrame | None = None) -> DataFrame:
    return group_sources(events, enums).select(*SOURCE_KEY, "is_error")


def source_timing(events: DataFrame) -> DataFrame:
    return group_sources(events).select(*SOURCE_KEY, "start_ticks", "end_ticks", "duration")


def source_event_count(events: DataFrame) -> DataFrame:
    return events.groupBy(*SOURCE_KEY).agg(F.count("*").alias("event_count"))


def source_events(
    events: DataFrame, selected: DataFrame | None = None, cap: int = 0, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Events of the selected sources, the first ``cap`` of each in file order, with
    the source's total and a truncation flag. ``cap <= 0`` keeps all.

    ``selected`` has ``capture_id`` and ``source_id``; NULL selects every source.
    """
    if selected is not None:
        # keys only; written once because the events are passed over three times
        keys = cut_lineage(selected.select(*SOURCE_KEY).distinct())
        events = events.join(keys, list(SOURCE_KEY), "left_semi")
    totals = source_event_count(events).withColumnRenamed("event_count", "total")
    if cap > 0:
        totals = totals.withColumn("truncated", F.col("total") > cap)
        ranked = row_rank(events, SOURCE_KEY, "event_index", "position", bucket_rows)
        events = ranked.where(F.col("position") <= cap).drop("position")
    else:
        totals = totals.withColumn("truncated", F.lit(False))
    return events.join(totals, list(SOURCE_KEY))


def source_dependencies(events: DataFrame) -> DataFrame:
    """Edges: which source an event says it depends on."""
    dep = js.field(F.col("params"), "source_dependency")
    return (
        events.withColumn("dep", dep)
        .where(js.is_object(F.col("dep")))
        .select(
            "capture_id",
            "event_index",
            "source_id",
            F.coalesce(js.as_int(js.field(F.col("dep"), "id")), F.lit(0)).cast("bigint").alias("dep_id"),
            F.coalesce(js.as_int(js.field(F.col("dep"), "type")), F.lit(0)).cast("int").alias("dep_type"),
        )
    )
