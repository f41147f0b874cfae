"""Sorting, limits and summary counts over sources and plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage

# first-match sort keys; anything else sorts by time
_SORT_KEYS = {
    "time": ("start_ticks", "source_id"),
    "id": ("source_id",),
    "active": ("inactive",),
    "desc": ("description",),
    "duration": ("duration",),
    "type": ("source_type_name",),
}


def _order(by: str, backwards: bool):
    # file order breaks ties; a backwards list is the whole list reversed, ties too
    names = [*_SORT_KEYS.get(by, _SORT_KEYS["time"]), "first_event_index", "capture_id"]
    cols = [~F.col("is_active") if n == "inactive" else F.col(n) for n in names]
    return [c.desc() if backwards else c.asc() for c in cols]


def sort_sources(sources: DataFrame, by: str = "time", backwards: bool = False) -> DataFrame:
    """Sort by time, id, active, desc, duration or type."""
    return sources.orderBy(*_order(by, backwards))


def sort_rows(df: DataFrame, column: str, desc: bool = False, tie: str | None = None) -> DataFrame:
    """Sort a table by a column's text, ignoring case. ``tie`` names a column that
    holds the original order, which keeps equal rows stable."""
    keys = [F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))] + ([F.col(tie)] if tie else [])
    return df.orderBy(*[k.desc() if desc else k.asc() for k in keys])


def top_sources(sources: DataFrame, n: int = 0, by: str = "time", backwards: bool = False) -> DataFrame:
    """The first ``n`` sources of the sorted matches (0 or less: all), each with the total match
    count. The sources are written once for both."""
    sources = cut_lineage(sources)
    ordered = sort_sources(sources, by, backwards)
    total = sources.agg(F.count("*"))
    return (ordered.limit(n) if n > 0 else ordered).withColumn("total_matches", total.scalar())


def with_position(ordered: DataFrame) -> DataFrame:
    """Add the 1-based ``position`` of each row of a sorted table.

    The sorted partitions are written once; a row's place is its place in its
    partition plus the rows of the partitions before, of which there is one count
    each.
    """
    placed = cut_lineage(ordered.withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__id", 33)).withColumn(
        "__row", F.col("__id").bitwiseAND((1 << 33) - 1)
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("__part")
        .agg(F.count("*").alias("n"))
        .select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    )
    return (
        placed.join(starts, "__part")
        .withColumn("position", F.col("__start") + F.col("__row") + 1)
        .drop("__id", "__part", "__row", "__start")
    )


def order_details(sources: DataFrame) -> DataFrame:
    return sources.orderBy("source_id", "capture_id")


def error_count(sources: DataFrame) -> DataFrame:
    return sources.groupBy("capture_id").agg(
        F.count_if("is_error").alias("error_sources"), F.count("*").alias("sources")
    )


def capture_stats(events: DataFrame) -> DataFrame:
    """Events and sources per capture. Sources are counted from per-source partial
    counts, so one large capture or source does not gather in one task."""
    per_source = events.groupBy("capture_id", "source_id").agg(F.count("*").alias("n"))
    return per_source.groupBy("capture_id").agg(
        F.sum("n").alias("event_count"), F.count("*").alias("source_count")
    )


def busiest_sources(sources: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` sources with most events per capture, with the capture's totals."""
    sources = cut_lineage(sources)
    w = Window.partitionBy("capture_id").orderBy(F.desc("event_count"), "first_event_index")
    totals = sources.groupBy("capture_id").agg(
        F.sum("event_count").alias("events"),
        F.count("*").alias("sources"),
        F.count_if("is_error").alias("error_sources"),
    )
    top = (
        sources.select("capture_id", "source_id", "event_count", "first_event_index")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .drop("first_event_index")
    )
    return top.join(totals, "capture_id")
