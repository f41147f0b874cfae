"""Stored summaries of time series that answer any instant or range without the events.

A series is cut into cells of ``cell_ms``. A cell's summary (last value, greatest value, sum, count)
can be merged with its neighbour's, so summaries are kept for blocks of 1, 2, 4, ... cells: at most
twice as many rows as cells with points. A range is made of at most two blocks of each size, so
an answer reads O(log n) rows by an equi-join, however long the range or the capture is.

Instants and ends of ranges count from the start of their cell. Points keep the order of the file
(:mod:`.timeline`): a point belongs to the cell of its arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scan import BUCKET_ROWS, running_max
from .timeline import SERIES_KEY

# sizes of 2^0 to 2^47 cells
LEVELS = 48
_FIRST_CELL = -(1 << (LEVELS - 1))
_KEY = [*SERIES_KEY, "level", "block"]


def _cell(time: Column, cell_ms: float) -> Column:
    return F.floor(time / F.lit(float(cell_ms)))


def _merged(grouped) -> DataFrame:
    """Summaries of neighbours as one. Later events never arrive earlier, so the last value is
    that of the greatest event."""
    return grouped.agg(
        F.max_by("last", "last_index").alias("last"),
        F.max("last_index").alias("last_index"),
        F.max("peak").alias("peak"),
        F.sum("total").alias("total"),
        F.sum("n").alias("n"),
    )


def series_pyramid(points: DataFrame, cell_ms: float, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``capture_id, series, level, block, last, last_index, peak, total, n`` of ``points``
    (``capture_id, series, event_index, time_ms, value`` and, if known, ``arrival_ms``)."""
    if "arrival_ms" not in points.columns:
        points = running_max(points, SERIES_KEY, "event_index", F.col("time_ms"), "arrival_ms", bucket_rows)
    cells = points.groupBy(*SERIES_KEY, _cell(F.col("arrival_ms"), cell_ms).alias("cell")).agg(
        F.max_by("value", "event_index").alias("last"),
        F.max("event_index").alias("last_index"),
        F.max("value").alias("peak"),
        F.sum("value").alias("total"),
        F.count("*").alias("n"),
    )
    level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    blocks = cells.withColumn("level", level).withColumn("block", F.expr("shiftright(cell, level)"))
    return _merged(blocks.groupBy(*_KEY))


def merge_pyramids(pyramid: DataFrame) -> DataFrame:
    """Several pyramids of one ``cell_ms``, of different points, as one."""
    return _merged(pyramid.groupBy(*_KEY))


def _blocks(lo: str, hi: str) -> Column:
    """The blocks that make up the cells from ``lo`` to before ``hi``."""
    # at a level, the range's ends rounded inwards; an odd end is a block that no larger one holds
    at = f"transform(sequence(0, {LEVELS - 1}), v -> struct(v AS level, -shiftright(-{lo}, v) AS a, shiftright({hi}, v) AS b))"
    sides = "flatten(transform({at}, x -> filter(array(struct(x.level AS level, CASE WHEN x.a < x.b AND pmod(x.a, 2) = 1 THEN x.a END AS block), struct(x.level AS level, CASE WHEN x.a < x.b AND pmod(x.b, 2) = 1 THEN x.b - 1 END AS block)), y -> y.block IS NOT NULL)))"
    return F.expr(sides.format(at=at))


def _answers(pyramid: DataFrame, asked: DataFrame, keep: list[str]) -> DataFrame:
    """``asked`` (``capture_id``, ``keep``, ``lo`` and ``hi`` in cells) for every series of its
    capture, with the summary of the cells between; NULLs where there are no points."""
    top = pyramid.where(F.col("level") == LEVELS - 1).select(*SERIES_KEY).distinct()
    wanted = asked.join(top, "capture_id").withColumn("blocks", _blocks("lo", "hi"))
    wanted = wanted.select(*SERIES_KEY, *keep, F.inline_outer("blocks"))
    met = wanted.join(pyramid, _KEY, "left")
    return _merged(met.groupBy(*SERIES_KEY, *keep))


def values_before(pyramid: DataFrame, instants: DataFrame, cell_ms: float) -> DataFrame:
    """Value of each series' last point before an instant (``capture_id, at_ms``), 0 before any."""
    asked = instants.select("capture_id", "at_ms", F.lit(_FIRST_CELL).alias("lo"), _cell(F.col("at_ms"), cell_ms).alias("hi"))
    found = _answers(pyramid, asked, ["at_ms"])
    return found.select(*SERIES_KEY, "at_ms", F.coalesce("last", F.lit(0.0)).alias("value"))


def range_summaries(pyramid: DataFrame, ranges: DataFrame, cell_ms: float) -> DataFrame:
    """``peak``, ``total`` and ``n`` of each series' points in a range (``capture_id, start_ms,
    end_ms``, the end not included), NULL, 0 and 0 without any.

    The greatest value that a count *had* in a range is the greater of ``peak`` and its value
    before the range; a mean rate is ``total`` over the range's length.
    """
    asked = ranges.select("capture_id", "start_ms", "end_ms", _cell(F.col("start_ms"), cell_ms).alias("lo"), _cell(F.col("end_ms"), cell_ms).alias("hi"))
    found = _answers(pyramid, asked, ["start_ms", "end_ms"])
    return found.select(*SERIES_KEY, "start_ms", "end_ms", "peak", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))
