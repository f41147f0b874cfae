"""Predicates on the sources table, and their conjunction as one call."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from .grouping import SOURCE_KEY


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def filter_type(names: Sequence[str]) -> Column:
    """Source type contains one of ``names``, ignoring case; no names match nothing."""
    kind = F.lower("source_type_name")
    return _any([kind.contains(n.lower()) for n in names])


def filter_id(ids: Sequence[int]) -> Column:
    return F.col("source_id").isin(*ids) if ids else F.lit(False)


def filter_active() -> Column:
    return F.col("is_active")


def filter_error() -> Column:
    return F.col("is_error")


def filter_active_at(at_ms: float, offset: Column | float = 0.0) -> Column:
    """Alive at wall time ``at_ms``, both ends inclusive. ``offset`` is the capture's
    tick offset (a column where captures differ)."""
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    start = offset + F.col("start_ticks")
    end = offset + (F.col("start_ticks") + F.col("duration"))
    return (start <= F.lit(at_ms)) & (F.lit(at_ms) <= end)


def filter_text(term: str, search_text: Column | None = None) -> Column:
    """``term`` occurs in description, type name, id or the given text, ignoring case."""
    term = term.lower()
    hay = [F.lower("description"), F.lower("source_type_name"), F.col("source_id").cast("string")]
    if search_text is not None:
        hay.append(F.lower(search_text))
    return _any([F.coalesce(h.contains(term), F.lit(False)) for h in hay])


def has_param_text(events: DataFrame, term: str) -> DataFrame:
    """Keys of sources with an event whose params JSON contains ``term``, ignoring case.

    The term is tested in the scan; only the keys of hits are shuffled.
    """
    text = F.lower(F.to_json("params"))
    return events.where(text.contains(term.lower())).select(*SOURCE_KEY).distinct()


def filter_sources(
    sources: DataFrame,
    *,
    types: Sequence[str] | None = None,
    ids: Sequence[int] | None = None,
    error: bool | None = None,
    active: bool | None = None,
    at_ms: float | None = None,
    texts: Sequence[str] = (),
    exclude: Sequence[Column] = (),
    has: str | None = None,
    events: DataFrame | None = None,
    captures: DataFrame | None = None,
) -> DataFrame:
    """All given conditions together.

    ``error`` and ``active`` take True or False (negated); ``exclude`` lists
    predicates to negate. ``has`` needs ``events``. ``captures`` supplies
    ``time_tick_offset`` for ``at_ms``; without it ticks are wall time.
    """
    tests: list[Column] = []
    if types is not None:
        tests.append(filter_type(types))
    if ids is not None:
        tests.append(filter_id(ids))
    if error is not None:
        tests.append(filter_error() if error else ~filter_error())
    if active is not None:
        tests.append(filter_active() if active else ~filter_active())
    tests += [filter_text(t) for t in texts]
    tests += [~c for c in exclude]
    columns = sources.columns
    if at_ms is not None and captures is not None:
        sources = sources.join(captures.select("capture_id", "time_tick_offset"), "capture_id")
        tests.append(filter_active_at(at_ms, F.col("time_tick_offset")))
    elif at_ms is not None:
        tests.append(filter_active_at(at_ms))
    if tests:
        sources = sources.where(reduce(and_, tests))
    if has:
        if events is None:
            raise ValueError("a params search needs the events table")
        sources = sources.join(has_param_text(events, has), list(SOURCE_KEY), "left_semi")
    return sources.select(*columns)


def filter_rows_any_column(df: DataFrame, text: str) -> DataFrame:
    """Rows where any cell contains ``text``, ignoring case; empty text keeps all."""
    if text == "":
        return df
    cells = [F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False)) for c in df.columns]
    return df.where(_any(cells))
