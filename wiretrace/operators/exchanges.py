"""HTTP exchange summary per source, by the shape of params rather than event names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsvalue as js
from .grouping import SOURCE_KEY


def _first(value: Column, condition: Column) -> Column:
    """``value`` at the earliest event where ``condition`` holds."""
    return F.min_by(value, F.when(condition, F.col("event_index")))


def http_exchanges(events: DataFrame) -> DataFrame:
    """The first request and response header block of every source with a ``url``.

    Events without any of the params looked at are dropped in the scan, and the
    partial aggregation keeps one candidate per source and task.
    """
    p = F.col("params")
    facts = events.where(p.isNotNull()).select(
        *SOURCE_KEY,
        "event_index",
        "time_ticks",
        js.as_string(js.field(p, "url")).alias("url"),
        js.as_string(js.field(p, "method")).alias("method"),
        js.as_string(js.field(p, "line")).alias("line"),
        js.element_texts(js.field(p, "headers")).alias("headers"),
    )
    asks = F.col("line").isNotNull() & F.col("headers").isNotNull()
    answers = F.col("line").isNull() & F.coalesce(F.get("headers", F.lit(0)).startswith("HTTP/"), F.lit(False))
    used = facts.where(F.col("url").isNotNull() | F.col("method").isNotNull() | asks | answers)
    block = F.struct("line", "headers", "time_ticks")
    summary = used.groupBy(*SOURCE_KEY).agg(
        _first(F.col("url"), F.col("url").isNotNull()).alias("url"),
        _first(F.col("method"), F.col("method").isNotNull()).alias("told_method"),
        _first(block, asks).alias("request"),
        _first(block, answers).alias("response"),
    )
    line = F.replace(F.col("request.line"), F.lit("\r\n"), F.lit(""))
    none = F.array().cast("array<string>")
    answered = F.col("response.headers")
    return summary.where("url is not null").select(
        *SOURCE_KEY,
        F.coalesce("told_method", F.substring_index(line, " ", 1), F.lit("")).alias("method"),
        "url",
        line.alias("request_line"),
        F.coalesce("request.headers", none).alias("request_headers"),
        F.get(answered, F.lit(0)).alias("status_line"),
        F.coalesce(F.slice(answered, 2, F.greatest(F.size(answered) - 1, F.lit(0))), none).alias("response_headers"),
        F.col("request.time_ticks").alias("request_ticks"),
        F.col("response.time_ticks").alias("response_ticks"),
    )


def time_to_headers(exchanges: DataFrame) -> DataFrame:
    """Ticks from request to response headers, where both were seen."""
    wait = F.col("response_ticks") - F.col("request_ticks")
    return exchanges.select(*SOURCE_KEY, wait.alias("time_to_headers")).where("time_to_headers is not null")
