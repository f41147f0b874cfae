"""Ordered scans that never put a whole key into one task.

A plain window partitioned by capture or source sorts all rows of that key in one
task, so a single giant capture stalls the job. These scans work on two levels:
rows are cut into buckets of the order column, each bucket is scanned on its own
(one shuffle on key + bucket), and one small row per bucket carries the state
from bucket to bucket. Only that carry table is windowed by the bare key; it has
``rows / bucket_rows`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_ROWS = 1 << 18
_B = "__bucket"


def bucket_column(order: str, bucket_rows: int) -> Column:
    return F.floor(F.col(order) / F.lit(bucket_rows)).cast("bigint")


class _Step(NamedTuple):
    """One running value: ``total`` aggregates a bucket, ``carry(window)`` folds earlier
    buckets, ``local(window)`` scans inside one, ``combine(carry, local)`` joins both."""

    out: str
    value: Column
    total: Callable[[str], Column]
    carry: Callable
    local: Callable
    combine: Callable


def _upto(window, column: str, fold) -> Column:
    return fold(column).over(window.rowsBetween(Window.unboundedPreceding, 0))


def sum_step(out: str, value: Column) -> _Step:
    """Sum of ``value`` up to and including this row."""
    return _Step(
        out,
        value,
        total=F.sum,
        carry=lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)),
        local=lambda c, w: _upto(w, c, F.sum),
        combine=lambda c, x: c + x,
    )


def max_step(out: str, value: Column) -> _Step:
    """Greatest ``value`` up to and including this row."""
    return _Step(
        out,
        value,
        total=F.max,
        carry=lambda c, w: F.max(c).over(w),
        local=lambda c, w: _upto(w, c, F.max),
        combine=F.greatest,
    )


def xor_step(out: str, value: Column) -> _Step:
    """Exclusive or of ``value`` up to and including this row."""
    return _Step(
        out,
        value,
        total=F.bit_xor,
        carry=lambda c, w: F.coalesce(F.bit_xor(c).over(w), F.lit(0)),
        local=lambda c, w: _upto(w, c, F.bit_xor),
        combine=lambda c, x: c.bitwiseXOR(x),
    )


def running(
    df: DataFrame, keys: Sequence[str], order: str, steps: Sequence[_Step], bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """All running values of one key and order in a single bucket scan."""
    keys = list(keys)
    cut = df.withColumn(_B, bucket_column(order, bucket_rows))
    for i, step in enumerate(steps):
        cut = cut.withColumn(f"__v{i}", step.value)
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, _B).orderBy(order)
    numbered = list(enumerate(steps))
    totals = cut.groupBy(*keys, _B).agg(*[s.total(f"__v{i}").alias(f"__t{i}") for i, s in numbered])
    carried = totals.select(*keys, _B, *[s.carry(f"__t{i}", before).alias(f"__c{i}") for i, s in numbered])
    scanned = cut.select("*", *[s.local(f"__v{i}", inside).alias(f"__l{i}") for i, s in numbered])
    joined = scanned.join(carried, [*keys, _B])
    return joined.select(
        *df.columns, *[s.combine(F.col(f"__c{i}"), F.col(f"__l{i}")).alias(s.out) for i, s in numbered]
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    return running(df, keys, order, [sum_step(out, value)], bucket_rows)


def running_max(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    return running(df, keys, order, [max_step(out, value)], bucket_rows)


def previous_value(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Latest non-null ``value`` strictly before this row, NULL if there is none."""
    step = _Step(
        out,
        value,
        total=lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))),
        carry=lambda c, w: F.last(c, ignorenulls=True).over(w),
        local=lambda c, w: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        combine=lambda c, x: F.coalesce(x, c),
    )
    return running(df, keys, order, [step], bucket_rows)


def row_rank(
    df: DataFrame, keys: Sequence[str], order: str, out: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """1-based position of each row within its key, in ``order``."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, bucket_rows)


def first_rows(
    df: DataFrame, keys: Sequence[str], order: str, limit: int, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """The first ``limit`` rows of every key in ``order``; ``limit <= 0`` keeps all.

    The ranks are those of the bucket scan, so a hot key is ranked in many tasks.
    """
    if limit <= 0:
        return df
    ranked = row_rank(df, keys, order, "__rank", bucket_rows)
    return ranked.where(F.col("__rank") <= limit).drop("__rank")
