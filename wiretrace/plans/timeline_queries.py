"""Time series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import grouping as g
from ..operators import pyramid as py
from ..operators import timeline as t
from ..session import checkpoint_dir
from .base import EV, SRC, events, query

STEP, N = 900_000.0, 96  # a day in quarter hours


def _count_cte(name, where):
    return f"""{name}_lag AS (SELECT *, lag(phase_name) OVER (PARTITION BY capture_id, source_id ORDER BY event_index) AS was
      FROM ev WHERE phase_name <> 'PHASE_NONE' AND ({where})),
    {name}_delta AS (SELECT *, CASE WHEN phase_name = 'PHASE_BEGIN' AND coalesce(was, '') <> 'PHASE_BEGIN' THEN 1
      WHEN phase_name = 'PHASE_END' AND was = 'PHASE_BEGIN' THEN -1 ELSE 0 END AS d FROM {name}_lag),
    {name} AS (SELECT capture_id, event_index, time_ms,
      CAST(sum(d) OVER (PARTITION BY capture_id ORDER BY event_index) AS DOUBLE) AS value FROM {name}_delta WHERE d <> 0)"""


_SERIES_WHERE = {
    "Open sockets": "source_type_name = 'SOCKET' AND type_name = 'SOCKET_ALIVE'",
    "In-use sockets": "(source_type_name = 'SOCKET' AND type_name = 'SOCKET_IN_USE') OR (type_name = 'SSL_CONNECT' AND phase_name = 'PHASE_END')",
    "URL requests": "source_type_name = 'URL_REQUEST' AND type_name = 'REQUEST_ALIVE'",
    "DNS jobs": "source_type_name = 'HOST_RESOLVER_IMPL_JOB' AND type_name = 'HOST_RESOLVER_IMPL_JOB'",
}
_BYTES = """bytes AS (SELECT capture_id, event_index, time_ms,
  CASE WHEN type_name IN ('SOCKET_BYTES_RECEIVED', 'UDP_BYTES_RECEIVED') THEN 'Bytes received'
    WHEN type_name IN ('SOCKET_BYTES_SENT', 'UDP_BYTES_SENT') THEN 'Bytes sent'
    WHEN type_name = 'ENTRY_READ_DATA' THEN 'Disk cache read' ELSE 'Disk cache write' END AS series,
  CASE WHEN source_type_name = 'DISK_CACHE_ENTRY' THEN bytes_copied ELSE byte_count END AS value
  FROM ev WHERE byte_count IS NOT NULL
    OR (phase_name = 'PHASE_END' AND type_name IN ('ENTRY_READ_DATA', 'ENTRY_WRITE_DATA') AND bytes_copied <> 0))"""
_WINDOWS = "windows AS (SELECT capture_id, arg_min(time_ms, event_index) AS start_ms FROM ev GROUP BY 1)"


def _grid_cte(n=N, step=STEP):
    return f"""grid AS (SELECT capture_id, CAST(i AS INTEGER) AS i, start_ms + i * {step} AS sample_ms
      FROM windows, range({n}) r(i))"""


def _counts_cte():
    parts = [_count_cte(f"c{i}", where) for i, where in enumerate(_SERIES_WHERE.values())]
    union = " UNION ALL ".join(f"SELECT '{s}' AS series, * FROM c{i}" for i, s in enumerate(_SERIES_WHERE))
    return ", ".join([*parts, f"counts AS ({union})"])


# a sample takes the last point strictly before it; a rate sums the step before it
_SAMPLED_COUNTS = """(SELECT g.capture_id, s.series, g.i, g.sample_ms, coalesce(p.value, 0.0) AS value, 'count' AS kind
  FROM grid g CROSS JOIN (SELECT DISTINCT series FROM counts) s
  ASOF LEFT JOIN counts p ON p.capture_id = g.capture_id AND p.series = s.series AND p.time_ms < g.sample_ms)"""


def _sampled_rates(step=STEP):
    return f"""(SELECT g.capture_id, s.series, g.i, any_value(g.sample_ms) AS sample_ms,
      1000.0 * coalesce(sum(b.value), 0.0) / {step} AS value, 'rate' AS kind
      FROM grid g CROSS JOIN (SELECT DISTINCT series FROM bytes) s
      LEFT JOIN bytes b ON b.capture_id = g.capture_id AND b.series = s.series
        AND b.time_ms >= g.sample_ms - {step} AND b.time_ms < g.sample_ms
      GROUP BY g.capture_id, s.series, g.i)"""


def _fixed(value, digits):
    # half up on the shortest decimal text of the double
    return f"printf('%.{digits}f', CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 15)), {digits}) AS DOUBLE))"


def _windows(ev):
    return t.timeline_range(ev).select("capture_id", "start_ms")


def _count_query(name, series):
    source_type, event_type = t.COUNT_SERIES[series]

    @query(
        name,
        f"{EV}, {_count_cte('c', _SERIES_WHERE[series])} SELECT capture_id, event_index, time_ms, value FROM c",
    )
    def run(spark, sf_dir):
        return t.active_count(events(spark, sf_dir), source_type, event_type).drop("series", "arrival_ms")


_count_query("active_count_open_sockets", "Open sockets")
_count_query("active_count_url_requests", "URL requests")
_count_query("active_count_dns_jobs", "DNS jobs")


@query(
    "sockets_in_use",
    f"{EV}, {_count_cte('c', _SERIES_WHERE['In-use sockets'])} SELECT capture_id, event_index, time_ms, value FROM c",
)
def sockets_in_use(spark, sf_dir):
    return t.sockets_in_use(events(spark, sf_dir)).drop("series", "arrival_ms")


@query(
    "sample_latest",
    f"""{EV}, {_counts_cte()}, {_WINDOWS}, {_grid_cte()}
    SELECT capture_id, series, i, sample_ms, value FROM {_SAMPLED_COUNTS} q""",
)
def sample_latest(spark, sf_dir):
    ev = events(spark, sf_dir)
    return t.sample_latest(t.count_points(ev), _windows(ev), STEP, N, list(t.COUNT_SERIES))


def _rate_query(name, series, run):
    query(
        name,
        f"""{EV}, {_BYTES}, {_WINDOWS}, {_grid_cte()}
        SELECT capture_id, series, i, sample_ms, round(value, 6) AS value FROM {_sampled_rates()} q WHERE series = '{series}'""",
    )(run)


def _rounded(df):
    return df.withColumn("value", F.round("value", 6))


def _network(direction):
    def run(spark, sf_dir):
        ev = events(spark, sf_dir)
        return _rounded(t.network_rate(ev, direction, _windows(ev), STEP, N))

    return run


def _cache(op):
    def run(spark, sf_dir):
        ev = events(spark, sf_dir)
        return _rounded(t.disk_cache_rate(ev, op, _windows(ev), STEP, N))

    return run


_rate_query("network_rate_received", "Bytes received", _network("received"))
_rate_query("network_rate_sent", "Bytes sent", _network("sent"))
_rate_query("disk_cache_rate_read", "Disk cache read", _cache("read"))
_rate_query("disk_cache_rate_write", "Disk cache write", _cache("write"))

_ALL = f"""{EV}, {_counts_cte()}, {_BYTES}, {_WINDOWS}, {_grid_cte()},
  samples AS (SELECT * FROM {_SAMPLED_COUNTS} q UNION ALL SELECT * FROM {_sampled_rates()} q)"""


@query(
    "series_all",
    f"{_ALL} SELECT capture_id, series, kind, i, sample_ms, round(value, 6) AS value FROM samples",
)
def series_all(spark, sf_dir):
    ev = events(spark, sf_dir)
    return _rounded(t.series_all(ev, _windows(ev), STEP, N))


@query("series_peak", f"{_ALL} SELECT capture_id, kind, round(max(value), 6) AS peak FROM samples GROUP BY 1, 2")
def series_peak(spark, sf_dir):
    ev = events(spark, sf_dir)
    return t.series_peak(t.series_all(ev, _windows(ev), STEP, N)).withColumn("peak", F.round("peak", 6))


@query(
    "timeline_range",
    f"""{EV} SELECT capture_id, CASE WHEN arg_max(time_ms, event_index) <= arg_min(time_ms, event_index)
      THEN arg_max(time_ms, event_index) - 1 ELSE arg_min(time_ms, event_index) END AS start_ms,
    arg_max(time_ms, event_index) AS end_ms, 1000.0 AS step_ms FROM ev GROUP BY 1""",
)
def timeline_range(spark, sf_dir):
    return t.timeline_range(events(spark, sf_dir))


@query(
    "values_at",
    f"""{EV}, {_counts_cte()}, {_BYTES},
    windows AS (SELECT capture_id, arg_min(time_ms, event_index) + 43200000.0 AS start_ms FROM ev GROUP BY 1),
    {_grid_cte(1, 3600000.0)},
    samples AS (SELECT * FROM {_SAMPLED_COUNTS} q UNION ALL SELECT * FROM {_sampled_rates(3600000.0)} q)
    SELECT capture_id, series, kind, sample_ms, round(value, 6) AS value, CASE
      WHEN kind = 'count' THEN {_fixed('value', 0)} WHEN value >= 1048576 THEN {_fixed('value / 1048576', 1)} || ' MB/s'
      WHEN value >= 1024 THEN {_fixed('value / 1024', 1)} || ' kB/s' ELSE {_fixed('value', 0)} || ' B/s' END AS shown
    FROM samples""",
)
def values_at(spark, sf_dir):
    ev = events(spark, sf_dir)
    noon = _windows(ev).withColumn("start_ms", F.col("start_ms") + 43200000.0)
    return _rounded(t.values_at(ev, noon, 3600000.0))


CELL = 1000.0
# every hour of a capture, from its first whole second
_HOURS = f"""hours AS (SELECT capture_id, floor(arg_min(time_ms, event_index) / {CELL}) * {CELL} + h * 3600000.0 AS start_ms
  FROM ev, range(24) r(h) GROUP BY capture_id, h),
  pts AS (SELECT capture_id, series, event_index, time_ms, value FROM counts
    UNION ALL SELECT capture_id, series, event_index, time_ms, value FROM bytes),
  asked AS (SELECT h.*, s.series FROM hours h JOIN (SELECT DISTINCT capture_id, series FROM pts) s USING (capture_id))"""


def _pyramid(spark, sf_dir):
    """The summaries of all series as a stored table, and the hours asked for."""
    ev = events(spark, sf_dir)
    points = t.count_points(ev).drop("arrival_ms").unionByName(t.byte_points(ev))
    folder = f"{checkpoint_dir(spark)}/pyramid-{uuid.uuid4().hex}"
    py.series_pyramid(points, CELL).write.parquet(folder)
    first = F.floor(F.col("start_ms") / CELL) * CELL
    hours = _windows(ev).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return spark.read.parquet(folder), hours.select("capture_id", (first + F.col("h") * 3600000.0).alias("start_ms"))


@query(
    "series_ranges_stored",
    f"""{EV}, {_counts_cte()}, {_BYTES}, {_HOURS}
    SELECT a.capture_id, a.series, a.start_ms, round(max(p.value), 6) AS peak, round(coalesce(sum(p.value), 0), 6) AS total, count(p.value) AS n
    FROM asked a LEFT JOIN pts p ON p.capture_id = a.capture_id AND p.series = a.series
      AND p.time_ms >= a.start_ms AND p.time_ms < a.start_ms + 3600000 GROUP BY ALL""",
)
def series_ranges_stored(spark, sf_dir):
    pyramid, hours = _pyramid(spark, sf_dir)
    got = py.range_summaries(pyramid, hours.withColumn("end_ms", F.col("start_ms") + 3600000.0), CELL)
    return got.drop("end_ms").withColumns({c: F.round(c, 6) for c in ("peak", "total")})


@query(
    "values_before_stored",
    f"""{EV}, {_counts_cte()}, {_BYTES}, {_HOURS}
    SELECT a.capture_id, a.series, a.start_ms AS at_ms, coalesce(p.value, 0) AS value
    FROM asked a ASOF LEFT JOIN pts p ON p.capture_id = a.capture_id AND p.series = a.series AND p.time_ms < a.start_ms
    WHERE a.series IN ('{"', '".join(_SERIES_WHERE)}')""",
)
def values_before_stored(spark, sf_dir):
    pyramid, hours = _pyramid(spark, sf_dir)
    got = py.values_before(pyramid, hours.withColumnRenamed("start_ms", "at_ms"), CELL)
    return got.where(F.col("series").isin(*t.COUNT_SERIES))


_ACTIVE_AT = f"""{SRC}, instants AS (SELECT capture_id, arg_min(time_ms, event_index) + h * 3600000.0 AS at_ms
      FROM ev, range(24) r(h) GROUP BY capture_id, h)
    SELECT i.capture_id, at_ms, source_id FROM instants i JOIN src ON src.capture_id = i.capture_id
      AND start_ticks <= at_ms AND at_ms <= end_ticks"""


@query("sources_active_at", _ACTIVE_AT)
def sources_active_at(spark, sf_dir, cell_ms=1.0):
    ev = events(spark, sf_dir)
    sources = g.group_sources(ev).select(
        "capture_id", "source_id", F.col("start_ticks").alias("start_ms"), F.col("end_ticks").alias("end_ms")
    )
    hours = F.explode(F.sequence(F.lit(0), F.lit(23)))
    instants = (
        _windows(ev).withColumn("h", hours).select("capture_id", (F.col("start_ms") + F.col("h") * 3600000.0).alias("at_ms"))
    )
    return t.sources_active_at(sources, instants, cell_ms)


@query("sources_active_at_fine", _ACTIVE_AT)
def sources_active_at_fine(spark, sf_dir):
    """Lifetimes of days in cells of a millionth of a millisecond."""
    return sources_active_at(spark, sf_dir, 1e-6)


@query(
    "format_rate",
    f"""SELECT o_orderkey, CASE WHEN o_totalprice * 10 >= 1048576 THEN {_fixed('o_totalprice * 10 / 1048576', 1)} || ' MB/s'
      WHEN o_totalprice * 10 >= 1024 THEN {_fixed('o_totalprice * 10 / 1024', 1)} || ' kB/s'
      ELSE {_fixed('o_totalprice * 10', 0)} || ' B/s' END AS shown FROM orders""",
)
def format_rate(spark, sf_dir):
    from ..functions.text import format_rate as rate

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", rate(F.lit("rate"), F.col("o_totalprice") * 10).alias("shown"))
