"""Stored summaries against plain loops over the points."""

import random

from wiretrace.operators import pyramid

POINT = "capture_id string, series string, event_index bigint, time_ms double, value double"


def test_any_range_and_instant(spark):
    rng = random.Random(3)
    rows, clock = [], 0.0
    for i in range(300):
        # the clock steps back now and then, and once far ahead
        clock += rng.choice([-40.0, 1.0, 7.0, 30.0, 260.0]) + (1e9 if i == 200 else 0)
        rows.append(("c", rng.choice(["x", "y"]), i, clock, float(rng.randrange(-5, 50))))
    rows += [("d", "x", 0, -500.0, 3.0)]
    cell, seen, arrivals = 10.0, {}, []
    for c, s, i, at, v in rows:
        seen[c, s] = max(seen.get((c, s), at), at)
        arrivals.append((c, s, i, seen[c, s], v))
    first = spark.createDataFrame(rows, POINT)
    # two pyramids of different captures and one merged from both
    both = pyramid.series_pyramid(first.where("capture_id = 'c'"), cell, 16).unionByName(pyramid.series_pyramid(first.where("capture_id = 'd'"), cell))
    table = pyramid.merge_pyramids(both).cache()
    cells = {(c, s, a // cell) for c, s, _, a, _ in arrivals}
    assert table.where("level < 20").count() < 25 * len(cells)

    ends = [-1000.0, -500.0, 0.0, 10.0, 130.0, 2000.0, 5000.0, 1e9, 2e9]
    ranges = [(c, a, b) for c in "cd" for a in ends for b in ends if a < b]
    got = {(r.capture_id, r.series, r.start_ms, r.end_ms): (r.peak, r.total, r.n) for r in pyramid.range_summaries(table, spark.createDataFrame(ranges, "capture_id string, start_ms double, end_ms double"), cell).collect()}
    series = {"c": ["x", "y"], "d": ["x"]}
    want = {}
    for c, a, b in ranges:
        for s in series[c]:
            inside = [v for k, z, _, at, v in arrivals if (k, z) == (c, s) and a <= at < b]
            want[c, s, a, b] = (max(inside, default=None), sum(inside), len(inside))
    assert got == want
    asked = [(c, a) for c in "cd" for a in ends]
    got = {(r.capture_id, r.series, r.at_ms): r.value for r in pyramid.values_before(table, spark.createDataFrame(asked, "capture_id string, at_ms double"), cell).collect()}
    assert got == {(c, s, a): ([v for k, z, _, at, v in arrivals if (k, z) == (c, s) and at < a] or [0.0])[-1] for c, a in asked for s in series[c]}


def test_alive_at_with_all_lifetimes_in_one_block(spark):
    from wiretrace.operators import timeline

    rows = [("c", i, 64.0, 127.0) for i in range(300)] + [("c", 1000, -5.0, 1e12), ("c", 1001, 3.0, 3.0), ("d", 1, 0.0, 9.0), ("d", 2, 9.0, 4.0)]
    asked = [(c, t) for c in "cd" for t in (-6.0, -5.0, 3.0, 63.9, 64.0, 100.0, 127.0, 127.5, 1e12)]
    got = timeline.sources_active_at(
        spark.createDataFrame(rows, "capture_id string, source_id bigint, start_ms double, end_ms double"), spark.createDataFrame(asked, "capture_id string, at_ms double"), hot_rows=16
    )
    want = {(c, t, i) for c, t in asked for k, i, a, b in rows if k == c and a <= t <= b}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
