import random

import pytest

from literal import literal_counts, literal_pairs
from wiretrace.operators import timeline, trace

SCHEMA = (
    "capture_id string, source_id bigint, source_type_name string, event_index bigint, type int, type_name string,"
    " phase_name string, time_ticks double, time_ms double, has_params boolean"
)
TYPES = ["SOCKET_ALIVE", "SOCKET_IN_USE", "SSL_CONNECT", "OTHER"]


def random_events(seed, n=400, hot=0.6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = 1 if rng.random() < hot else rng.randint(2, 6)
        kind = rng.choice([0, 0, 1, 2, 3]) if source != 2 else rng.randint(0, 3)
        phase = rng.choices(["PHASE_BEGIN", "PHASE_END", "PHASE_NONE"], [0.42, 0.4, 0.18])[0]
        rows.append(
            dict(
                capture_id="c", source_id=source, source_type_name="SOCKET" if source != 3 else "URL_REQUEST",
                event_index=i, type=kind, type_name=TYPES[kind], phase_name=phase, time_ticks=float(i * 2),
                time_ms=float(i * 2), has_params=rng.random() < 0.5,
            )
        )
    return rows


@pytest.mark.parametrize("seed,chunk", [(1, 1000), (2, 7), (3, 3), (4, 50), (5, 1), (6, 20)])
def test_match_begin_end_equals_the_loop(spark, seed, chunk):
    rows = random_events(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {
        (r.source_id, r.event_index): (
            r.depth, r.parent_index, r.begin_index, r.end_index, r.end_ticks, r.collapsible, r.hidden
        )
        for r in trace.match_begin_end(df, chunk).collect()
    }
    want = literal_pairs(rows)
    assert len(got) == len(rows)
    assert got == want


@pytest.mark.parametrize("seed,bucket", [(11, 1000), (12, 5), (13, 37)])
def test_active_counts_equal_the_loop(spark, seed, bucket):
    rows = random_events(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    points = timeline.active_count(df, "SOCKET", "SOCKET_ALIVE", bucket).collect()
    wanted = lambda e: e["source_type_name"] == "SOCKET" and e["type_name"] == "SOCKET_ALIVE"
    assert sorted((r.event_index, r.value) for r in points) == literal_counts(rows, wanted)
    used = timeline.sockets_in_use(df, bucket).collect()
    wanted = lambda e: e["source_type_name"] == "SOCKET" and e["type_name"] == "SOCKET_IN_USE"
    assert sorted((r.event_index, r.value) for r in used) == literal_counts(rows, wanted, ssl=True)


def test_find_matches_values(spark):
    df = spark.createDataFrame([(1, "abc ABC a.c")], "id int, text string")

    def spans(*args, **kw):
        return sorted((r.match_start, r.match_end) for r in trace.find_matches(df, "text", *args, **kw).collect())

    assert spans("abc") == [(0, 3), (4, 7)]
    assert spans("abc", case_sensitive=True) == [(0, 3)]
    assert spans("a.c") == [(8, 11)]
    assert spans("a.c", use_regex=True) == [(0, 3), (4, 7), (8, 11)]
    assert spans("^", use_regex=True) == []
    assert trace.check_pattern("(", True)
    with pytest.raises(ValueError):
        trace.find_matches(df, "text", "(", use_regex=True)


def test_trace_search_cap_and_flag(spark):
    rows = [("c", 1, i, "aa") for i in range(4)] + [("c", 2, 9, "a")]
    df = spark.createDataFrame(rows, "capture_id string, source_id bigint, event_index bigint, text string")
    got = trace.trace_search(df, "a", max_matches=3, bucket_rows=2).collect()
    first = sorted((r.event_index, r.match_start) for r in got if r.source_id == 1)
    assert first == [(0, 0), (0, 1), (1, 0)]
    assert {(r.source_id, r.truncated) for r in got} == {(1, True), (2, False)}


def test_search_sees_param_lines_and_maps_offsets(spark):
    """A match across line ends, in the row and below it; with and without a cap."""
    key = "capture_id string, source_id bigint, event_index bigint"
    shown = spark.createDataFrame([("c", 1, 3, "+REQUEST  [dt=5]"), ("c", 1, 7, " DONE"), ("c", 2, 4, "+REQUEST")], f"{key}, text string")
    lines = spark.createDataFrame(
        [("c", 1, 3, "url", 0, "url = x/REQUEST"), ("c", 1, 3, "headers", 1, "b: 2"), ("c", 1, 3, "headers", 0, "a: 1"), ("c", 1, 9, "url", 0, "REQUEST of a hidden event")],
        f"{key}, key string, line_no int, line string",
    )
    text = {1: "+REQUEST  [dt=5]\na: 1\nb: 2\nurl = x/REQUEST\n DONE", 2: "+REQUEST"}
    for cap, want in ((None, [(1, 3, 0, 1), (1, 3, 3, 8), (2, 4, 0, 1)]), (1, [(1, 3, 0, 1), (2, 4, 0, 1)])):
        got = trace.trace_search(shown, "request", max_matches=cap, lines=lines, bucket_rows=2).collect()
        assert sorted((r.source_id, r.event_index, r.line_no, r.line_start) for r in got) == want
        assert all(text[r.source_id][r.text_start :][:7] == "REQUEST" for r in got)
        assert {r.source_id: r.truncated for r in got} == {1: cap == 1, 2: False}
    across = trace.trace_search(shown, r"1\nb: \d", use_regex=True, lines=lines).collect()
    assert [(r.line_no, r.line_start, r.text_start) for r in across] == [(1, 3, text[1].index("1\nb"))]


def test_a_clock_jump_is_past_the_grid(spark):
    points = spark.createDataFrame([("c", "s", 0, 10.0, 5.0), ("c", "s", 1, 1e17, 7.0)], "capture_id string, series string, event_index bigint, time_ms double, value double")
    windows = spark.createDataFrame([("c", 0.0)], "capture_id string, start_ms double")
    got = timeline.sample_rate(points, windows, 5.0, 20, ["s"]).where("value <> 0").collect()
    assert [(r.i, r.value) for r in got] == [(3, 1000.0)]
