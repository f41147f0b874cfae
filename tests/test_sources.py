"""Grouping, filters, ranking and state tables on small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from wiretrace.functions import jsvalue as js
from wiretrace.functions.proxy import proxy_config_text
from wiretrace.operators import decode, filters, grouping, polled, ranking, scan, timeline
from wiretrace.sources import sample_tables as st


def sources(spark):
    rows = [
        ("c", 1, "URL_REQUEST", "https://example.com/", False, True, 0.0, 10.0, 0),
        ("c", 2, "SOCKET", "1.2.3.4", True, False, 5.0, 0.0, 1),
        ("c", 3, "SOCKET", "", False, True, 1000.0, 1000.0, 2),
    ]
    return spark.createDataFrame(
        rows,
        "capture_id string, source_id bigint, source_type_name string, description string, is_error boolean,"
        " is_active boolean, start_ticks double, duration double, first_event_index bigint",
    )


def ids(df):
    return sorted(r.source_id for r in df.collect())


def test_filters(spark):
    s = sources(spark)
    assert ids(filters.filter_sources(s, types=["url_request"])) == [1]
    assert ids(filters.filter_sources(s, types=[])) == []
    assert ids(filters.filter_sources(s, error=True)) == [2]
    assert ids(filters.filter_sources(s, error=False)) == [1, 3]
    assert ids(filters.filter_sources(s, ids=[2, 5])) == [2]
    assert ids(filters.filter_sources(s, texts=["EXAMPLE"])) == [1]
    assert ids(filters.filter_sources(s, exclude=[filters.filter_type(["socket"])])) == [1]
    for at, want in ((500.0, []), (1000.0, [3]), (1500.0, [3]), (2000.0, [3]), (2500.0, [])):
        assert ids(filters.filter_sources(s, at_ms=at)) == want


def test_sort_reverses_ties(spark):
    s = sources(spark)
    order = lambda by, back: [r.source_id for r in ranking.sort_sources(s, by, back).collect()]
    assert order("type", False) == [2, 3, 1] and order("type", True) == [1, 3, 2]
    assert order("active", False) == [1, 3, 2]
    assert order("nonsense", False) == [1, 2, 3]


def test_cache_miss_is_no_error(spark):
    ev = spark.createDataFrame(
        [
            ("c", 1, "X", 1, 0, 1, "HTTP_CACHE_OPEN_ENTRY", "PHASE_NONE", 1.0, -2.0),
            ("c", 2, "X", 1, 1, 1, "HTTP_CACHE_OPEN_ENTRY", "PHASE_NONE", 2.0, -3.0),
            ("c", 3, "X", 1, 2, 2, "OTHER", "PHASE_NONE", 3.0, -2.0),
            ("c", 4, "X", 1, 3, 2, "OTHER", "PHASE_NONE", 3.0, 0.0),
        ],
        "capture_id string, source_id bigint, source_type_name string, source_type int, event_index bigint, type int,"
        " type_name string, phase_name string, time_ticks double, net_error double",
    ).withColumn("start_time", F.lit(None).cast("double"))
    enums = spark.createDataFrame([("c", "netError", "ERR_FAILED", -2)], "capture_id string, enum string, name string, id int")
    assert ids(grouping.group_sources(ev, enums).where("is_error")) == [2, 3]
    assert ids(grouping.group_sources(ev).where("is_error")) == [1, 2, 3]


@pytest.mark.parametrize("parts", [1, 2, 3, 7])
def test_results_do_not_depend_on_partitions(spark, parts):
    ev = st.network_events(spark, "/root/testdata/sf0.001", with_params=False)
    whole = sorted(tuple(r) for r in grouping.group_sources(ev).collect())
    assert sorted(tuple(r) for r in grouping.group_sources(ev.repartition(parts)).collect()) == whole
    count = lambda df, b: sorted(tuple(r) for r in timeline.count_points(df, b).collect())
    assert count(ev.repartition(parts), 16) == count(ev, 1 << 18)


def test_scans_across_buckets(spark):
    rows = [("k" if i % 3 else "m", i, (i * 7) % 11 - 5) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, at bigint, v bigint").repartition(4)
    got = {}
    for name, fn in (("s", scan.running_sum), ("m", scan.running_max), ("p", scan.previous_value)):
        value = F.col("v") if name != "p" else F.when(F.col("v") > 0, F.col("v"))
        got[name] = {r["at"]: r[name] for r in fn(df, ["key"], "at", value, name, 13).collect()}
    for key in ("k", "m"):
        total, top, last = 0, None, None
        for k, at, v in rows:
            if k != key:
                continue
            total, top = total + v, v if top is None else max(top, v)
            assert (got["s"][at], got["m"][at], got["p"][at]) == (total, top, last)
            last = v if v > 0 else last
    assert scan.first_rows(df, ["key"], "at", 50).count() == 100
    assert decode.cap_events(df.selectExpr("key capture_id", "at event_index"), 1001, 13).count() == 200


def test_samples_follow_arrival_order(spark):
    points = spark.createDataFrame(
        [("c", "Open sockets", 0, 10.0, 1.0), ("c", "Open sockets", 1, 35.0, 2.0), ("c", "Open sockets", 2, 12.0, 3.0)],
        "capture_id string, series string, event_index bigint, time_ms double, value double",
    )
    windows = spark.createDataFrame([("c", 10.0)], "capture_id string, start_ms double")
    latest = timeline.sample_latest(points, windows, 10.0, 5, ["Open sockets"]).orderBy("i").collect()
    assert [r.value for r in latest] == [0.0, 1.0, 1.0, 3.0, 3.0]
    rate = timeline.sample_rate(points, windows, 10.0, 5, ["Open sockets"]).orderBy("i").collect()
    assert [r.value for r in rate] == [0.0, 100.0, 0.0, 500.0, 0.0]


def test_coercions(spark):
    text = '{"n": 5, "f": 1.5, "s": "12", "e": "", "x": "abc", "a": [1, null, [2, 3]], "o": {}, "t": true, "z": null}'
    df = spark.createDataFrame([(text,)], "j string").select(js.parsed(F.col("j"), "v"))
    one = lambda column: df.select(column.alias("c")).collect()[0]["c"]
    v = F.col("v")
    assert [one(js.to_text(js.field(v, k))) for k in "nfsaotz"] == ["5", "1.5", "12", "1,,[2,3]", "[object Object]", "true", "null"]
    assert [one(js.to_number(js.field(v, k))) for k in "nsextz"] == [5.0, 12.0, 0.0, None, 1.0, 0.0]
    assert [one(js.truthy(js.field(v, k))) for k in "nexaozq"] == [True, False, True, True, True, False, False]
    assert one(js.as_number(js.field(v, "s"))) is None and one(js.to_text(js.field(v, "q"))) is None


@pytest.mark.parametrize(
    "config,want",
    [
        ({}, "Use DIRECT connections."),
        ({"single_proxy": "1.2.3.4:8080"}, "Proxy server: 1.2.3.4:8080"),
        ({"auto_detect": True}, "Auto-detect"),
        ({"override_rules": [{"a": 1}]}, 'Override rules:\n[\n  {\n    "a": 1\n  }\n]'),
    ],
)
def test_proxy_text(spark, config, want):
    df = spark.createDataFrame([(json.dumps(config),)], "j string").select(js.parsed(F.col("j"), "v"))
    assert df.select(proxy_config_text(F.col("v"))).collect()[0][0] == want


def test_state_tables_need_their_snapshot(spark):
    blobs = [("c", "socketPoolInfo", "{}"), ("d", "reportingInfo", '{"reportingEnabled": false, "reports": [{}]}')]
    df = spark.createDataFrame(blobs, "capture_id string, key string, j string").select("capture_id", "key", js.parsed(F.col("j"), "value"))
    scalars = spark.createDataFrame([("d", 0.0, 0.0)], "capture_id string, time_tick_offset double, numeric_date_ms double")
    assert polled.socket_pools(df).count() == 0
    assert polled.reporting_reports(df, scalars).count() == 0
    assert polled.extensions(df).count() == 0


def test_parts_of_shards_equal_one_pass(spark, tmp_path):
    """1, 2, 3 and 7 shards, stored as they come and one of them twice, give the rows of one pass."""
    from wiretrace.sources.captures import read_parts, write_parts

    sf = "/root/testdata/sf0.001"
    ev = st.network_events(spark, sf).drop("params").where("source_id < 60").cache()
    enums = st.enum_rows(ev)
    want = sorted(map(str, grouping.group_sources(ev, enums).collect()))
    for n in (1, 2, 3, 7):
        folder = str(tmp_path / str(n))
        for k in reversed(range(n)):
            write_parts(ev.where(F.col("event_index") % n == k), folder, f"batch={k}")
        write_parts(ev.where(F.col("event_index") % n == 0), folder, "batch=0")
        got = grouping.sources_of_parts(read_parts(spark, folder), enums)
        assert sorted(map(str, got.collect())) == want
    ev.unpersist()
