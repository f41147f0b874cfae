"""State tables of snapshots with odd members; lists are opened once."""

from pyspark.sql import functions as F

from wiretrace.functions import jsvalue as js
from wiretrace.operators import polled as p

CLIENTS = (
    '{"reportingEnabled":true,"clients":[{"origin":"o","networkIsolationKey":[1,"k"],"groups":[{"name":"g","expires":1.5,"endpoints":['
    '{"url":"u","priority":null,"successful":{"uploads":2,"reports":1}},7,{"weight":3,"failed":5}]},"x",{"endpoints":{}}]},null,5,{"groups":[]}]}'
)
POOLS = '[{"name":"a","type":1,"nested_pools":[4,{"name":"b","nested_pools":[{"name":"c","groups":{"g":{"idle_sockets":[1,null]}}}]}]},"x",null]'


def snapshot(spark, key, text):
    rows = spark.createDataFrame([("c", key, text), ("d", key, "[]"), ("e", key, "{}")], "capture_id string, key string, json string")
    return rows.select("capture_id", "key", js.parsed(F.col("json"), "value"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_endpoints_of_odd_clients(spark):
    df = snapshot(spark, "reportingInfo", CLIENTS)
    captures = spark.createDataFrame([("c", 0.0, 1.0)], "capture_id string, time_tick_offset double, numeric_date_ms double")
    got = sorted((r.client_pos, r.group_pos, r.pos, r.network_key, r.url, r.priority, r.weight, r.uploads_succeeded, r.uploads_failed) for r in p.reporting_endpoints(df, captures).collect())
    assert got == [(0, 0, 0, "1,k", "u", "null", "1", "2 (1)", "-"), (0, 0, 1, "1,k", "", "0", "1", "-", "-"), (0, 0, 2, "1,k", "", "0", "3", "-", "-")]
    counts = p.client_row_counts(df)
    assert [tuple(r) for r in counts.collect()] == [("c", 0, 3, 3)]
    assert plan(counts).count("posexplode") == 3


def test_pools_in_pools(spark):
    pools = {tuple(r.path): (r.name, r.generation) for r in p.socket_pools(snapshot(spark, "socketPoolInfo", POOLS)).collect()}
    assert pools == {(0,): ("a ()", ""), (0, 0): (" ()", ""), (0, 1): ("b ()", ""), (0, 1, 0): ("c ()", ""), (1,): (" ()", ""), (2,): (" ()", "")}
    (group,) = p.socket_groups(snapshot(spark, "socketPoolInfo", POOLS)).collect()
    assert (list(group.path), group.pool, group.group, group.idle_sockets) == ([0, 1, 0], "c", "g", "1, null")


def test_lists_are_made_once(spark):
    captures = spark.createDataFrame([("c", 0.0, 1.0)], "capture_id string, time_tick_offset double, numeric_date_ms double")
    resolver = '{"cache":{"entries":[{"hostname":"h"}]}}'
    tables = {
        "hostResolverInfo": (p.host_cache(snapshot(spark, "hostResolverInfo", resolver), captures), 1),
        "serviceProviders": (p.service_providers(snapshot(spark, "serviceProviders", '{"service_providers":[{"name":"s"}]}')), 1),
        "quicInfo": (p.quic_sessions(snapshot(spark, "quicInfo", '{"sessions":[{"version":"v"}]}')), 1),
        "prerenderInfo": (p.prerender_history(snapshot(spark, "prerenderInfo", '{"history":[{"url":"u"}]}')), 1),
    }
    for name, (df, rows) in tables.items():
        # opening a list neither asks for its whole schema nor takes it as a VARIANT before
        opened = [line for line in plan(df).splitlines() if "Generate posexplode" in line]
        assert df.count() == rows and len(opened) == 1 and "SchemaOfVariant" not in opened[0], name
