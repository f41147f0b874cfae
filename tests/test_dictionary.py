"""Names looked up in shared dictionaries, against plain dictionaries per capture."""

import random

from pyspark.sql import functions as F

from wiretrace.operators import decode, dictionary, params

SCHEMA = "capture_id string, enum string, name string, id int"


def test_equal_names_share_one_dictionary(spark):
    base = [("netError", "A", 1), ("netError", "B", 1), ("loadFlag", "F", 4)]
    other = [("netError", "A", 1), ("netError", "B", 2), ("loadFlag", "F", 4)]
    rows = [(c, *e) for c, es in (("x", base), ("y", base[::-1]), ("z", other)) for e in es]
    enums = spark.createDataFrame(rows, SCHEMA)
    owned = dictionary.owners(enums)
    ids = {r[0]: r[1] for r in owned.collect()}
    assert ids["x"] == ids["y"] != ids["z"]
    assert dictionary.dictionaries(enums, owned).count() == 2


def test_names_equal_a_replay(spark):
    rng = random.Random(5)
    kinds = ("logEventTypes", "logSourceType", "logEventPhase", "netError")
    builds = [
        [(e, f"N{rng.randrange(40)}_{i}", rng.randrange(-3, 6)) for e in kinds for i in range(rng.randrange(8))] for _ in range(4)
    ]
    # capture 9 has no constants at all
    owner = {f"c{c}": builds[c % 4] for c in range(9)}
    rows = [(c, *entry) for c, entries in owner.items() for entry in entries]
    # entries without a number or a name say nothing
    rows += [("c0", "netError", "none", None), ("c0", "netError", None, 1)]
    enums = spark.createDataFrame(rows, SCHEMA)
    codes = [(f"c{c}", i, rng.randrange(-4, 7) if i % 5 else None, "kept") for c in range(10) for i in range(30)]
    events = spark.createDataFrame(codes, "capture_id string, at int, type int, id string").withColumns(
        {"source_type": F.col("type"), "phase": F.col("type")}
    )

    def names(capture, enum, code):
        return sorted(n for e, n, i in owner.get(capture, []) if e == enum and i == code)

    got = {(r.capture_id, r.at): r for r in decode.resolve_names(events, enums).collect()}
    assert len(got) == len(codes)
    for c, i, code, _ in codes:
        r = got[c, i]
        want = [(names(c, e, code) or [""])[-1] for e in kinds[:3]]
        assert [r.type_name, r.source_type_name, r.phase_name] == want and r.id == "kept"

    first = decode.decode_value(events, enums, "netError", "type", "name").collect()
    assert len(first) == len(codes)
    assert all(r.name == (names(r.capture_id, "netError", r.type) or ["?"])[0] for r in first)


def test_no_names_and_no_rows(spark):
    enums = spark.createDataFrame([], SCHEMA)
    rows = spark.createDataFrame([("c", 1)], "capture_id string, code bigint")
    assert [r.name for r in decode.decode_value(rows, enums, "netError", "code", "name").collect()] == ["?"]
    assert decode.decode_value(rows.limit(0), enums, "netError", "code", "name").count() == 0


def test_events_are_not_shuffled(spark):
    enums = spark.createDataFrame([("c", "loadFlag", "A", 1), ("c", "loadFlag", "B", 2)], SCHEMA)
    long = spark.sql(
        "SELECT 'c' AS capture_id, 1L AS source_id, id AS event_index, 'T' AS type_name, 'load_flags' AS key,"
        " parse_json(string(id)) AS value FROM range(8)"
    )
    df = params.decode_flags(long, enums)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    names = {r.bits: r.names for r in df.collect()}
    assert names == {0: "?", 1: "A", 2: "B", 3: "A | B", 4: "?", 5: "A", 6: "B", 7: "A | B"}
