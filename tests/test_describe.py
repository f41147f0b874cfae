import json
import random

import pytest
from pyspark.sql import functions as F

from literal import literal_descriptions
from wiretrace.operators import describe

KINDS = ["URL_REQUEST", "SOCKET", "UDP_SOCKET", "HOST_RESOLVER_IMPL_JOB", "DOWNLOAD", "FILESTREAM", "NONE", "HTTP_STREAM_POOL_ATTEMPT_MANAGER"]
TYPES = ["SOCKET_ALIVE", "UDP_CONNECT", "FILE_STREAM_OPEN", "DOWNLOAD_FILE_RENAMED", "DOWNLOAD_FILE_OPENED", "DOWNLOAD_ITEM_ACTIVE", "OTHER"]
PHASES = ["PHASE_BEGIN", "PHASE_END", "PHASE_NONE"]


def capture(seed, n=160, sources=24):
    rng = random.Random(seed)
    kinds = [rng.choice(KINDS) for _ in range(sources)]
    rows = []
    for i in range(n):
        source = rng.randrange(sources) if rng.random() < 0.7 else 1
        # source 0 mixes types, as events without an id do
        kind = rng.choice(KINDS) if source == 0 else kinds[source]
        params = None
        if rng.random() < 0.9:
            params = {"url": f"u{i}", "host": f"h{i}", "file_name": f"f{i}", "new_filename": f"n{i}"}
            if rng.random() < 0.8:
                params["address"] = f"a{i}"
            if rng.random() < 0.7:
                params["source_dependency"] = {"id": rng.randrange(sources), "type": 1}
            params["stream_key"] = {"destination": f"d{i}"}
        rows.append(
            dict(
                capture_id=f"c{seed}", source_id=source, source_type_name=kind, event_index=i,
                type_name=rng.choice(TYPES), phase_name=rng.choice(PHASES), params=params,
            )
        )
    return rows


@pytest.mark.parametrize("bucket", [1 << 18, 9])
def test_descriptions_equal_the_replay(spark, bucket):
    captures = [capture(seed) for seed in range(40)]
    rows = [{**e, "params": None if e["params"] is None else json.dumps(e["params"])} for c in captures for e in c]
    schema = (
        "capture_id string, source_id bigint, source_type_name string, event_index bigint, type_name string,"
        " phase_name string, params string"
    )
    df = spark.createDataFrame(rows, schema).repartition(5).withColumn("params", F.try_parse_json("params"))
    got = {(r.capture_id, r.source_id): r.description for r in describe.describe_sources(df, bucket).collect()}
    want = {(c[0]["capture_id"], s): t for c in captures for s, t in literal_descriptions(c).items()}
    assert got == want
