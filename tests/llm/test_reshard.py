"""Flows against brute force; the law, the slots and the rows of the operator."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wiretrace.llm.reshard import minimum_cost_flow, reshard


def least_cost(supply, capacity, cost):
    """Over all ways to send unit by unit."""
    units = [i for i, s in enumerate(supply) for _ in range(s)]
    slots = [j for j, c in enumerate(capacity) for _ in range(c)]
    return min(sum(cost[i][j] for i, j in zip(units, p)) for p in itertools.permutations(slots, len(units)))


def test_flow_is_optimal():
    rng = random.Random(5)
    for _ in range(40):
        n, m = rng.randrange(1, 4), rng.randrange(1, 4)
        supply = [rng.randrange(3) for _ in range(n)]
        capacity = [rng.randrange(1, 4) for _ in range(m)]
        if sum(supply) > sum(capacity) or sum(capacity) > 7:
            continue
        cost = np.array([[rng.randrange(5) for _ in range(m)] for _ in range(n)], float)
        flow = minimum_cost_flow(supply, capacity, cost)
        assert (flow.sum(1) == supply).all() and (flow.sum(0) <= capacity).all() and (flow >= 0).all()
        assert (flow * cost).sum() == least_cost(supply, capacity, cost)


def rows_of(count, seed):
    rng = random.Random(seed)
    rows = [(k, "é" * int(rng.paretovariate(0.9) * 20 % 9000), "hot" if rng.random() < 0.4 else f"s{rng.randrange(9)}", 1, "clash") for k in range(count)]
    return rows + [(None, None, None, 1, ""), (7, "x", "hot", 1, ""), (7, "x", "hot", 1, "")]


@pytest.mark.parametrize("count", [0, 3, 400, 3000])
def test_law_slots_rows(spark, count):
    data = rows_of(count, count)
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, shard int, block string")
    out, plan = reshard(docs, F.pmod(F.hash("source"), F.lit(5)), 5, 8)
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in data)
    size = Counter()
    for r in got:
        size[r.shard] += len((r.text or "").encode()) + 16
    largest, mean = max(len((r[1] or "").encode()) + 16 for r in data), sum(size.values()) / 8
    if count >= 400:
        assert max(size.values()) - mean <= max(0.02 * mean, largest / 4) and mean - min(size[k] for k in range(8)) <= max(0.02 * mean, largest / 4)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    old = Counter()
    for r in got:
        old[r.old_shard] += len((r.text or "").encode()) + 16
    if count >= 400:
        moved = sum(len((r.text or "").encode()) + 16 for r in got if r.shard != r.old_shard)
        least = sum(old.values()) - sum(min(old[k], mean) for k in range(8))
        assert moved <= least + 0.05 * sum(old.values())


def test_empty(spark):
    out, _ = reshard(spark.createDataFrame([], "doc_id long, text string, source string"), F.lit(0), 1, 4)
    assert out.collect() == []
