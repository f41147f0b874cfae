"""Top-k by M-trees against all products, and the search of one tree."""

import random

import numpy as np
import pytest

from wiretrace.llm import mtree as M


def brute(rows, k, every):
    kept = [(i, n, np.floor(64 * np.array(v, float)).astype(np.int64)) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, n, v in kept:
        if q is None or q % every:
            continue
        best = sorted((-int(v @ w), i is not None, i or 0) for i, m, w in kept if m != n)[:k]
        out += [(q, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(best)]
    return sorted(out, key=str)


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, row int, v string")
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in M.top_products(table, **options).collect()), key=str)


def vectors(seed, n, size, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size))
    v = centres[rng.integers(0, 5, n)] + spread * rng.normal(size=(n, size))
    return [(int(i), [float(x) for x in np.float32(w)]) for i, w in zip(rng.permutation(n), v)]


@pytest.mark.parametrize("seed,n,size,spread,tree_rows", [(1, 300, 4, 0.1, 40), (2, 400, 16, 1.0, 4096), (3, 200, 2, 0.01, 16)])
def test_equals_all_products(spark, seed, n, size, spread, tree_rows):
    rows = vectors(seed, n, size, spread)
    rows += [(1000 + k, rows[0][1]) for k in range(60)] + [(1020, rows[1][1]), (1020, rows[1][1]), (None, rows[2][1]), (2000, [0.0] * size)]
    rows += [(2020, None), (2040, [None] + [0.5] * (size - 1)), (2060, [float("nan")] * size), (2080, [float("inf")] * size)]
    random.Random(seed).shuffle(rows)
    assert run(spark, rows, tree_rows=tree_rows) == brute(rows, 20, 20)


def test_few_and_none(spark):
    assert run(spark, []) == []
    rows = [(0, [0.1, 0.2]), (20, [0.3, -0.2]), (21, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows, 20, 20)
    assert run(spark, rows[:1]) == []


def test_search_skips_pages():
    rng = np.random.default_rng(5)
    centres = rng.integers(-600, 600, (8, 3))
    v = (centres[rng.integers(0, 8, 2000)] + rng.integers(-9, 9, (2000, 3))).astype(np.int64)
    longest = float((v * v).sum(1).max())
    tree = M.MTree(np.arange(2000), np.arange(2000), v, longest)
    assert tree.cuts[0] == 0 and tree.cuts[-1] == 2000 and (np.diff(tree.cuts) <= M.PAGE).all()
    queries = v[::50]
    got = tree.search(queries, np.arange(0, 2000, 50), np.full(40, np.iinfo(np.int64).min), 5)
    for n, (at, score) in zip(range(0, 2000, 50), got):
        s = v @ v[n]
        s[n] = -(1 << 62)
        want = np.lexsort((np.arange(2000), -s))[:5]
        assert at.tolist() == want.tolist() and score.tolist() == s[want].tolist()
