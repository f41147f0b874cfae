"""Hard negatives against all products, and the search of one tree."""

import random

import numpy as np
import pytest

from wiretrace.llm import rtree as R


def brute(rows):
    kept = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.append((n, i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    order = lambda x: (-x[0], x[1] is not None, x[1] or 0)
    out = []
    for n, i, label, v in kept:
        if i is None or i % 100:
            continue
        others = [(sum(a * b for a, b in zip(v, w)), j, k) for m, j, k, w in kept if m != n and len(w) == len(v)]
        for p in sorted((x for x in others if x[2] == label), key=order)[:5]:
            fits = [x for x in others if x[2] != label and 80 * p[0] <= 100 * x[0] <= 100 * p[0]]
            out += [(i, p[1], r + 1, x[1], p[0], x[0]) for r, x in enumerate(sorted(fits, key=order)[:5])]
    return sorted(out, key=str)


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, v, label, 1, "x", 2, 3) for i, v, label in rows], "vec_id long, embedding array<float>, label int, row int, v string, tree int, size int")
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r[c] for c in names) for r in R.hard_negatives(table, **options).collect()), key=str)


def vectors(seed, n, size, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    v = centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, size))
    return [(int(i) * 10, [float(x) for x in np.float32(w)], int(k)) for i, w, k in zip(rng.permutation(n), v, rng.integers(0, 4, n))]


@pytest.mark.parametrize("seed,n,size,spread,tree_rows", [(1, 300, 4, 0.1, 32), (2, 500, 16, 1.0, 4096), (3, 200, 2, 0.01, 16)])
def test_equals_all_products(spark, monkeypatch, seed, n, size, spread, tree_rows):
    monkeypatch.setattr(R, "PAGE", 8)
    monkeypatch.setattr(R, "BLOCK", 5)
    rows = vectors(seed, n, size, spread)
    rows += [(5000 + k, rows[0][1], k % 3) for k in range(70)] + [(5100, rows[1][1], 2), (5100, rows[1][1], 2), (None, rows[2][1], 1), (None, rows[2][1], 0), (5200, [0.0] * size, 1)]
    rows += [(5300, None, 1), (5400, [None] + [0.5] * (size - 1), 1), (5500, [float("nan")] * size, 1), (5600, [float("inf")] * size, 1), (5700, rows[3][1], None)]
    rows += [(5800, [], 1), (5801, [], 1), (5802, [], 2), (5900, [1.0] * (size + 1), 3), (5901, [0.9] * (size + 1), 3), (5902, [0.85] * (size + 1), 1), (-700, rows[5][1], 9)]
    random.Random(seed).shuffle(rows)
    got = run(spark, rows, tree_rows=tree_rows)
    assert got == brute(rows) and len(got) > 100


def test_empty_table(spark):
    assert run(spark, []) == []


def test_bounds_hold_and_pages_are_left_out():
    rng = np.random.default_rng(4)
    v = np.floor(256 * np.concatenate([rng.normal(c, 0.05, (400, 2)) for c in ((1, 1), (-1, 1), (-1, -1), (1, -1))])).astype(np.int64)
    tree = R.RTree(np.arange(1600), np.arange(1600), np.zeros(1600, np.int64), v, page=32)
    q = v[:3]
    low, high = R.box_bounds(q, tree.low, tree.high)
    for p, (a, b) in enumerate(tree.spans):
        s = R.products(q, tree.vectors[a:b])
        assert (low[:, p] <= s.min(1)).all() and (high[:, p] >= s.max(1)).all()
    looked = []
    real = R.products
    R.products = lambda a, b: looked.append(len(b)) or real(a, b)
    try:
        hits = list(tree.search(q, np.array([0, 1, 2]), np.zeros(3, np.int64), True, [[(-(1 << 63), (1 << 63) - 1)]] * 3, 5))
    finally:
        R.products = real
    assert len(hits) == 3 and sum(x for x in looked if x == 32) < 3 * 1600 / 2


def test_integers_past_float_precision():
    a = np.array([[(1 << 30) + 1, 3]], np.int64)
    b = np.array([[(1 << 30) - 1, 5]], np.int64)
    assert R.products(a, b)[0, 0] == ((1 << 30) + 1) * ((1 << 30) - 1) + 15
