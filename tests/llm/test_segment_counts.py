"""Hashes, fingerprints, links and components against plain versions of their definitions."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from wiretrace.llm.components import components
from wiretrace.llm.segment_counts import fingerprint_batch, links, near_duplicates, xxh64


def plain(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_xxh64():
    rng = random.Random(1)
    blobs = [rng.randbytes(rng.choice([0, 1, 3, 4, 7, 8, 9, 12, 31, 32, 33, 64, 200])) for _ in range(2000)]
    data = np.frombuffer(b"".join(blobs) + bytes(8), np.uint8)
    ends = np.cumsum([len(b) for b in blobs])
    with np.errstate(over="ignore"):
        got = xxh64(data, ends - [len(b) for b in blobs], ends)
    assert got.tolist() == [xxhash.xxh64_intdigest(b, 42) for b in blobs]


def test_fingerprints():
    rng = random.Random(2)
    texts = ["", None, " \n", "A", "a B", "x y Z", "ÉA\x0bb"] + [" ".join(rng.choice(["The", "of", "x" * 40, "é"]) for _ in range(rng.randrange(90))) for _ in range(100)] + ["q w e " * 30000]
    assert fingerprint_batch(pa.array(texts)).tolist() == [plain(t) for t in texts]
    assert len(fingerprint_batch(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize("segments,radius", [(12, 2), (8, 2), (8, 3)])
def test_links_are_complete(spark, segments, radius):
    rng = random.Random(segments)
    seeds = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    fps = {s ^ sum(1 << b for b in set(rng.sample(range(64), rng.randrange(5)))) for s in seeds for _ in range(8)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = [tuple(sorted((r.a, r.b))) for r in links(spark.createDataFrame([(f,) for f in signed], "fp long"), segments, radius).collect()]
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius}
    assert len(got) == len(set(got)) and set(got) == want


def smallest(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(100, 140)]
    star = [(7, k) for k in range(200, 230)]
    rest = [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (120, 119)]
    edges = chain + star + rest
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [(a, b) for a, b in edges if a != b]
    nodes = {x for e in edges for x in e}
    assert got == smallest(nodes, edges)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_operator(spark):
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    rows += [(900, None), (901, ""), (902, " "), (None, rows[5][1]), (903, rows[5][1]), (903, rows[5][1])]
    rows += [(1000 + k, rows[9][1] + " tail" * k) for k in range(6)]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, fp int, links int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64), r.component_id) for r in near_duplicates(docs).collect())
    fps = [plain(t) for _, t in rows]
    group = smallest(set(fps), [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 2])
    first = {}
    for (k, _), f in zip(rows, fps):
        if k is not None:
            first[group[f]] = min(first.get(group[f], k), k)
    assert got == sorted((k is None, k or 0, f, first[group[f]]) for (k, _), f in zip(rows, fps))
    assert near_duplicates(docs.limit(0)).collect() == []
