"""Decontamination: the multi-index is complete, matches equal brute force over all windows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from wiretrace.llm import window_simhash as W


def words(text):
    return [w for w in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())) if w]


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(rows, items, threshold=0.8):
    """Best window of each document and item by exact similarity alone."""
    items = [(i, words(t)) for i, t in items if words(t)]
    held = Counter(s for _, w in items for s in set(shingles(w)))
    weight = lambda s: 1 / held[s] if s in held else 1.0
    out = []
    for k, text in rows:
        w = words(text)
        for i, item in items:
            own, best = shingles(item), None
            for s in range(len(w) - len(item) + 1):
                if len(item) < 5 and len(w) != len(item):
                    continue
                other = shingles(w[s : s + len(item)])
                keys = set(own) | set(other)
                sim = sum(min(own[x], other[x]) * weight(x) for x in keys) / sum(max(own[x], other[x]) * weight(x) for x in keys)
                if sim >= threshold and (best is None or sim > best[1] + 1e-12):
                    best = (s, sim)
            if best:
                out.append((k, i, best[0], len(item), round(best[1], 9)))
    return sorted(out, key=str)


def test_multi_index_is_complete():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(6, 40))) for _ in range(80)]
    index = W.Index.build(list(range(80)), texts)
    for _ in range(300):
        fp = np.uint64(int(rng.choice(index.prints)) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(26))))
        want = np.flatnonzero(np.bitwise_count(index.prints ^ fp) <= W.RADIUS)
        assert index.near(fp).tolist() == want.tolist()


def run(spark, rows, items):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, item_id int, start string")
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(((r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)) for r in W.contaminated(docs, bench).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randrange(5, 60))) for i in range(12)] + [(50, ["Same", "four", "words", "here"])]
    items.append((60, items[0][1][:30] + text(20)))
    rows = []
    for k in range(60):
        w = text(rng.randrange(80))
        if k % 2:
            leak = list(rng.choice(items)[1])
            if rng.random() < 0.4 and len(leak) > 30:
                leak[rng.randrange(len(leak))] = "changed"
            w[len(w) // 2 : len(w) // 2] = leak
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(w).title()))
    rows += [(100, "same four, WORDS here"), (101, "same four words here too"), (None, " ".join(items[3][1])), (102, None), (103, ""), (104, " ".join(items[4][1]) + " x " + " ".join(items[4][1]))]
    rows += [rows[1], rows[1]]
    items = [(i, " ".join(t)) for i, t in items] + [(70, None), (71, ""), (72, "...")]
    assert run(spark, rows, items) == brute(rows, items)


def test_empty_and_blocks(spark, monkeypatch):
    assert run(spark, [], [(1, "a b c d e f")]) == [] and run(spark, [(1, "a b c d e f")], []) == []
    monkeypatch.setattr(W, "INDEX_BYTES", 40)
    items = [(i, " ".join(f"v{i}x{k}" for k in range(8))) for i in range(6)]
    assert run(spark, items, items) == brute(items, items)


def boilerplate(seed, n_items=120):
    """Items that share long boilerplate; documents with other boilerplate round an item's own words."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    frames = [text(200) for _ in range(2)]
    own = [text(80) for _ in range(n_items)]
    items = [(i, " ".join(frames[i % 2] + o)) for i, o in enumerate(own)]
    rows = [(i, " ".join(frames[1 - i % 2] + o)) for i, o in enumerate(own)]
    rows += [(1000 + i, " ".join(frames[i % 2] + o[:35] + text(1) + o[36:])) for i, o in enumerate(own)]
    return rows, items


def test_recall_with_shared_boilerplate(spark):
    """Weight, not words, decides what is near: of all matches by brute force none is lost."""
    rows, items = boilerplate(8)
    want = brute(rows, items)
    assert len(want) == 240 and run(spark, rows, items) == want


def test_number_of_indexes_changes_nothing(spark, monkeypatch):
    rows, items = boilerplate(9, 12)
    want = run(spark, rows, items)
    monkeypatch.setattr(W, "INDEX_BYTES", 4000)
    assert len(W.benchmark_indexes(spark.createDataFrame(items, "item_id long, text string"))) > 3
    assert run(spark, rows, items) == want == brute(rows, items)


def test_executors_need_no_package(spark):
    """What is broadcast unpickles where this package cannot be imported."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    data = cloudpickle.dumps(W.Index.build([1], ["a b c d e f g"]))
    code = "import pickle, sys; i = pickle.loads(sys.stdin.buffer.read()); assert i.ids == [1] and 'wiretrace' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], input=data, cwd="/", check=True, env={"PATH": "/usr/bin"})


def test_sample_passages(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in W.contaminated(docs, bench).collect()}
    texts = [(r.doc_id, " ".join(r.text.split())) for r in docs.collect()]
    want = {(k, r.item_id) for r in bench.collect() for k, t in texts if " ".join(r.text.split()) in t}
    assert want <= got
