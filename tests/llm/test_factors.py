"""Passage removal against a plain replay of its definition."""

import random

import pytest

from wiretrace.llm.factors import remove_repeated


def replay(rows, window):
    """rows: (doc_id, text); the rule word by word."""
    first = {}
    split = [((-1 << 63) if k is None else k, (t or "").encode().split()) for k, t in rows]
    for k, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (k, i)), (k, i))
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (k, i):
                gone.update(range(i, i + window))
        out.append((k, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def run(spark, rows, window, anchor):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, lo int, digest string")
    return sorted(((-1 << 63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeated(docs, window, anchor).collect())


def corpus(seed, letters, docs, longest):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(letters)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(3, 60))] for _ in range(8)]
    rows = []
    for k in range(docs):
        w = []
        while len(w) < rng.randrange(longest):
            w += rng.choice(shared) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randrange(12))]
        rows.append((k * 3, rng.choice([" ", "\n ", "\t"]).join(w)))
    rows += [(None, rows[3][1]), (10_000, rows[3][1]), (10_000, rows[3][1]), (10_001, None), (10_002, ""), (10_003, "spam " * 200), (10_004, "spam " * 90 + "x"), (10_005, "ab " * 70)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,letters,window,anchor", [(1, 3, 6, 2), (2, 40, 20, 8), (3, 2, 5, 3)])
def test_equals_replay(spark, seed, letters, window, anchor):
    rows = corpus(seed, letters, 60, 150)
    assert run(spark, rows, window, anchor) == replay(rows, window)


def test_empty_and_whole_sample(spark):
    assert run(spark, [], 20, 8) == []
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert run(spark, rows, 20, 8) == replay(rows, 20)
