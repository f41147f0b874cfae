"""The trie of prefixes against a plain replay."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from wiretrace.llm import prefix_rollup as P

SCHEMA = "conv_id long, turn long, role string, text string, block int, k1 string, n long, t1 int, at long, depth int"


def digest(text):
    return hashlib.md5(text.encode()).hexdigest()


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role, digest(text), text))
    return {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in convs.items()}


def brute(rows, rebuild=True):
    convs = ordered(rows)
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = tuple(convs.get(base, [])[:h] + own[h:]) if rebuild else tuple(own)
    members = defaultdict(set)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = own + sum(saved[k] for k in children[path])
    out = []
    for path, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if made[c] == path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(who), len(path), parent, len(who), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], SCHEMA)
    got = P.prefix_trie(table, **options)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in got.collect()), key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        words = ["a", "b", "ä", ""] if c % 2 else ["a"]
        for turn in range(rng.choice([1, 2, 3, 9, 17, 26])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(words)))
    rows += [(c, 0, "user", "a") for c in range(100, 130)]  # copies
    rows += [(-3, 1, "u", "x"), (-3, None, None, None), (-3, 1, "u", "x"), (-3, 1, "t", "y"), (-5, 0, "user", "a"), (None, 0, "user", "a")]
    rows += [(500, 0, "user", "long " * 200_000), (501, 0, "user", "a"), (200_000, 0, "user", "a"), (9_000_000_004, 0, "user", "a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_equals_a_replay(spark, rebuild):
    rows = conversations(3)
    assert run(spark, rows, rebuild=rebuild) == brute(rows, rebuild)


def test_turnless_and_empty(spark):
    # of conversation 6 all turns go, as its family has no first conversation
    lone = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "a"), (lone, 1, "user", "b")]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 1 and got[0][3] == 1
    assert run(spark, []) == []


def test_ranges_of_ids_make_one_digest(spark, monkeypatch):
    monkeypatch.setattr(P, "ID_RANGE", 4)
    rows = [(c, 0, "user", "same") for c in range(0, 100, 5)] + [(c, 0, "user", "") for c in range(1, 60, 7)]
    assert run(spark, rows) == brute(rows)
