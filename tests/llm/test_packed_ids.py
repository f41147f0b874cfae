"""Bit packing: round trips, random access, and the whole operator against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wiretrace.llm import packed_ids as P
from wiretrace.llm.common import scratch_path

SPEC = open(public_tokenizers.path("word_bpe_49k.json")).read()
SCHEMA = "doc_id long, text string, start string, place string"


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 25, 26, 31, 32])
def test_pack_round_trip_and_slices(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, 1000, dtype=np.uint64).astype(np.uint32)
    assert (P.unpack(P.pack(ids, width), len(ids), width) == ids).all()
    seg = P.Segment(P.write_segment([5, None, 7], [400, 0, 600], ids, width, 9, block_ids=64))
    assert seg.doc_ids == [5, None, 7] and seg.start == 9
    for a, b in [(0, 1000), (63, 65), (64, 64), (999, 1000), (100, 700)]:
        assert (seg.slice(a, b) == ids[a:b]).all()
    assert (seg.document(2) == ids[400:]).all()


def run(spark, rows, monkeypatch=None):
    path = scratch_path(spark, "test-packed")
    P.write_packed_ids(spark.createDataFrame(rows, SCHEMA), path, SPEC)
    table = spark.read.schema("place int, segment int, n_docs long, n_ids long, blob binary").parquet(path)
    return P.digest_packed_ids(table).collect(), P.read_packed_ids(table).collect()


def test_operator_equals_library(spark):
    rng = random.Random(3)
    odd = ["", None, "Don't  stop now", "<|endoftext|> x <|startoftext|>y", "é ́e ＦＵＬＬ", "a\x1cb !\x1c! \x0b\x0c", "ß ÉÑ 東京 " * 50, "word" * 5000, "12 345 👍🏽"]
    rows = [(k, odd[k % len(odd)] if k % 3 else " ".join(rng.choice(["the", "Thing", "of,", "x9"]) for _ in range(50)), "s", "p") for k in range(200)]
    rows += [(None, "no id", None, None), (7, "same id", "", "")]
    rng.shuffle(rows)
    digests, full = run(spark, rows)
    lib = Tokenizer.from_str(SPEC)
    want = sorted((-1 if k is None else k, tuple(lib.encode(t or "", add_special_tokens=False).ids) + (1,)) for k, t, _, _ in rows)
    got = sorted((-1 if r.doc_id is None else r.doc_id, tuple(r.ids)) for r in full)
    assert got == want
    at = 0
    ids = {(r.doc_id, r.start): r.ids for r in full}
    for r in sorted(digests, key=lambda r: r.start):
        assert r.start == at
        raw = np.array(ids[r.doc_id, r.start], "<u4").tobytes()
        assert r.n_tokens == len(raw) // 4 and r.ids_crc32 == zlib.crc32(raw)
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in sorted(digests, key=lambda r: r.start)]
    assert keys == sorted(keys)


def test_empty_table(spark):
    assert run(spark, []) == ([], [])


def test_small_segments(spark, monkeypatch):
    monkeypatch.setattr(P, "SEGMENT_IDS", 10)
    digests, _ = run(spark, [(k, "a b c d " * (k % 4), "", "") for k in range(50)])
    at = 0
    for r in sorted(digests, key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens) == (at, 4 * (r.doc_id % 4) + 1)
        at += r.n_tokens
