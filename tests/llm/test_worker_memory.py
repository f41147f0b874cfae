"""What Python workers keep from task to task, and how much text they take at a time."""

import gc
import pickle
import weakref

import numpy as np
import pyarrow as pa

from wiretrace.llm.common import large_object, let_go, worker_cache
from wiretrace.llm.window_simhash import Index
from wiretrace.llm.words import PIECE, Words, pieces


class Big:
    pass


def test_one_large_object():
    a = large_object("a", Big)
    assert large_object("a", Big) is a
    gone = weakref.ref(a)
    del a
    b = large_object("b", Big)
    assert gone() is None
    batch = pa.RecordBatch.from_arrays([pa.array(["x", None])], names=["t"])
    assert sum(p.num_rows for p in pieces(iter([batch]), 0, large=True)) == 2 and large_object("b", Big) is b
    gone = weakref.ref(b)
    del b
    # a task without a large object begins
    assert sum(p.num_rows for p in pieces(iter([batch]), 0)) == 2
    gc.collect()
    assert gone() is None
    let_go()


def test_pieces_count_all_texts():
    # many short texts, each beside a long one
    short, long = ["ab"] * 40 + [None], ["x" * (PIECE // 4)] * 40 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(41)), pa.array(short), pa.array(long)], names=["k", "s", "t"])
    parts = list(pieces(iter([batch]), 1, 2))
    assert [k for p in parts for k in p.column(0).to_pylist()] == list(range(41))
    assert max(p.num_rows for p in parts) <= 4


def test_powers_of_long_texts_are_not_kept():
    text = ("one two " * (3 * PIECE // 8 + 1)).strip()
    with np.errstate(over="ignore"):
        w = Words(pa.array([text]))
        first = w.hashes()
        again = Words(pa.array(["one two"])).hashes()
    assert first[:2].tolist() == again.tolist()
    assert len(worker_cache("powers", dict)["bytes"][0]) <= 2 * PIECE + 1


def test_index_is_small():
    index = Index.build([1, 2], ["a b c d e f g", "h i j k l m n o"])
    assert len(pickle.dumps(index)) < 1_000_000
    for item, fp in enumerate(index.prints):
        assert item in index.near(fp).tolist()
