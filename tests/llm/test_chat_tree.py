"""Chats as prefix trees: what is read back, and the laws of the stream."""

import hashlib
import random

import pytest

from test_prefix_rollup import SCHEMA, conversations, ordered
from wiretrace.llm import chat_tree as C

ODD = ["<|im_end|>", "<\\|im_start|>", "<\\\\|x", "\\", "a\nb", "<|<|", "<", "|", "<|im_end|>\n<|im_start|>assistant\nok", "ä<|😀"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], SCHEMA)


def chats(seed):
    rng = random.Random(seed)
    rows = conversations(seed)
    rows += [(1000 + i, k, rng.choice(["assistant", "user", *ODD]), rng.choice(ODD)) for i in range(30) for k in range(rng.choice([1, 2, 4]))]
    return rows


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = chats(5)
    path = str(tmp_path_factory.mktemp("chat") / "tree")
    C.write_chat_tree(frame(spark, rows), path)
    return rows, path


def test_digests_of_what_is_read_back(spark, built):
    rows, path = built
    got = {r.conv_id: r for r in C.digest_chats(C.read_chat_tree(spark, path)).collect()}
    convs = ordered(rows)
    assert set(got) == set(convs)
    for c, turns in convs.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_stream_is_a_depth_first_walk(spark, built):
    """Each distinct prefix is there once; what a node attends to is exactly its ancestors; its
    position is their length; the parts of a tree fill the stream, each subtree in one stretch."""
    rows, path = built
    nodes = sorted(spark.read.parquet(f"{path}/nodes").collect(), key=lambda r: (r.tree, r.start))
    convs = ordered(rows)
    prefixes = {tuple(t[:d]) for t in convs.values() for d in range(1, len(t) + 1)}
    assert len(nodes) == len(prefixes)
    at = {(r.tree, r.start): r for r in nodes}
    seen, subtree, end = set(), {}, {}
    for r in nodes:
        assert r.start == end.get(r.tree, 0) and r.end - r.start == len(r.piece)
        end[r.tree] = r.end
        above = []
        for a in r.attends:
            here = a.start
            while here < a.end:
                above.append(at[r.tree, here])
                here = above[-1].end
            assert here == a.end
        assert r.position == sum(len(x.piece) for x in above) and r.depth == len(above) + 1
        line = tuple(convs[r.chain][: r.depth])
        assert [x.piece for x in above] == [at[x.tree, x.start].piece for x in above]
        assert tuple(convs[x.chain][x.depth - 1] for x in above) == line[:-1]
        seen.add(line)
        for d in range(1, len(line) + 1):
            subtree.setdefault((r.tree, line[:d]), []).append((r.start, r.end))
    assert seen == prefixes
    for spans in subtree.values():
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    members = {r.conv_id: r.path for r in spark.read.parquet(f"{path}/members").collect()}
    assert {c: sum(p.turns for p in v) for c, v in members.items()} == {c: len(t) for c, t in convs.items()}


def test_no_control_string_inside_and_escapes_go_back(spark, built):
    rows, path = built
    for r in spark.read.parquet(f"{path}/nodes").select("piece").collect():
        assert r.piece.startswith(C.START) and r.piece.endswith(C.END + "\n")
        assert "<|" not in r.piece[len(C.START) : -len(C.END) - 1]


def test_empty_table(spark, tmp_path):
    C.write_chat_tree(frame(spark, []), str(tmp_path / "none"))
    assert C.digest_chats(C.read_chat_tree(spark, str(tmp_path / "none"))).count() == 0
