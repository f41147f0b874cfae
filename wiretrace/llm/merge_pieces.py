"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding works on an agenda: a heap of adjacent symbol pairs whose union is a piece, best score
first, then leftmost. Popping a pair joins its two symbols and puts the pairs with the new
neighbours on the agenda; pairs whose symbols have changed since are skipped when they come up.

A text is encoded in chunks, each a run of word marks and what follows up to the next mark. No
piece of a vocabulary may hold a mark after another character (checked when it is loaded), so no
merge crosses a chunk border, and a chunk seen before need not be encoded again.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import concat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame

from .common import TwoGenerations, id_text, large_object, release

MARK = "▁"
#: chunks kept twice over (see TwoGenerations), at about 150 bytes each in every Python worker
CACHED_CHUNKS = 400_000
CACHED_CHARS = 48
#: new chunks the library sees in one text
GROUP = 64
#: rows taken from an Arrow batch at a time
ROWS = 256


class MergeCoder:
    """Encoder and decoder for one model; ``check`` compares each new chunk with the library."""

    def __init__(self, model: bytes, check: bool = True):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.check = check
        size = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        if any(MARK in pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds a word mark after another character")
        self.ids = {pieces[i]: i for i in plain}
        order = {x: r for r, x in enumerate(sorted({-lib.get_score(i) for i in plain}))}
        self.rank = {pieces[i]: order[-lib.get_score(i)] for i in plain}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(lib.is_byte(i) for i in self.bytes):
            raise ValueError("the vocabulary has no byte pieces")
        self.kept = TwoGenerations(CACHED_CHUNKS)

    def merge(self, chunk: str) -> tuple[int, ...]:
        """Ids of one chunk of normalised text.

        An agenda entry is one integer: rank of the score, start, joined length. An entry is stale
        when no two adjacent symbols begin at its start and have its length together.
        """
        ids, rank = self.ids, self.rank.get
        sym = list(chunk)
        n = len(sym)
        bits = n.bit_length() + 1
        agenda = [(((r << bits) | i) << bits) | 2 for i, r in enumerate(map(rank, map(concat, sym, sym[1:]))) if r is not None]
        if agenda:
            heapify(agenda)
            low = (1 << bits) - 1
            size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                key = heappop(agenda)
                length, i = key & low, (key >> bits) & low
                j = after[i]
                if j >= n or not size[i] or size[i] + size[j] != length:
                    continue
                sym[i] = a = sym[i] + sym[j]
                sym[j], size[i], size[j] = "", length, 0
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    r = rank(a + sym[k])
                    if r is not None:
                        heappush(agenda, (((r << bits) | i) << bits) | (length + size[k]))
                h = before[i]
                if h >= 0:
                    r = rank(sym[h] + a)
                    if r is not None:
                        heappush(agenda, (((r << bits) | h) << bits) | (length + size[h]))
        out = []
        for s in sym:
            if s:
                k = ids.get(s)
                if k is None:
                    out.extend([self.bytes[b] for b in s.encode()])
                else:
                    out.append(k)
        return tuple(out)

    def chunks(self, text: str) -> list[str]:
        """Chunks of the normalised text; a chunk that begins with one mark only comes without it."""
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if MARK + MARK in marked or marked[0] == MARK or marked[-1] == MARK:
            found = re.findall(f"{MARK}+[^{MARK}]*", MARK + marked)
            return [c[1:] if c[1:2] not in (MARK, "") else c for c in found]
        return marked.split(MARK)

    def compare(self, chunks: list[str], ids: dict[str, bytes]) -> None:
        """Raise ValueError unless the library encodes every chunk as ``ids`` has it.

        Chunks without marks go as words of one text, ``GROUP`` at a time. The library puts a mark
        before each text itself; a mark alone would be no text to it. One text a call: calls with a
        list start threads of the library's own.
        """
        encode = self.lib.encode
        plain = [c for c in chunks if MARK not in c]
        groups = [plain[i : i + GROUP] for i in range(0, len(plain), GROUP)]
        groups += [[c] for c in chunks if MARK in c and c != MARK]
        for group in groups:
            text = " ".join(group)
            got = array("I", encode(text[1:] if text[0] == MARK else text)).tobytes()
            if got != b"".join(map(ids.__getitem__, group)):
                raise ValueError(f"the library encodes some of {[c[:80] for c in group]!r} in another way")

    def coded(self, column: pa.Array) -> pa.ListArray:
        """The ids of each text of a string column (null: none)."""
        text = column.fill_null("")
        pc = pa.compute
        # Runs of blanks, blanks at the ends and marks in the text itself need more than a split.
        odd = [pc.match_substring(text, "  "), pc.match_substring(text, MARK), pc.starts_with(text, " "), pc.ends_with(text, " ")]
        odd = functools.reduce(pc.or_, odd)
        own = {i: self.chunks(text[i].as_py()) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        split = pc.split_pattern(pc.if_else(odd, "", text), " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        seen = set(distinct)
        seen.update(*own.values())
        seen.discard("")
        new = self.kept.missing(seen)
        young, merge = self.kept.young, self.merge
        young[""] = b""
        for c in new:
            young[c] = array("I", merge(c if c[0] == MARK else MARK + c)).tobytes()
        if self.check:
            self.compare(new, young)
        per_word = pa.array(map(young.__getitem__, distinct), pa.large_binary()).take(words.indices)
        at = np.frombuffer(per_word.buffers()[1], np.int64)[per_word.offset :] // 4 if len(per_word) else np.zeros(1, np.int64)
        ids = np.frombuffer(per_word.buffers()[2] or b"", np.int32)
        edges = at[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if own:
            parts = [ids[a:b] for a, b in zip(edges, edges[1:])]
            for i, chunks in own.items():
                parts[i] = np.frombuffer(b"".join(map(young.__getitem__, chunks)), np.int32)
            ids = np.concatenate(parts)
            edges = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        for c in new:
            if len(c) > CACHED_CHARS:
                del young[c]
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids[: edges[-1]], pa.int32()))

    def encode(self, texts: list) -> list[list[int]]:
        """The ids of each text."""
        return _lists(self.coded(pa.array(texts, pa.string())))


def _lists(ids: pa.ListArray) -> list[list[int]]:
    """As Python lists; faster than to_pylist()."""
    flat, at = ids.values.to_numpy().tolist(), ids.offsets.to_numpy().tolist()
    return [flat[a:b] for a, b in zip(at, at[1:])]


def _decimal(ids: pa.ListArray) -> pa.Array:
    """Each list as decimal numbers, comma-joined."""
    return pa.compute.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), ",")


def _lengths(ids: pa.ListArray) -> pa.Array:
    return pa.compute.list_value_length(ids).cast(pa.int64())


def _coded(docs: DataFrame, model: bytes, check: bool, schema: str, rows) -> DataFrame:
    """``rows`` makes the columns after doc_id from the coder and the ids of some texts."""
    spec = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pieces_{zlib.crc32(spec.value)}_{check}"
        coder = large_object(name, lambda: MergeCoder(spec.value, check))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                columns = rows(coder, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields))], names=["doc_id", *(n for n, _ in fields)])
        release()

    return id_text(docs).mapInArrow(run, f"doc_id long, {schema}")


def encode_pieces(docs: DataFrame, model: bytes, check: bool = True) -> DataFrame:
    """doc_id and ids (array of int) of every text, as ``sentencepiece`` encodes it without begin
    and end ids. A null or empty text has no ids; repeated rows stay; an empty table stays empty.
    """

    def rows(coder: MergeCoder, texts: pa.Array) -> list:
        return [coder.coded(texts)]

    return _coded(docs, model, check, "ids array<int>", rows)


def round_trip_pieces(docs: DataFrame, model: bytes, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (text: decimal, comma-joined) and decoded (the library's decode(ids))."""

    def rows(coder: MergeCoder, texts: pa.Array) -> list:
        ids = coder.coded(texts)
        return [_lengths(ids), _decimal(ids), [coder.lib.decode(x) for x in _lists(ids)]]

    return _coded(docs, model, check, "n_tokens long, ids string, decoded string", rows)


def digest_pieces(docs: DataFrame, model: bytes, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 (lowercase hex) of the ids' text and of the decoded text."""

    def rows(coder: MergeCoder, texts: pa.Array) -> list:
        ids = coder.coded(texts)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return [_lengths(ids), [sha(x) for x in _decimal(ids).to_pylist()], [sha(coder.lib.decode(x)) for x in _lists(ids)]]

    return _coded(docs, model, check, "n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
