"""Token ids in fixed-width bit packing.

A *segment* is one self-contained file image: a header, a table of documents, a table of block
offsets, and blocks of ``block_ids`` ids, each id in the fewest bits that hold the vocabulary,
lowest bit first. Every block begins at a byte of its own, so any run of ids is read by
unpacking the blocks it touches and no others.

Segments lie in a Parquet table (one row each), since only Spark's writers are sure to reach the
shared store and to survive a lost executor; ``blob`` of a row can be saved as a file as it is.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, id_text, large_object

MAGIC = b"WTPACK01"
#: magic, bits an id, ids a block, documents, ids, first id's place in its range
HEADER = np.dtype([("magic", "S8"), ("width", "<u4"), ("block_ids", "<u4"), ("docs", "<u8"), ("ids", "<u8"), ("start", "<u8")])
BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 20
RANGES = 1024
CACHED_WORDS = 400_000
CACHED_CHARS = 64
#: new words the library sees in one text
GROUP = 64


def id_width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as a bit string, lowest bit first, filled up to a whole byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    """The first ``count`` ids of a bit string."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    raw = np.frombuffer(data + bytes(8), np.uint8)
    bit = np.arange(count, dtype=np.int64) * width
    at, shift = bit >> 3, (bit & 7).astype(np.uint64)
    word = np.zeros(count, np.uint64)
    for k in range((width + 14) // 8):
        word |= raw[at + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << width) - 1)).astype(np.uint32)


def write_segment(doc_ids: list, lengths: list[int], ids: np.ndarray, width: int, start: int, block_ids: int = BLOCK_IDS) -> bytes:
    """One segment. ``doc_ids`` may hold None."""
    head = np.array([(MAGIC, width, block_ids, len(doc_ids), len(ids), start)], HEADER)
    blocks = [pack(ids[i : i + block_ids], width) for i in range(0, len(ids), block_ids)]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join(
        [
            head.tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            known.tobytes(),
            np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype("<u8").tobytes(),
            np.concatenate(([0], np.cumsum([len(b) for b in blocks], dtype=np.int64))).astype("<u8").tobytes(),
            *blocks,
        ]
    )


class Segment:
    """A segment read from its bytes: only the tables at first, ids on demand."""

    def __init__(self, blob: bytes):
        head = np.frombuffer(blob, HEADER, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a segment of packed ids")
        self.width, self.block_ids, self.docs, self.count, self.start = (int(head[k]) for k in ("width", "block_ids", "docs", "ids", "start"))
        at = HEADER.itemsize
        doc_ids = np.frombuffer(blob, "<i8", self.docs, at)
        known = np.frombuffer(blob, np.uint8, self.docs, at + 8 * self.docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(doc_ids, known)]
        at += 9 * self.docs
        self.offsets = np.frombuffer(blob, "<u8", self.docs + 1, at).astype(np.int64)
        at += 8 * (self.docs + 1)
        blocks = -(-self.count // self.block_ids)
        self.blocks = np.frombuffer(blob, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = memoryview(blob)[at + 8 * (blocks + 1) :]

    def slice(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last`` (exclusive) of the segment; unpacks only the blocks between."""
        if last <= first:
            return np.zeros(0, np.uint32)
        low, high = first // self.block_ids, (last - 1) // self.block_ids
        parts = [
            unpack(bytes(self.payload[self.blocks[b] : self.blocks[b + 1]]), min(self.block_ids, self.count - b * self.block_ids), self.width)
            for b in range(low, high + 1)
        ]
        return np.concatenate(parts)[first - low * self.block_ids : last - low * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.offsets[k]), int(self.offsets[k + 1]))


class WordEncoder:
    """``tokenizers`` over whole texts, each distinct word encoded by the library once.

    Exact for tokenizers whose rules never join what ASCII white space separates (the caller's
    choice of file): the text is split there, and the library sees every word that is not kept.
    It sees new words in groups, with a special token between them, at which it cuts its input.
    """

    def __init__(self, spec: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.kept = Tokenizer.from_str(spec), kind, TwoGenerations(CACHED_WORDS)
        marks = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.single_word]
        self.mark, self.mark_text = marks[0] if marks else (-1, "")

    def _alone(self, words: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(c.ids, self.kind).tobytes() for c in coded]

    def _library(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word; a group in which other words hold the special token is done word by word."""
        if not self.mark_text:
            yield from self._alone(words)
            return
        groups = [words[i : i + GROUP] for i in range(0, len(words), GROUP)]
        coded = self.tokenizer.encode_batch_fast([self.mark_text.join(g) for g in groups], add_special_tokens=False)
        for group, code in zip(groups, coded):
            ids = np.array(code.ids, np.int64)
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(group) - 1:
                yield from self._alone(group)
                continue
            raw = ids.astype(self.kind).tobytes()
            size = len(raw) // max(len(ids), 1)
            at = 0
            for end in (*cuts.tolist(), len(ids)):
                yield raw[at * size : end * size]
                at = end + 1

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text of a string column; null counts as empty."""
        words = pa.compute.ascii_split_whitespace(texts.fill_null(""))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = self.kept.missing(distinct)
        young = self.kept.young
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            young.update(zip(part, self._library(part)))
        per_word = pa.array(map(young.__getitem__, distinct), pa.large_binary()).take(coded.indices)
        for w in new:
            if len(w) > CACHED_CHARS:
                del young[w]
        if not len(per_word):
            return [b""] * len(texts)
        at = np.frombuffer(per_word.buffers()[1], np.int64)[per_word.offset :]
        raw = memoryview(per_word.buffers()[2] or b"")
        rows = at[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        return [bytes(raw[a:b]) for a, b in zip(rows, rows[1:])]


def _edges(docs: DataFrame) -> np.ndarray:
    """Borders of at most ``RANGES`` ranges of doc_id with about as many rows each."""
    found = docs.agg(F.percentile_approx("doc_id", [i / RANGES for i in range(1, RANGES)], 20 * RANGES)).first()[0]
    return np.unique(np.array(found or [], np.int64))


def write_packed_ids(docs: DataFrame, path: str, tokenizer_json: str, end_id: int | None = 1) -> None:
    """Encode ``docs`` (doc_id, text) and write the ids in ascending doc_id order below ``path``.

    ``end_id`` is added to every document. A null text counts as empty. Null doc_ids come first;
    rows of one doc_id lie side by side, by the checksum of their ids. An empty table gives no segment. Rows are dealt out by
    ranges of doc_id (borders from one pass over that column) and each range is written by one
    task as a stream of segments, so memory is bound by a segment or the longest document.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    docs = id_text(docs)
    vocabulary = Tokenizer.from_str(tokenizer_json).get_vocab_size(with_added_tokens=True)
    width = id_width(max(vocabulary, (end_id or 0) + 1))
    kind = "<u2" if width <= 16 else "<u4"
    end = b"" if end_id is None else np.array([end_id], kind).tobytes()
    edges, spec = _edges(docs), spark.sparkContext.broadcast(tokenizer_json)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = large_object(f"words_{zlib.crc32(spec.value.encode())}_{kind[1:]}", lambda: WordEncoder(spec.value, kind))
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                key = part.column(0)
                ids = [x + end for x in coder.encode(part.column(1))]
                place = np.searchsorted(edges, key.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place, pa.int32()), key, pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["place", "doc_id", "tie", "ids"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number, start, held, keys, sizes, parts = None, 0, 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            nonlocal number, start, held, keys, sizes, parts
            ids = np.frombuffer(b"".join(parts), kind)
            blob = write_segment(keys, sizes, ids, width, start)
            row = [[place], [number], [len(keys)], [len(ids)], [blob]]
            number, start, held, keys, sizes, parts = number + 1, start + len(ids), 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["place", "segment", "n_docs", "n_ids", "blob"])

        size = np.dtype(kind).itemsize
        for batch in batches:
            for p, key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if p != place:
                    if keys:
                        yield close()
                    place, number, start = p, 0, 0
                keys.append(key)
                sizes.append(len(ids) // size)
                parts.append(ids)
                held += sizes[-1]
                if held >= SEGMENT_IDS:
                    yield close()
        if keys:
            yield close()

    (
        docs.mapInArrow(encode, "place int, doc_id long, tie long, ids binary")
        .repartition("place")
        .sortWithinPartitions("place", F.col("doc_id").asc_nulls_first(), "tie")
        .mapInArrow(write, "place int, segment int, n_docs long, n_ids long, blob binary")
        .write.parquet(path)
    )


def _range_starts(segments: DataFrame) -> dict[int, int]:
    """Ids before each range: one number for each of at most ``RANGES`` ranges."""
    rows = segments.groupBy("place").agg(F.sum("n_ids").alias("n")).collect()
    out, at = {}, 0
    for r in sorted(rows, key=lambda r: r["place"]):
        out[r["place"]] = at
        at += r["n"]
    return out


def read_packed_ids(segments: DataFrame) -> DataFrame:
    """Documents of a packed table: doc_id, start (ids of all documents before), ids."""
    starts = _range_starts(segments)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                seg = Segment(blob.as_py())
                ids = seg.slice(0, seg.count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seg.doc_ids, pa.int64()),
                        pa.array(seg.offsets[:-1] + seg.start + starts[place], pa.int64()),
                        pa.LargeListArray.from_arrays(pa.array(seg.offsets), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "start", "ids"],
                )

    return segments.select("place", "blob").mapInArrow(read, "doc_id long, start long, ids array<long>")


def digest_packed_ids(segments: DataFrame) -> DataFrame:
    """As ``read_packed_ids``, with n_tokens and the checksum of the ids in place of the ids."""
    starts = _range_starts(segments)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                seg = Segment(blob.as_py())
                raw = memoryview(seg.slice(0, seg.count).astype("<u4").tobytes())
                off = seg.offsets
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seg.doc_ids, pa.int64()),
                        pa.array(off[:-1] + seg.start + starts[place], pa.int64()),
                        pa.array(np.diff(off), pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1], off[1:])], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("place", "blob").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
