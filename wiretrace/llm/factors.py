"""Duplicate passages by relative Lempel-Ziv parsing.

Every document is factored against all earlier text. The reference is cut into blocks at
content-defined places: of the 8-word hashes inside each window of 20 words the leftmost smallest
one is its anchor, so equal windows have the same anchor at the same offset, wherever they are.
The block of an anchor is the text of all windows that it serves.

1. Index: per anchor hash, in how many places it is, whether all its blocks are equal, and the
   first document (hash aggregation with fixed-width buffers, combined before the shuffle).
2. Parse: blocks that are in the index more than once become factors: all windows of a block
   repeat earlier text unless it is the first. Consecutive factors grow into one span, greedily.
3. Boundaries: where a factor ends, a block is equal to others only in part. Of blocks with equal
   contents the first one's windows are compared one by one, again by aggregation.

Only candidates are shuffled: two bitmaps of fixed size (repeated anchors, anchors of unequal
blocks) are built in slices and given to the tasks that read the texts a second time. When they
fill up, more rows are shuffled, with the same result.

Words are compared by 64-bit hashes of 8-word anchors and of block or window contents together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, stored
from .words import U, Words, grams, leftmost_minimum, mix, pieces, spans_hash

WINDOW = 20
ANCHOR = 8
#: size of a bitmap: 2^26 bits are 8 MB, whatever the input
BITS = 26
SLICES = 256
NO_ID = -(1 << 63)


class Blocks:
    """The anchors of a batch of texts with the windows they serve."""

    def __init__(self, words: Words, window: int, anchor: int):
        self.words, self.window = words, window
        self.hash = words.hashes()
        n = len(words)
        last = np.repeat(words.first[1:], np.diff(words.first))
        found = mix(grams(self.hash, anchor))
        place = leftmost_minimum(found, window - anchor + 1)
        whole = np.flatnonzero(np.arange(len(place)) + window <= last[: len(place)]) if n >= window else np.zeros(0, np.int64)
        place = place[whole] if len(whole) else whole
        begin = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (whole[1:] != whole[:-1] + 1)))) if len(whole) else whole
        end = np.concatenate((begin[1:], [len(whole)])).astype(np.int64) if len(whole) else whole
        self.lo, self.hi = (whole[begin], whole[end - 1] + 1) if len(whole) else (whole, whole)  # first window, after the last
        at = place[begin] if len(whole) else whole
        self.anchor = found[at] if len(whole) else np.zeros(0, U)
        self.content = mix(spans_hash(self.hash, self.lo, self.hi + window - 1) + (at - self.lo).astype(U)) if len(whole) else np.zeros(0, U)
        self.row = np.searchsorted(words.first, self.lo, side="right") - 1

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and contents of the windows of some blocks."""
        sizes = (self.hi - self.lo)[which]
        first = np.repeat(self.lo[which] - (np.cumsum(sizes) - sizes), sizes)
        at = first + np.arange(int(sizes.sum()))
        return at, spans_hash(self.hash, at, at + self.window)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64), pa.int64())


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of a column of hashes; each slice is made by one group, all slices have a fixed size."""
    size = (1 << BITS) // SLICES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            part, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(part):
                held.setdefault(int(p), np.zeros(size, bool))[bit[part == p]] = True
        for p, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

    place = F.shiftrightunsigned("anchor", 64 - BITS)
    rows = (
        hashes.select((place / size).cast("int").alias("part"), (place % size).cast("int").alias("bit"))
        .dropDuplicates()
        .repartition("part")
        .mapInArrow(fill, "part int, bits binary")
        .collect()
    )
    out = np.zeros((SLICES, size // 8), np.uint8)
    for r in rows:
        out[r["part"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> U(64 - BITS)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Runs of repeated windows per document: doc_id, digest, runs (array of struct<lo, hi>).

    A window repeats if its words also start earlier: in a row with a smaller doc_id, or earlier in
    the same row. ``digest`` is XXH64 of the text; rows with the same doc_id and different texts
    are different documents of which neither is earlier. Null doc_ids come first.
    """
    spark = docs.sparkSession
    docs = id_text(docs)
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in pieces(batches, 1):
                b = Blocks(Words(part.column(1)), window, anchor)
                yield pa.RecordBatch.from_arrays([_long(b.anchor), _long(b.content), _long(part.column(0).to_numpy()[b.row])], names=["anchor", "content", "doc_id"])

    found = stored(
        keyed.select("doc_id", "text")
        .mapInArrow(index, "anchor long, content long, doc_id long")
        .groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"), F.min("doc_id").alias("ref"))
        .where("n > 1")
        .select("anchor", "ref", (F.col("low") == F.col("high")).alias("equal")),
        "factor-index",
    )
    repeated, unequal = (spark.sparkContext.broadcast(_bitmap(found.where(c))) for c in ("equal", "not equal"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in pieces(batches, 2):
                b = Blocks(Words(part.column(2)), window, anchor)
                keys, digests, first = part.column(0).to_numpy(), part.column(1).to_numpy(), b.words.first
                equal, edge = _has(repeated.value, b.anchor), _has(unequal.value, b.anchor)
                which = np.concatenate((np.flatnonzero(equal), np.flatnonzero(edge)))
                n_equal = int(equal.sum())
                _, content = b.windows(which[n_equal:])
                sizes = np.where(np.arange(len(which)) < n_equal, 0, (b.hi - b.lo)[which])
                row = b.row[which]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(len(which)) >= n_equal),
                        _long(np.concatenate((b.anchor[which[:n_equal]], b.content[which[n_equal:]]))),
                        _long(keys[row]),
                        _long(digests[row]),
                        _long(b.lo[which] - first[row]),
                        _long(b.hi[which] - first[row]),
                        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), _long(content)),
                    ],
                    names=["edge", "code", "doc_id", "digest", "lo", "hi", "windows"],
                )

    marks = stored(keyed.mapInArrow(candidates, "edge boolean, code long, doc_id long, digest long, lo long, hi long, windows array<long>"), "factor-candidates")
    blocks = found.where("equal").select(F.col("anchor").alias("code"), "ref")
    whole = marks.where("not edge").drop("edge", "windows").join(blocks, "code").withColumn("single", F.lit(False))
    # Of equal contents among unequal blocks all but those of the first document repeat in whole;
    # the earliest place of every window is in one that is left, so only those are taken apart.
    edges = marks.where("edge").drop("edge")
    edges = stored(edges.join(edges.groupBy("code").agg(F.min("doc_id").alias("ref")), "code"), "factor-boundaries")
    later = edges.where("doc_id <> ref").drop("windows").withColumn("single", F.lit(False))
    singles = edges.where("doc_id = ref").select("doc_id", "digest", "lo", F.posexplode("windows").alias("at", "code")).select("code", "doc_id", "digest", (F.col("lo") + F.col("at")).alias("lo"))
    windows = singles.groupBy("code").agg(F.count("*").alias("n"), F.min("doc_id").alias("ref")).where("n > 1").select("code", "ref")
    parts = singles.join(windows, "code").withColumns({"hi": F.col("lo") + 1, "single": F.lit(True)})
    hits = whole.unionByName(later).unionByName(parts)
    # In the first document of a code only its earliest place is new, so the code goes along.
    return (
        hits.groupBy("doc_id", "digest")
        .agg(
            F.collect_list(F.when(F.col("doc_id") != F.col("ref"), F.struct("lo", "hi"))).alias("later"),
            F.collect_list(F.when(F.col("doc_id") == F.col("ref"), F.struct("code", "single", "lo", "hi"))).alias("own"),
        )
        .select("doc_id", "digest", "later", "own")
    )


def _spans(later: list, own: list, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word spans (lo, hi) covered by repeated windows, joined greedily, in order."""
    runs = [(r["lo"], r["hi"]) for r in later]
    first: dict = {}
    for r in own:
        key = (r["code"], r["single"])
        first[key] = min(first.get(key, r["lo"]), r["lo"])
    runs += [(r["lo"], r["hi"]) for r in own if r["lo"] > first[r["code"], r["single"]]]
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = np.array(sorted(runs), np.int64)
    lo, hi = runs[:, 0], np.maximum.accumulate(runs[:, 1] + window - 1)
    begin = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
    return lo[begin], hi[np.concatenate((begin[1:] - 1, [len(lo) - 1]))]


def remove_repeated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, spans (array of struct<lo, hi>, in words), kept
    (its kept words, joined by one space).

    Every word inside a repeated window goes. A null or empty text has no words. Rows equal in
    doc_id and text get equal results; see ``repeated_windows`` for ties. A document's marks and
    text meet in one row, so memory is bound by the longest document.
    """
    both = id_text(docs).withColumns({"key": F.coalesce("doc_id", F.lit(NO_ID)), "digest": F.xxhash64(F.coalesce("text", F.lit("")))})
    runs = repeated_windows(docs, window, anchor).withColumnRenamed("doc_id", "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            w = Words(part.column(1), joined=True)
            total, removed, spans, kept = [], [], [], []
            for d, (later, own) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                a, b = int(w.first[d]), int(w.first[d + 1])
                lo, hi = _spans(later or [], own or [], window)
                total.append(b - a)
                removed.append(int((hi - lo).sum()))
                spans.append([{"lo": int(x), "hi": int(y)} for x, y in zip(lo, hi)])
                runs = zip([a, *(a + hi)], [*(a + lo), b])
                kept.append(b" ".join(w.data[w.starts[x] : w.ends[y - 1]].tobytes() for x, y in runs if y > x).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    return (
        both.join(runs, ["key", "digest"], "left")
        .select("doc_id", "text", "later", "own")
        .mapInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<struct<lo: long, hi: long>>, kept string")
    )
