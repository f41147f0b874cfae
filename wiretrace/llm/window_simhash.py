"""Benchmark decontamination by SimHash over windows of an item's size.

A benchmark item of n words is looked for in the windows of n words of every text. Window and
item have a SimHash of their 5-word shingles, in which a shingle of weight w votes with the root
of w, so that the cosine of two votes is the share of weight in common: at the least similarity,
0.8, some ten of 64 bits differ, with a standard deviation of three, whatever the weights. Windows
whose fingerprint is within ``RADIUS`` bits of an item's are found through a multi-index: the 64 bits are cut into ``PARTS`` parts, and of
fingerprints within the radius at least one part differs in at most RADIUS // PARTS bits, so the
lists of a part's values within that many bits hold every item in reach. What is found is decided
by the exact similarity of the shingles' weights.

The weight of a shingle is one over the number of items of the whole benchmark that hold it (one,
if none does), however many indexes the items make; so each index also has the weights of all
shingles that two or more items share, 16 bytes each. The similarity of window and item is the sum of the smaller over the sum of the larger weights times
counts. A window that could not reach the threshold with all its shingles from the
items of its size counting in full is not hashed; that leaves the result as it is.

Words are of letters and digits, A-Z lower-cased.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, large_object
from .words import NOT_ALNUM, U, Words, grams, mix, pieces, spans_hash

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
PARTS = 5
#: shingles of windows hashed at a time
VOTES = 1 << 16
#: bytes of item texts that one index may hold; more items make more indexes, one after another
INDEX_BYTES = 64 << 20


def _shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the shingle that begins at each word (within a row; a row of fewer words is one
    shingle), and for each row the first shingle's place; shingles stand in word order."""
    h = words.hashes()
    sizes = np.diff(words.first)
    n = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    first = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(words.first[:-1] - first[:-1], n) + np.arange(first[-1])
    full = mix(grams(h, SHINGLE))
    if not len(full):
        full = np.zeros(1, U)
    out = full[np.minimum(at, len(full) - 1)]
    for d in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        a, b = words.first[d], words.first[d + 1]
        out[first[d]] = spans_hash(h, np.array([a]), np.array([b]))[0]
    return out, first


def voted(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingle hashes: each votes with the root of its weight. Further
    occurrences of a shingle in a row are voters of their own."""
    order = rows.argsort(1, kind="stable")
    ranked = np.take_along_axis(rows, order, 1)
    if ranked.shape[1] > 1 and (ranked[:, 1:] == ranked[:, :-1]).any():
        place = np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
        begins = np.concatenate((np.ones((len(rows), 1), bool), ranked[:, 1:] != ranked[:, :-1]), axis=1)
        nth = place - np.maximum.accumulate(np.where(begins, place, 0), axis=1)
        again = np.zeros(rows.shape, U)
        np.put_along_axis(again, order, nth.astype(U), 1)
        rows = np.where(again > 0, mix(rows + again * U(0x9E3779B97F4A7C15)), rows)
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(*rows.shape, 8), axis=2, bitorder="little")
    sums = np.einsum("rlb,rl->rb", bits, np.sqrt(weights).astype(np.float32), dtype=np.float32)
    half = np.sqrt(weights).sum(1, keepdims=True) / 2
    return np.packbits(sums > half, axis=1, bitorder="little").view(U).reshape(-1)


@dataclass
class Index:
    """Items of one index, ordered by size."""

    ids: list
    sizes: np.ndarray
    prints: np.ndarray
    shingles: list[Counter]
    weight: dict[int, float]  # weights, of its items' shingles and of all that items share
    common: np.ndarray  # shingles with a weight below one, sorted
    common_weight: np.ndarray
    known: np.ndarray  # the shingles, sorted
    known_weight: np.ndarray
    size_first: np.ndarray  # for each known shingle where its run of item_sizes begins
    item_sizes: np.ndarray  # the sizes of the items that hold a shingle, each once
    lists: list[tuple[np.ndarray, np.ndarray]]  # of each part, where each value's items within reach begin, and the items

    @staticmethod
    def build(ids: list, texts: list[str], held: dict[int, int] | None = None) -> Index:
        """``held``: how many items of the benchmark hold a shingle, for those that several do;
        counted over these items if not given."""
        with np.errstate(over="ignore"):
            w = Words(pa.array(texts, pa.string()), lower=True, breaks=NOT_ALNUM)
            hashes, first = _shingles(w)
        sizes = np.diff(w.first)
        shingles = [Counter(hashes[a:b].tolist()) for a, b in zip(first, first[1:])]
        if held is None:
            held = {h: n for h, n in Counter(h for c in shingles for h in c).items() if n > 1}
        weight = {h: 1 / n for h, n in held.items()}
        common = np.array(sorted(weight), U)
        common_weight = np.array([weight[int(h)] for h in common])
        own = {h for c in shingles for h in c}
        weight |= {h: 1.0 for h in own if h not in weight}
        known = np.array(sorted(own), U)
        prints = np.zeros(len(ids), U)
        with np.errstate(over="ignore"):
            for k, (a, b) in enumerate(zip(first, first[1:])):
                if a < b:
                    row = hashes[None, a:b]
                    prints[k] = voted(row, np.array([[weight[int(h)] for h in row[0]]]))[0]
        of: dict[int, set[int]] = {}
        for n, c in zip(sizes.tolist(), shingles):
            for h in c:
                of.setdefault(h, set()).add(n)
        runs = [sorted(of[int(h)]) for h in known]
        size_first = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int64)
        item_sizes = np.array([n for r in runs for n in r], np.int64)
        lists = []
        for shift, bits in _parts():
            own = (prints >> U(shift)) & U((1 << bits) - 1)
            values = np.arange(1 << bits, dtype=U)
            order = np.argsort(own, kind="stable")
            distinct = np.unique(own)
            groups = {int(v): order[np.searchsorted(own[order], v) : np.searchsorted(own[order], v, side="right")] for v in distinct}
            found = []
            for v in values:
                near = distinct[np.bitwise_count(distinct ^ v) <= RADIUS // PARTS]
                found.append(np.concatenate([groups[int(x)] for x in near]) if len(near) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, found)])
            lists.append((ends, np.concatenate(found).astype(np.int32)))
        return Index(ids, sizes, prints, shingles, weight, common, common_weight, known, np.array([weight[int(k)] for k in known]), size_first, item_sizes, lists)

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.ones(hashes.shape)
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        return np.where(self.common[at] == hashes, self.common_weight[at], 1.0)

    def near(self, fp: np.uint64) -> np.ndarray:
        """Items within RADIUS bits of a fingerprint."""
        found = []
        for (shift, bits), (first, items) in zip(_parts(), self.lists):
            v = int((fp >> U(shift)) & U((1 << bits) - 1))
            found.append(items[first[v] : first[v + 1]])
        items = np.unique(np.concatenate(found))
        return items[np.bitwise_count(self.prints[items] ^ fp) <= RADIUS]

    def similarity(self, window: Counter, item: int) -> float:
        other, weight = self.shingles[item], self.weight
        low = sum(min(n, other[h]) * weight[h] for h, n in window.items() if h in other)
        high = sum(n * weight.get(h, 1.0) for h, n in window.items()) + sum(n * weight[h] for h, n in other.items()) - low
        return low / high if high else 0.0


def _parts() -> list[tuple[int, int]]:
    edges = [64 * k // PARTS for k in range(PARTS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _leaks(column: pa.Array, index: Index, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """(row, item, first word, words, similarity): the best window of each row and item."""
    with np.errstate(over="ignore"):
        w = Words(column, lower=True, breaks=NOT_ALNUM)
        hashes, first = _shingles(w)
    at = np.minimum(np.searchsorted(index.known, hashes), len(index.known) - 1)
    hit = index.known[at] == hashes
    if not hit.any():
        return []
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    weights = np.array([sum(n * index.weight[h] for h, n in c.items()) for c in index.shingles])
    least = {int(n): threshold * weights[index.sizes == n].min() for n in np.unique(index.sizes) if n}
    # A shingle counts for windows of a size only if an item of that size holds it.
    place = np.flatnonzero(hit)
    known = at[place]
    count = np.diff(index.size_first)[known]
    place = np.repeat(place, count)
    size = index.item_sizes[np.repeat(index.size_first[known] - (np.cumsum(count) - count), count) + np.arange(len(place))]
    gain = np.repeat(index.known_weight[known], count)
    doc = np.searchsorted(first, place, side="right") - 1
    order = np.lexsort((place, size, doc))
    place, size, gain, doc = place[order], size[order], gain[order], doc[order]
    edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (size[1:] != size[:-1]), [True])))
    for a, b in zip(edge, edge[1:]):
        d, n = int(doc[a]), int(size[a])
        words = int(w.first[d + 1] - w.first[d])
        if gain[a:b].sum() < least[n] - 1e-9 or words < n or (n < SHINGLE and words != n):
            continue
        own = hashes[first[d] : first[d + 1]]
        votes = index.weights(own)
        length = max(1, n - SHINGLE + 1)
        at_once = max(1, VOTES // length)
        total = np.zeros(len(own) + 1)
        total[place[a:b] - first[d] + 1] = gain[a:b]
        total = np.cumsum(total)
        starts = np.flatnonzero(total[length:] - total[:-length] >= least[n] - 1e-9)
        for i in range(0, len(starts), at_once):
            some = starts[i : i + at_once]
            places = some[:, None] + np.arange(length)[None, :]
            rows = own[places]
            with np.errstate(over="ignore"):
                prints = voted(rows, votes[places])
            for s, fp, row in zip(some, prints, rows):
                items = [int(k) for k in index.near(fp) if index.sizes[k] == n]
                if items:
                    counts = Counter(row.tolist())
                    for k in items:
                        value = index.similarity(counts, k)
                        if value >= threshold and value > best.get((d, k), (0.0,))[0]:
                            best[d, k] = (value, int(s), n)
    return [(d, i, s, n, v) for (d, i), (v, s, n) in best.items()]


def _shared_shingles(items: DataFrame) -> dict[int, int]:
    """Hash of each shingle that several items hold, and how many do."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 0):
            with np.errstate(over="ignore"):
                hashes, first = _shingles(Words(part.column(0), lower=True, breaks=NOT_ALNUM))
            rows = [np.unique(hashes[a:b]) for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64))], names=["h"])

    counts = items.select("text").mapInArrow(hashed, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return {int(np.int64(r["h"]).view(U)): r["n"] for r in counts.collect()}


def benchmark_indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[Index]:
    """Indexes of at most about ``INDEX_BYTES`` of item texts each. Items without words are left
    out; items repeated in id and text count once."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // INDEX_BYTES)
    held = _shared_shingles(items) if groups > 1 else None
    out = []
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).orderBy("item_id", "text").collect()
        with_words = [r for r in rows if len(Words(pa.array([r["text"]]), breaks=NOT_ALNUM))]
        if with_words:
            out.append(Index.build([r["item_id"] for r in with_words], [r["text"] for r in with_words], held))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, digest: bool = False) -> DataFrame:
    """doc_id, item_id, start (word), n_words, similarity: for every document and item the window
    of the item's size that is most alike (the earliest of equals), if it is at least
    ``threshold``. With ``digest`` also digest (md5) of the document's text, as ids may be null
    or repeated.

    Null or empty texts and items match nothing; an item of under five words matches only a whole
    text; repeated rows repeat their matches; empty tables give no rows. Texts are read where
    they lie and nothing but matches leaves a task.
    """
    spark = docs.sparkSession
    docs, found = id_text(docs), []
    schema = "doc_id long, item_id long, start long, n_words long, similarity double"
    if digest:
        docs, schema = docs.withColumn("digest", F.md5("text")), schema + ", digest string"
    for index in benchmark_indexes(benchmark):
        # by value: executors need no copy of this package
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = large_object(f"window_index_{name}", lambda: pickle.loads(shared.value))
            for part in pieces(batches, 1, large=True):
                hits = sorted(_leaks(part.column(1), index, threshold))
                rows = pa.array([h[0] for h in hits], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(rows),
                        pa.array([index.ids[h[1]] for h in hits], pa.int64()),
                        pa.array([h[2] for h in hits], pa.int64()),
                        pa.array([h[3] for h in hits], pa.int64()),
                        pa.array([h[4] for h in hits], pa.float64()),
                        *[part.column(k).take(rows) for k in range(2, part.num_columns)],
                    ],
                    names=["doc_id", "item_id", "start", "n_words", "similarity", *part.schema.names[2:]],
                )

        found.append(docs.mapInArrow(run, schema))
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out
