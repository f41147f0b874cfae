"""SimHash near-duplicates through segment popcounts.

A 64-bit fingerprint is cut into segments; the vector of the segments' bit counts is its point on
a grid. Two fingerprints differ in at least as many bits as their points are apart in Manhattan
distance, so those within ``radius`` bits are found among the grid points within ``radius``: each
fingerprint asks the points around it in one half-space (the other half asks it), and what meets
is compared bit by bit.

Texts with the same fingerprint are one class from the start, so copies cost nothing, and at most
1 + 64 + 2016 fingerprints lie within two bits of one, which bounds the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, stored
from .components import components
from .words import U, Words, pieces

SEGMENTS = 12
RADIUS = 2
SEED = 42
_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of a byte array at once (published algorithm). ``data`` needs 8 bytes
    to spare after the last slice."""
    seed = U(seed)
    lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    at, left = starts.astype(np.int64), (ends - starts).astype(np.int64)
    total = left.astype(U)
    h = np.full(len(at), seed + _P5, U)
    long = np.flatnonzero(left >= 32)
    if len(long):
        acc = [np.full(len(long), s, U) for s in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        run = np.arange(len(long))
        while len(run):
            w = long[run]
            for k in range(4):
                acc[k][run] = _round(acc[k][run], lanes[at[w] + 8 * k])
            at[w] += 32
            left[w] -= 32
            run = run[left[w] >= 32]
        x = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for a in acc:
            x = (x ^ _round(np.zeros(len(a), U), a)) * _P1 + _P4
        h[long] = x
    h += total
    for _ in range(3):
        w = np.flatnonzero(left >= 8)
        if not len(w):
            break
        h[w] = _turn(h[w] ^ _round(np.zeros(len(w), U), lanes[at[w]]), 27) * _P1 + _P4
        at[w] += 8
        left[w] -= 8
    w = np.flatnonzero(left >= 4)
    h[w] = _turn(h[w] ^ ((lanes[at[w]] & U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[w] += 4
    left[w] -= 4
    for _ in range(3):
        w = np.flatnonzero(left > 0)
        h[w] = _turn(h[w] ^ (data[at[w]].astype(U) * _P5), 11) * _P1
        at[w] += 1
        left[w] -= 1
    h = (h ^ (h >> U(33))) * _P2
    h = (h ^ (h >> U(29))) * _P3
    return h ^ (h >> U(32))


def majority_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run first[d] to first[d + 1] of hashes the 64 bits set in over half of them; an
    empty run gives zero."""
    out = np.zeros(len(first) - 1, U)
    some = np.flatnonzero(np.diff(first) > 0)
    if not len(some):
        return out
    counts = np.zeros((len(some), 64), np.int64)
    edges = first[some]
    step = 1 << 16  # rows of unpacked bits held at a time
    for a in range(0, len(hashes), step):
        b = min(a + step, len(hashes))
        lo, hi = np.searchsorted(edges, a, side="right") - 1, np.searchsorted(edges, b, side="left")
        bits = np.unpackbits(hashes[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts[lo:hi] += np.add.reduceat(bits, np.maximum(edges[lo:hi] - a, 0), axis=0, dtype=np.int32)
    set_ = counts * 2 > np.diff(first)[some][:, None]
    out[some] = np.packbits(set_, axis=1).view(">u8").ravel().astype(U)
    return out


def fingerprint_batch(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """SimHash of each text: A-Z lower-cased, shingles of words (repeats count; a text of fewer
    words is one shingle, one without words has fingerprint zero)."""
    with np.errstate(over="ignore"):
        w = Words(column, lower=True, joined=True)
        if not len(w):
            return np.zeros(len(column), U)
        sizes = np.diff(w.first)
        n = np.where(sizes >= shingle, sizes - shingle + 1, np.minimum(sizes, 1))
        first = np.concatenate(([0], np.cumsum(n)))
        lo = np.repeat(w.first[:-1] - first[:-1], n) + np.arange(first[-1])
        hi = np.minimum(lo + shingle, np.repeat(w.first[1:], n)) - 1
        return majority_bits(xxh64(w.data, w.starts[lo], w.ends[hi]), first)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (long, the fingerprint's bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprint_batch(part.column(1), shingle).view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def _fields(segments: int) -> list[tuple[int, int]]:
    """(shift, mask) of each segment."""
    edges = [64 * k // segments for k in range(segments + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


def grid_point(fp: Column, segments: int, radius: int) -> Column:
    """Bit counts of the segments as one number, each with room for steps of ``radius``."""
    width = 64 // segments
    if -(-64 // segments) + 2 * radius >= 1 << width:
        raise ValueError("too many segments for one number")
    out = F.lit(0).cast("long")
    for k, (shift, mask) in enumerate(_fields(segments)):
        mask = mask if mask < 1 << 63 else mask - (1 << 64)
        count = F.bit_count(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(mask))) + F.lit(radius)
        out = out + F.shiftleft(count.cast("long"), k * width)
    return out


def steps(segments: int, radius: int) -> list[int]:
    """Steps to all grid points within ``radius`` in Manhattan distance, of each step and its
    opposite only the positive one, and zero."""
    width, found = 64 // segments, {0}
    level = {(0,) * segments}
    for _ in range(radius):
        level = {v[:k] + (v[k] + s,) + v[k + 1 :] for v in level for k in range(segments) for s in (1, -1)}
        found |= {sum(x << (k * width) for k, x in enumerate(v)) for v in level}
    return sorted(x for x in found if x >= 0)


def links(fps: DataFrame, segments: int = SEGMENTS, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of fingerprints that differ in at most ``radius`` bits. ``fps`` has distinct
    fp. The comparison is part of the join, so only links leave it."""
    points = fps.select("fp", grid_point(F.col("fp"), segments, radius).alias("point"))
    asked = points.select(F.col("fp").alias("a"), F.explode(F.array(*[F.col("point") + F.lit(s) for s in steps(segments, radius)])).alias("point"), F.col("point").alias("own"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius
    once = (F.col("asked.point") != F.col("own")) | (F.col("a") < F.col("fp"))
    return asked.alias("asked").join(points.alias("p"), (F.col("asked.point") == F.col("p.point")) & near & once).select("a", F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, segments: int = SEGMENTS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row, and links (of its fingerprint to other ones).

    Two rows are linked if their fingerprints differ in at most ``radius`` bits; component_id is
    the smallest doc_id reachable over links. Null and empty texts have fingerprint zero and are
    linked like any other. A null doc_id is never the smallest, unless a component has no other.
    Repeated rows stay. An empty table gives no rows. 12 segments suit up to about 10^9
    fingerprints; more segments ask more points and compare fewer pairs.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    found = stored(links(classes, segments, radius), "fingerprint-links")
    parts = components(found)
    counts = found.unionAll(found.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
    linked = parts.join(classes, parts["node"] == classes["fp"])
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    member = linked.join(least, "component").join(counts, "node", "left").select("fp", "component_id", "links")
    named = classes.join(member, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "links")
