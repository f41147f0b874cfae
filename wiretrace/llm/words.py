"""Words of a batch of texts as numpy arrays, straight from the Arrow buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. Hashes are taken for all words of a batch
at once; words of over ``LONG`` bytes, for which a polynomial modulo 2^64 is a weak hash, are
hashed one by one.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import let_go, release, worker_cache

U = np.uint64
LONG = 256
#: bytes of text worked on at a time; a longer document is worked on alone
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: separators where only letters and digits count: every ASCII byte that is neither
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _STEP = U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93 | 1)


def pieces(batches: Iterator[pa.RecordBatch], *texts: int, size: int = PIECE, large: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of text, over all of the columns ``texts``.
    Unless the task has a ``large`` object of its own, what another one has left is let go first."""
    if not large:
        let_go()
    for batch in batches:
        sizes = [pa.compute.fill_null(pa.compute.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False) for k in texts]
        lengths = functools.reduce(np.add, (x.astype(np.int64) for x in sizes))
        at, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += int(n)
        if at < len(lengths):
            yield batch.slice(at)
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(name: str, base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^n modulo 2^64, and their inverses."""
    kept = worker_cache("powers", dict)
    if name in kept and len(kept[name][0]) > n:
        return kept[name]
    size = max(n + 1, 1 << 16)
    inverse = U(pow(int(base), -1, 1 << 64))
    made = []
    for b in (base, inverse):
        x = np.full(size, b, U)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    # those of a text longer than a piece are many times its size, and few texts need them again
    if n <= 2 * PIECE:
        kept[name] = tuple(made)
    return tuple(made)


class Words:
    """Words of a string column. ``first[d]`` to ``first[d + 1]`` are those of row d.

    With ``joined`` the bytes are moved together so that each word is followed by one space
    (within a row), and a run of words is one slice of ``data``.
    """

    def __init__(self, column: pa.Array, lower: bool = False, joined: bool = False, breaks: np.ndarray = _SPACE):
        column = column.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if lower:
            data = _LOWER[data]
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~breaks[data]
        edge = np.zeros(n + 2, bool)
        edge[offsets + 1] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[1:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[2:])) + 1
        self.first = np.searchsorted(starts, offsets).astype(np.int64)
        if joined and n:
            sizes = ends - starts
            at = np.cumsum(sizes + 1) - (sizes + 1)
            out = np.full(int(at[-1] + sizes[-1] + 9) if len(sizes) else 9, 0x20, np.uint8)
            keep = np.flatnonzero(inside[1:-1])
            out[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(keep))] = data[keep]
            data, starts, ends = out, at, at + sizes
        self.data, self.starts, self.ends = data, starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self):
            return np.zeros(0, U)
        power, inverse = _powers("bytes", _BASE, len(self.data))
        table = mix(np.arange(1, 257, dtype=U))
        total = np.zeros(len(self.data) + 1, U)
        np.cumsum(table[self.data] * power[: len(self.data)], out=total[1:])
        out = mix((total[self.ends] - total[self.starts]) * inverse[self.starts])
        for i in np.flatnonzero(self.ends - self.starts > LONG):
            out[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes(), 7)
        return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words (n - 1 fewer than words); may be used by its low bits after mix()."""
    if len(words) < n:
        return np.zeros(0, U)
    out, done, part, size, step = None, 0, words, 1, _STEP
    while True:
        if n & size:
            if out is None:
                out = part
            else:
                m = len(words) - done - size + 1
                shift = U(pow(int(_STEP), done, 1 << 64))
                out = out[:m] + part[done : done + m] * shift
            done += size
        if done == n:
            return out
        part = part[: len(part) - size] + part[size:] * step
        size, step = 2 * size, step * step


def spans_hash(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of words lo (inclusive) to hi (exclusive), for many spans."""
    power, inverse = _powers("words", _STEP, len(words))
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(U))


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its leftmost smallest one."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, size = np.arange(len(values)), 1
    while 2 * size <= width:
        a, b = place[:-size], place[size:]
        place, size = np.where(values[b] < values[a], b, a), 2 * size
    a, b = place[:n], place[width - size : width - size + n]
    return np.where(values[b] < values[a], b, a)
