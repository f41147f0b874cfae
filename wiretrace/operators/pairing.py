"""BEGIN/END pairing of one source's events, as Arrow functions over sorted partitions.

Rows arrive grouped by source (or by source and chunk) and in file order, so the
state is one stack of open BEGINs per group. A source too large for one task is
cut into chunks of consecutive events:

* inside a chunk, an END that meets its BEGIN with no *undecided* END in between is
  decided whatever happened before the chunk. :func:`undecided` keeps the rest: ENDs
  that may reach into earlier chunks, BEGINs still open, one marker per chunk;
* :func:`decide` runs the stack over those few rows of all chunks in order;
* :func:`pair` then runs each chunk again, with the decisions for it at hand.

All three stream: memory holds the open BEGINs, not the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

BEGIN, END, OTHER = 1, 2, 0
# row kinds of the small tables that pass between the steps
MARK, ITEM = 0, 1
_FLUSH = 20_000

UNDECIDED_SCHEMA = (
    "capture_id string, source_id bigint, chunk bigint, kind int, event_index bigint, type int, phase int,"
    " time_ticks double, has_params boolean, prev_index bigint, last_index bigint"
)
DECIDED_SCHEMA = (
    "capture_id string, source_id bigint, chunk bigint, kind int, event_index bigint,"
    " top_index bigint, depth int, prev_index bigint,"
    " mate_index bigint, mate_ticks double, mate_params boolean, adjacent boolean"
)
PAIRED_SCHEMA = (
    "capture_id string, source_id bigint, event_index bigint, depth int, parent_index bigint, begin_index bigint,"
    " end_index bigint, end_ticks double, collapsible boolean, hidden boolean"
)

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


class _Out:
    """Rows collected into record batches of a fixed schema."""

    def __init__(self, ddl: str):
        parts = [p.split() for p in ddl.split(",")]
        self._schema = pa.schema([(n, _ARROW[t]) for n, t in parts])
        self._rows: list[tuple] = []

    def add(self, *row) -> None:
        self._rows.append(row)

    def take(self, at_least: int = _FLUSH) -> Iterator[pa.RecordBatch]:
        if self._rows and len(self._rows) >= at_least:
            columns = zip(*self._rows)
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, self._schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=self._schema)
            self._rows = []


class _OpenBegins:
    """Stack of open BEGINs that finds the nearest one of a type in constant time."""

    def __init__(self):
        self.items: list[tuple] = []  # (event_index, type, ticks, has_params, chunk)
        self._at: dict[int, list[int]] = {}

    def push(self, item: tuple) -> None:
        self._at.setdefault(item[1], []).append(len(self.items))
        self.items.append(item)

    def close(self, kind: int) -> list[tuple]:
        """Remove the nearest BEGIN of ``kind`` and all above it; the match comes last."""
        places = self._at.get(kind)
        if not places:
            return []
        target = places[-1]
        closed = []
        while len(self.items) > target:
            item = self.items.pop()
            self._at[item[1]].pop()
            closed.append(item)
        return closed

    def top(self) -> int | None:
        return self.items[-1][0] if self.items else None


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    for batch in batches:
        yield list(zip(*[batch.column(n).to_pylist() for n in names]))


_EVENT = ["capture_id", "source_id", "chunk", "event_index", "type", "phase", "time_ticks", "has_params"]


def undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each chunk that the chunk alone cannot decide, and its marker."""
    out = _Out(UNDECIDED_SCHEMA)
    group = None
    kept: list[tuple] = []  # undecided ENDs and the BEGINs left below them
    opened = _OpenBegins()
    last = None

    def finish() -> None:
        if group is None:
            return
        out.add(*group, MARK, -1, None, None, None, None, None, last)
        for row in (*kept, *opened.items):
            index, kind, ticks, params, prev, phase = row
            out.add(*group, ITEM, index, kind, phase, ticks, params, prev, None)

    for rows in _rows(batches, _EVENT):
        for capture, source, chunk, index, kind, phase, ticks, params in rows:
            if (capture, source, chunk) != group:
                finish()
                group, kept, opened, last = (capture, source, chunk), [], _OpenBegins(), None
            if phase == BEGIN:
                opened.push((index, kind, ticks, params, last, BEGIN))
            elif phase == END and not opened.close(kind):
                # may close BEGINs below and so decides over all that is open here
                kept += opened.items
                kept.append((index, kind, ticks, params, last, END))
                opened = _OpenBegins()
            last = index
        yield from out.take()
    finish()
    yield from out.take(1)


_UNDECIDED = [
    "capture_id", "source_id", "chunk", "kind", "event_index", "type", "phase", "time_ticks", "has_params",
    "prev_index", "last_index",
]


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run the stack over the undecided rows of each source, chunk by chunk.

    Gives, for markers and undecided ENDs, the open BEGIN on top and the depth after
    them; for undecided ENDs their BEGIN; for BEGINs closed from a later row, that END.
    """
    out = _Out(DECIDED_SCHEMA)
    group = None
    opened = _OpenBegins()
    before = carried = None
    for rows in _rows(batches, _UNDECIDED):
        for capture, source, chunk, kind, index, type_, phase, ticks, params, prev, last in rows:
            if (capture, source) != group:
                group, opened, carried = (capture, source), _OpenBegins(), None
            if kind == MARK:
                before, carried = carried, last
                out.add(*group, chunk, MARK, -1, opened.top(), len(opened.items), before, None, None, None, None)
                continue
            prev = before if prev is None else prev
            if phase == BEGIN:
                opened.push((index, type_, ticks, params, chunk))
                continue
            closed = opened.close(type_)
            for b_index, _, _, _, b_chunk in closed:
                out.add(*group, b_chunk, ITEM, b_index, None, None, None, index, ticks, params, b_index == prev)
            mate = closed[-1] if closed else None
            out.add(
                *group, chunk, ITEM, index, opened.top(), len(opened.items), None,
                mate and mate[0], None, mate and mate[3], bool(mate) and mate[0] == prev,
            )
        yield from out.take()
    yield from out.take(1)


_PAIR = [*_EVENT, "kind", "top_index", "depth", "prev_index", "mate_index", "mate_ticks", "mate_params", "adjacent"]


def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth, parent and partner of every event.

    A chunk's decisions (``kind`` not null) come before its events. A group without
    a marker is a whole source: nothing was open before it.
    """
    out = _Out(PAIRED_SCHEMA)
    group = None
    opened = _OpenBegins()
    told: dict[int, tuple] = {}
    places: dict[int, tuple] = {}  # open BEGIN -> (depth, parent)
    chunked = False
    base_top, base_depth, last = None, 0, None

    def finish() -> None:
        # BEGINs left open here: closed by a later chunk, or never
        for index, (depth, parent) in places.items():
            later = told.get(index)
            if later is None:
                out.add(*group[:2], index, depth, parent, None, None, None, False, False)
            else:
                _, _, mate, mate_ticks, mate_params, adjacent, params = later
                flat = adjacent and not (params and mate_params)
                out.add(*group[:2], index, depth, parent, None, mate, mate_ticks, flat, False)

    for rows in _rows(batches, _PAIR):
        for (
            capture, source, chunk, index, kind, phase, ticks, params,
            row_kind, top, depth, prev, mate, mate_ticks, mate_params, adjacent,
        ) in rows:
            if (capture, source, chunk) != group:
                if group is not None:
                    finish()
                group, opened, told, places = (capture, source, chunk), _OpenBegins(), {}, {}
                chunked, base_top, base_depth, last = False, None, 0, None
            if row_kind == MARK:
                chunked, base_top, base_depth, last = True, top, depth, prev
                continue
            if row_kind == ITEM:
                told[index] = (top, depth, mate, mate_ticks, mate_params, adjacent, None)
                continue
            begin, flat_end = None, False
            if phase == END:
                closed = opened.close(kind)
                for b_index, _, _, b_params, _ in closed:
                    b_depth, b_parent = places.pop(b_index)
                    flat = b_index == last and not (b_params and params)
                    out.add(capture, source, b_index, b_depth, b_parent, None, index, ticks, flat, False)
                if closed:
                    begin = closed[-1][0]
                    flat_end = begin == last and not (closed[-1][3] and params)
                elif chunked:
                    # what is still open in this chunk waits for the decision on this END
                    base_top, base_depth, begin, _, begin_params, beside, _ = told[index]
                    flat_end = bool(beside) and not (begin_params and params)
                    opened = _OpenBegins()
            parent = opened.top() if opened.items else base_top
            here = base_depth + len(opened.items)
            if phase == BEGIN:
                places[index] = (here, parent)
                opened.push((index, kind, ticks, params, chunk))
                if index in told:
                    told[index] = (*told[index][:6], params)
            else:
                out.add(capture, source, index, here, parent, begin, None, None, False, flat_end)
            last = index
        yield from out.take()
    if group is not None:
        finish()
    yield from out.take(1)
