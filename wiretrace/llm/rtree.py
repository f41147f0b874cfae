"""Hard negatives by best-first search over STR-packed R-trees.

Components become integers, x -> floor(256 x); scores are exact integer inner products.

Packing (sort-tile-recursive). Rows are cut into slabs by label and one coordinate, sorted inside
a slab by a second one over the cluster, and cut in that order into trees of ``TREE_ROWS`` rows;
inside a tree the two coordinates of the widest spread tile the rows into pages. A page keeps its
minimum bounding box and its labels. An inner product with an anchor lies, coordinate by
coordinate, between the products with the box's two sides; their sums bound the scores in a box.

Search, for anchors in blocks against trees: pages wait in a queue with their upper bounds, the
best first. One is skipped if it cannot hold a wanted label, or if its interval lies outside every
score window or strictly below every k-th score found (an equal score may win by a smaller id);
when the best bound is strictly below all those, the search ends. First each anchor's positives
are found, then the negatives in each positive's window.

Trees are grouped into at most ``GROUPS`` stretches whose bounding boxes go to all tasks; a block
of anchors meets only groups that may hold something for it, by an equi-join. A task holds one
block and one tree.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no
part; an empty vector has score 0 with other empty ones; vectors of different lengths never meet;
rows that share an id are rows of their own; a null id is no anchor, is not relabelled and sorts
before all others; equal rows all count; other columns are not looked at; an empty table gives no
rows. Scores are exact while sums of products stay below 2^63.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 256
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
POSITIVES = NEGATIVES = 5
#: a negative's score in hundredths of its positive's
LOWEST, HIGHEST = 80, 100
TREE_ROWS, PAGE, BLOCK, GROUPS, SLABS = 4096, 128, 128, 1024, 64
TREES_A_RANGE = 4
NO_ID = -(1 << 63)
_FLOAT_EXACT = 1 << 52


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T for integers: by floats where these are exact, else by integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < _FLOAT_EXACT else a @ b.T


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``q`` with a point of each box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


class RTree:
    """Pages over rows of one vector length: labels, ids and vectors in page order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, vectors: np.ndarray, page: int = PAGE):
        n, size = vectors.shape
        order = np.arange(n)
        if size and n > page:
            wide = np.argsort(-(vectors.max(0).astype(float) - vectors.min(0)), kind="stable")[:2]
            strips = int(np.ceil(np.sqrt(n / page)))
            order = np.argsort(vectors[:, wide[0]], kind="stable")
            per = -(-n // strips)
            order = np.concatenate([s[np.argsort(vectors[s, wide[-1]], kind="stable")] for s in (order[i : i + per] for i in range(0, n, per))])
        self.ids, self.rows, self.labels, self.vectors = ids[order], rows[order], labels[order], vectors[order]
        cuts = np.arange(0, n, page)
        self.spans = [(int(a), int(min(a + page, n))) for a in cuts]
        self.low, self.high = np.minimum.reduceat(self.vectors, cuts), np.maximum.reduceat(self.vectors, cuts)
        self.labels_of = [np.unique(self.labels[a:b]) for a, b in self.spans]

    def search(self, anchors: np.ndarray, own: np.ndarray, labels: np.ndarray, same: bool, windows: list, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(anchor, window, places, scores): of the rows of the anchor's label (or of the others)
        the k best with a score in the window, ties to the smaller id, without row ``own``.
        ``windows``: for each anchor a list of (least, most)."""
        least, most = box_bounds(anchors, self.low, self.high)
        for a in range(len(anchors)):
            open_ = windows[a]
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in open_]
            floor = [w[0] for w in open_]
            queue = [(-int(u), p) for p, u in enumerate(most[a])]
            heapq.heapify(queue)
            while queue and open_:
                upper, page = heapq.heappop(queue)
                if -upper < min(floor):
                    break  # all others are lower still
                held = self.labels_of[page]
                if (labels[a] not in held) if same else (len(held) == 1 and held[0] == labels[a]):
                    continue
                wanted = [w for w in range(len(open_)) if floor[w] <= -upper and least[a, page] <= open_[w][1]]
                if not wanted:
                    continue
                i, j = self.spans[page]
                scores = products(anchors[a : a + 1], self.vectors[i:j])[0]
                fits = ((self.labels[i:j] == labels[a]) == same) & (self.rows[i:j] != own[a])
                for w in wanted:
                    take = np.flatnonzero(fits & (scores >= floor[w]) & (scores <= open_[w][1]))
                    if len(take):
                        at, s = np.concatenate((found[w][0], take + i)), np.concatenate((found[w][1], scores[take]))
                        keep = np.lexsort((self.rows[at], self.ids[at], -s))[:k]
                        found[w] = at[keep], s[keep]
                        if len(keep) == k:
                            floor[w] = max(floor[w], int(s[keep[-1]]))
            for w, (at, s) in enumerate(found):
                if len(at):
                    yield a, w, at, s


def _blob(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v, "<i8").tobytes()


def _rows(blob: bytes, size: int, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<i8").reshape(n, size)


TREES = "tree long, size int, n int, ids array<long>, rows array<long>, labels array<long>, vectors binary, low array<long>, high array<long>, label_low long, label_high long"


def pack_trees(rows: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Trees (``TREES``) over ``rows`` (vec_id, row, label, v), stored."""
    first, second = F.coalesce(F.try_element_at("v", F.lit(1)), F.lit(0)), F.coalesce(F.try_element_at("v", F.lit(2)), F.lit(0))
    # slabs by label and first coordinate; equal vectors may lie in several trees
    edges = rows.agg(F.percentile_approx(first, [i / SLABS for i in range(1, SLABS)], 1000).alias("e")).first()["e"] or []
    slab = F.lit(0)
    for e in sorted(set(edges)):
        slab = slab + (first > e).cast("int")
    parts = max(1, -(-rows.count() // (tree_rows * TREES_A_RANGE)))
    order = ["size", "label", "slab", "second", "row"]
    tiles = rows.select(F.size("v").alias("size"), "label", slab.alias("slab"), second.alias("second"), "vec_id", "row", "v")
    tiles = tiles.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = pa.schema(
        [("tree", pa.int64()), ("size", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("vectors", pa.binary()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("label_low", pa.int64()), ("label_high", pa.int64())]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = None

        def tree() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                ids, row, label = (t.column(c).to_numpy() for c in ("vec_id", "row", "label"))
                v = np.concatenate([np.asarray(c.flatten().to_numpy()) for c in t.column("v").chunks]).reshape(len(ids), size)
                low, high = (v.min(0), v.max(0)) if size else (v[0], v[0])
                yield pa.RecordBatch.from_pydict({"tree": [0], "size": [size], "n": [len(ids)], "ids": [ids], "rows": [row], "labels": [label], "vectors": [_blob(v)], "low": [low], "high": [high], "label_low": [label.min()], "label_high": [label.max()]}, schema)
                held.clear()

        for batch in batches:
            sizes = batch.column("size").to_numpy()
            at = 0
            while at < batch.num_rows:
                if sizes[at] != size:
                    yield from tree()
                    size = int(sizes[at])
                run = int(np.searchsorted(sizes[at:], size, "right"))
                take = min(run, tree_rows - sum(b.num_rows for b in held))
                held.append(batch.slice(at, take))
                at += take
                if sum(b.num_rows for b in held) == tree_rows:
                    yield from tree()
        yield from tree()

    packed = tiles.mapInArrow(pack, TREES).withColumn("tree", F.monotonically_increasing_id())
    return stored(packed, "r-trees")


ASKS = "part int, size int, queries array<long>, ids array<long>, labels array<long>, vectors binary, positive_ids array<array<long>>, positive_scores array<array<long>>"
HITS = "query long, anchor_id long, slot int, positive_id long, positive_score long, vec_id long, row long, score long"


def windows_of(positive_scores: list[int]) -> list[tuple[int, int]]:
    """The scores that a negative may have beside each positive."""
    return [(-(-LOWEST * s // 100), HIGHEST * s // 100) for s in positive_scores]


def _searched(trees: DataFrame, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """Hits (``HITS``) of ``asks`` (query, vec_id, label, v, positives) in all trees that may hold
    some: rows of the anchor's label and any score if ``same``, else of other labels in windows."""
    # neighbouring ranges of the packing order make a group
    at = F.shiftright("tree", 33)
    last = trees.agg(F.max(at).alias("m")).first()["m"]
    groups = min(GROUPS, (last or 0) + 1)
    grouped = trees.withColumn("part", F.floor(at * groups / ((last or 0) + 1)).cast("int"))
    sides = grouped.select("part", "size", "label_low", "label_high", F.posexplode_outer(F.arrays_zip("low", "high")).alias("j", "x"))
    sides = sides.groupBy("part", "size", "j").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"), F.min("label_low").alias("a"), F.max("label_high").alias("b")).collect()
    boxes: dict[tuple[int, int], list] = {}
    for r in sorted(sides, key=lambda r: (r["part"], r["size"], r["j"] or 0)):
        boxes.setdefault((r["part"], r["size"]), []).append((r["low"], r["high"], r["a"], r["b"]))
    bounds = {}
    for (part, size), of in boxes.items():
        bounds.setdefault(size, []).append((part, [x[0] for x in of][:size], [x[1] for x in of][:size], min(x[2] for x in of), max(x[3] for x in of)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("part", pa.int32()), ("size", pa.int32()), ("queries", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("vectors", pa.binary()), ("positive_ids", pa.list_(pa.list_(pa.int64()))), ("positive_scores", pa.list_(pa.list_(pa.int64())))])

        def made(rows: list[dict], size: int) -> Iterator[pa.RecordBatch]:
            if size not in bounds:
                return
            v = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), size)
            labels = np.array([r["label"] for r in rows])
            parts, low, high, a, b = zip(*bounds[size])
            least, most = box_bounds(v, np.array(low, np.int64).reshape(len(parts), size), np.array(high, np.int64).reshape(len(parts), size))
            a, b = np.array(a), np.array(b)
            if same:
                open_ = (labels[:, None] >= a) & (labels[:, None] <= b)
            else:
                other = (labels[:, None] != a) | (labels[:, None] != b)
                meets = np.zeros_like(other)
                for i, r in enumerate(rows):
                    for lo, hi in windows_of([p["score"] for p in r["positives"]]):
                        meets[i] |= (most[i] >= lo) & (least[i] <= hi)
                open_ = other & meets
            for g in np.flatnonzero(open_.any(0)):
                use = np.flatnonzero(open_[:, g])
                pick = [rows[i] for i in use]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": [parts[g]], "size": [size], "queries": [[r["query"] for r in pick]], "ids": [[r["vec_id"] for r in pick]], "labels": [labels[use]], "vectors": [_blob(v[use])],
                        "positive_ids": [[[p["vec_id"] for p in r["positives"]] for r in pick]], "positive_scores": [[[p["score"] for p in r["positives"]] for r in pick]],
                    },
                    kinds,
                )

        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) == BLOCK or len(r["v"]) != len(held[0]["v"])):
                    yield from made(held, len(held[0]["v"]))
                    held = []
                held.append(r)
        if held:
            yield from made(held, len(held[0]["v"]))

    hit = pa.schema([(n, pa.int32() if n == "slot" else pa.int64()) for n in ("query", "anchor_id", "slot", "positive_id", "positive_score", "vec_id", "row", "score")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                size = get("size")
                if get("tree") != key:
                    key, n = get("tree"), get("n")
                    tree = RTree(*(np.array(get(c), np.int64) for c in ("t_ids", "rows", "t_labels")), _rows(get("t_vectors"), size, n))
                queries, ids, pos_ids, pos_scores = (get(c) for c in ("queries", "ids", "positive_ids", "positive_scores"))
                windows = [[(-(1 << 63), (1 << 63) - 1)]] * len(queries) if same else [windows_of(s) for s in pos_scores]
                out: list[list] = [[] for _ in hit]
                for a, w, places, scores in tree.search(_rows(get("vectors"), size, len(queries)), np.array(queries), np.array(get("labels")), same, windows, k):
                    m = len(places)
                    positive = (None, None) if same else (pos_ids[a][w], pos_scores[a][w])
                    for column, values in zip(out, ([queries[a]] * m, [ids[a]] * m, [w] * m, [positive[0]] * m, [positive[1]] * m, tree.ids[places], tree.rows[places], scores)):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, hit)], schema=hit)

    # anchors of one label and region are neighbours, so a block of them opens few groups
    near = asks.repartitionByRange(F.size("v"), "label", F.try_element_at("v", F.lit(1)), "query").sortWithinPartitions(F.size("v"), "label", F.try_element_at("v", F.lit(1)))
    asked = stored(near.select("query", "vec_id", "label", "v", "positives").mapInArrow(blocks, ASKS), "tree-asks")
    held = grouped.select("part", "size", "tree", "n", F.col("ids").alias("t_ids"), "rows", F.col("labels").alias("t_labels"), F.col("vectors").alias("t_vectors"))
    return held.join(asked, ["part", "size"]).mapInArrow(search, HITS)


def hard_negatives(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tree_rows: int = TREE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``ANCHOR_EVERY``; their positives the ``POSITIVES``
    best rows of the same label, a positive's negatives the ``NEGATIVES`` best rows of other labels
    with scores from ``LOWEST`` to ``HIGHEST`` hundredths of the positive's. Ties: smaller id.
    """
    known = table.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    moved = F.when(F.coalesce(F.col("vec_id") % RELABEL_EVERY == 0, F.lit(False)), (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = known.where(F.coalesce(finite, F.lit(False))).withColumn("label", moved).withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("long")))
    rows = stored(whole.select(F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "label", "v", F.monotonically_increasing_id().alias("row")), "labelled-vectors")
    trees = pack_trees(rows, tree_rows)

    none = F.array().cast("array<struct<vec_id:bigint,score:bigint>>")
    anchors = rows.where((F.col("vec_id") % ANCHOR_EVERY == 0) & (F.col("vec_id") != NO_ID)).select(F.col("row").alias("query"), "vec_id", "label", "v", none.alias("positives"))
    best = Window.partitionBy("query", "slot").orderBy(F.col("score").desc(), "vec_id", "row")
    positives = _searched(trees, anchors, True, POSITIVES).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= POSITIVES)
    kept = positives.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    kept = kept.select("query", F.transform("p", lambda x: F.struct(x["vec_id"].alias("vec_id"), x["score"].alias("score"))).alias("positives"))
    paired = stored(anchors.drop("positives").join(kept, "query"), "anchors-with-positives")
    negatives = _searched(trees, paired, False, NEGATIVES).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEGATIVES)
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return negatives.select("anchor_id", named("positive_id").alias("positive_id"), "rank", named("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
