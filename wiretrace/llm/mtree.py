"""Exact top-k by inner product: best-first search over M-trees.

Vectors become integers, x -> floor(64 x). With one more coordinate that makes all lengths equal,
the largest inner products are the nearest neighbours in a metric space, which an M-tree indexes:
nodes are pages of entries with a covering radius, and each entry stores its distance to the
parent, so the triangle inequality rules entries out before their distance is computed.

The index is a table of *trees*, each over at most about ``TREE_ROWS`` vectors near one of at
most ``PIVOTS`` sampled pivots (a pivot with more vectors has several trees; every row is in one).

1. Each query searches the tree that its own vector lies in. Its k-th score there is a bound.
2. Blocks of queries meet the other trees they may need: a tree is left out for a query whose
   distance to the pivot less the tree's radius is over its bound. Inside a tree pages are taken
   by their lower bounds, nearest first, until none can hold a better vector.

Only scores that can still be among a query's best leave a task. What is sent to all tasks is
bounded by the number of pivots.

Distances only decide what is looked at, with slack for rounding; scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 64
K = 20
QUERY_EVERY = 20
TREE_ROWS = 4096
PAGE = 256
QUERY_BLOCK = 512
PIVOTS = 256
#: rows looked at to choose pivots
PIVOT_SAMPLE = 4096
SLACK = 1e-6


class MTree:
    """Two levels of pages over integer vectors: a root page and leaf pages of about ``page``
    entries. All arrays are numpy; a search works on many queries at once."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, longest: float, page: int = PAGE):
        self.ids, self.rows, self.vectors, self.longest = ids, rows, vectors, longest
        self.points = _lifted(vectors, longest)
        n = len(ids)
        # Routing objects far apart: each next one is the farthest from those before it.
        count = max(1, -(-n // page))
        pivots, gap = [0], None
        owner, near = np.zeros(n, np.int64), _distances(self.points, self.points[:1])[:, 0]
        for k in range(1, min(count, n)):
            far = int(near.argmax())
            if near[far] <= SLACK:
                break
            gap = _distances(self.points, self.points[far : far + 1])[:, 0]
            nearer = gap < near
            owner[nearer], near = k, np.minimum(near, gap)
            pivots.append(far)
        # A page keeps its entries by distance to the parent; a long page is cut in that order.
        order = np.lexsort((near, owner))
        cuts = [0]
        for lo, hi in _runs(owner[order]):
            cuts.extend(range(lo + page, hi, page))
            cuts.append(hi)
        self.order, self.cuts = order, np.array(sorted(set(cuts)))
        self.parent_distance = near[order]
        self.routing = self.points[np.array(pivots)][owner[order[self.cuts[:-1]]]] if n else np.zeros((0, self.points.shape[1]))
        # A page is a ring around its routing object: covering radius and inner radius.
        self.radius = np.array([self.parent_distance[a:b].max() for a, b in zip(self.cuts, self.cuts[1:])])
        self.inner = np.array([self.parent_distance[a:b].min() for a, b in zip(self.cuts, self.cuts[1:])])

    def search(self, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the places and scores of its best entries: at most k of at least ``bound``
        (ties to the smaller id), without the entry whose row is ``own``."""
        best_score = [np.zeros(0, np.int64)] * len(queries)
        best_at = [np.zeros(0, np.int64)] * len(queries)
        if not len(self.ids) or not len(queries):
            return list(zip(best_at, best_score))
        lifted = np.concatenate((queries.astype(float), np.zeros((len(queries), 1))), axis=1)
        norm = (queries.astype(float) ** 2).sum(1)
        to_page = _distances(lifted, self.routing)
        lower = np.maximum(np.maximum(to_page - self.radius, self.inner - to_page), 0)
        visit = lower.argsort(1, kind="stable")
        reach = _reach(bound, norm, self.longest)
        active = np.arange(len(queries))
        for turn in range(lower.shape[1]):
            page = visit[active, turn]
            going = lower[active, page] <= reach[active] + SLACK
            active, page = active[going], page[going]  # pages only get farther: a query that stops is done
            if not len(active):
                break
            for p in np.unique(page):
                which = active[page == p]
                a, b = self.cuts[p], self.cuts[p + 1]
                entries = self.order[a:b]
                # triangle inequality with the stored parent distances
                off = np.abs(to_page[which, p][:, None] - self.parent_distance[a:b][None, :])
                need = off <= reach[which][:, None] + SLACK
                columns = np.flatnonzero(need.any(0))
                if not len(columns):
                    continue
                entries = entries[columns]
                scores = (queries[which].astype(float) @ self.vectors[entries].astype(float).T).round().astype(np.int64)
                take = need[:, columns] & (self.rows[entries][None, :] != own[which][:, None]) & (scores >= bound[which][:, None])
                for r in np.flatnonzero(take.any(1)):
                    q = which[r]
                    at, s = np.concatenate((best_at[q], entries[take[r]])), np.concatenate((best_score[q], scores[r][take[r]]))
                    keep = np.lexsort((self.rows[at], self.ids[at], -s))[:k]
                    best_at[q], best_score[q] = at[keep], s[keep]
                    if len(keep) == k and s[keep[-1]] > bound[q]:
                        bound[q] = s[keep[-1]]
                        reach[q] = _reach(bound[q : q + 1], norm[q : q + 1], self.longest)[0]
        return list(zip(best_at, best_score))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if len(values) else np.zeros(0, int)
    return zip(edges[:-1], edges[1:])


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with a coordinate that makes every squared length ``longest``."""
    v = vectors.astype(float)
    return np.concatenate((v, np.sqrt(np.maximum(longest - (v * v).sum(1), 0))[:, None]), axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _reach(bound: np.ndarray, norm: np.ndarray, longest: float) -> np.ndarray:
    """The distance within which a vector with a score of at least ``bound`` must lie."""
    far = norm + longest - 2.0 * np.maximum(bound, np.iinfo(np.int64).min // 4)
    # rounding of squared distances of this size, many times over
    return np.sqrt(np.maximum(far, 0) + 1e-9 * (norm + longest + 1))


def _packed(vectors: list) -> bytes:
    return np.array(vectors, "<i8").tobytes()


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long) of the rows with vectors whose components are all finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    return table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(fine).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def top_products(table: DataFrame, k: int = K, query_every: int = QUERY_EVERY, id_col: str = "vec_id", vector_col: str = "embedding", tree_rows: int = TREE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by ``query_every`` its
    k highest inner products with all other rows, ties to the smaller vec_id.

    Vectors that are null or hold a null or non-finite component take no part; zeros and repeated
    vectors do. Rows that share an id are rows of their own: each is a query, and finds the
    others. A null id is no query and sorts before all others. All vectors need one length. Fewer
    than k other rows give fewer results; an empty table none.
    """
    spark = table.sparkSession
    rows = stored(integer_vectors(table, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.max(square).alias("longest"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    n, longest, size = facts["n"], float(facts["longest"] or 0), facts["high"] or 0
    if n and facts["low"] != size:
        raise ValueError("vectors of different lengths")
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)

    # Pivots: far apart among a bounded sample.
    sample = np.array([r["v"] for r in rows.select("v").orderBy(F.xxhash64("row")).limit(PIVOT_SAMPLE).collect()], float).reshape(-1, size)
    lifted = _lifted(sample, longest)
    chosen, near = [0], _distances(lifted, lifted[:1])[:, 0]
    while len(chosen) < min(PIVOTS, -(-n // tree_rows)) and near.max() > SLACK:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(lifted, lifted[chosen[-1]][None, :])[:, 0])
    pivots = lifted[chosen]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, size)
            d = _distances(_lifted(v, longest), pivots)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.astype("<i8").tobytes() for r in v], pa.binary()), pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1))],
                names=["vec_id", "row", "v", "pivot", "distance"],
            )

    placed = stored(rows.select("vec_id", "row", "v").mapInArrow(place, "vec_id long, row long, v binary, pivot int, distance double"), "vectors-placed")
    stats = {r["pivot"]: (r["n"], r["radius"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}
    trees = {p: max(1, -(-c // tree_rows)) for p, (c, _) in stats.items()}
    split = F.create_map(*[F.lit(x) for kv in trees.items() for x in kv])
    part = F.pmod(F.xxhash64("row"), F.element_at(split, F.col("pivot"))).cast("int")
    keyed = placed.withColumn("part", part)
    tree_table = stored(
        keyed.groupBy("pivot", "part").agg(F.collect_list(F.struct(F.coalesce("vec_id", F.lit(-(1 << 63))).alias("vec_id"), "row", "v")).alias("entries")), "trees"
    )
    is_query = F.col("vec_id") % query_every == 0
    queries = keyed.where(is_query)

    def tree_of(entries) -> MTree:
        ids, row, blob = entries.flatten().flatten()
        vectors = np.frombuffer(b"".join(blob.to_pylist()), "<i8").reshape(len(ids), size)
        return MTree(ids.to_numpy(), row.to_numpy(), vectors, longest)

    out_schema = "query_row long, query_id long, vec_id long, row long, score long"

    def found(tree: MTree, q_row: np.ndarray, q_id: np.ndarray, v: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
        hits = tree.search(v, q_row, bound.copy(), k)
        sizes = [len(a) for a, _ in hits]
        at = np.concatenate([a for a, _ in hits]) if hits else np.zeros(0, np.int64)
        score = np.concatenate([s for _, s in hits]) if hits else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(q_row, sizes), pa.int64()), pa.array(np.repeat(q_id, sizes), pa.int64()), pa.array(tree.ids[at], pa.int64()), pa.array(tree.rows[at], pa.int64()), pa.array(score, pa.int64())],
            names=["query_row", "query_id", "vec_id", "row", "score"],
        )

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = tree_of(batch.column(0).slice(i, 1))
                which = np.flatnonzero((tree.ids % query_every == 0) & (tree.ids != -(1 << 63)))
                yield found(tree, tree.rows[which], tree.ids[which], tree.vectors[which], np.full(len(which), np.iinfo(np.int64).min))

    home = stored(tree_table.select("entries").mapInArrow(at_home, out_schema), "products-at-home")
    bounds = home.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_row", "least")
    asking = queries.join(bounds, queries["row"] == bounds["query_row"], "left").select("vec_id", "row", "v", "pivot", "part", F.coalesce("least", F.lit(int(np.iinfo(np.int64).min))).alias("least"))

    # Queries of one tree are alike, so a block of them needs about the same other trees.
    radius = np.array([stats.get(p, (0, -1.0))[1] for p in range(len(pivots))])
    parts = np.array([trees.get(p, 0) for p in range(len(pivots))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> Iterator[tuple]:
            ids, row, blob, pivot, piece, least = (list(c) for c in zip(*rows))
            v = np.frombuffer(b"".join(blob), "<i8").reshape(len(rows), size)
            wide = np.concatenate((v.astype(float), np.zeros((len(v), 1))), axis=1)
            reach = _reach(np.array(least), (v.astype(float) ** 2).sum(1), longest)
            open_ = _distances(wide, pivots) - radius[None, :] <= reach[:, None] + SLACK
            for p in np.flatnonzero(open_.any(0) & (parts > 0)):
                for t in range(parts[p]):
                    use = np.flatnonzero(open_[:, p] & ~((np.array(pivot) == p) & (np.array(piece) == t)))
                    if len(use):
                        yield int(p), t, np.array(ids)[use].tolist(), np.array(row)[use].tolist(), v[use].tobytes(), np.array(least)[use].tolist()

        held: list = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(6))):
                held.append(r)
                if len(held) == QUERY_BLOCK:
                    yield from _as_batches(made(held))
                    held = []
        if held:
            yield from _as_batches(made(held))

    def _as_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
        for r in rows:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r, kinds)], names=["pivot", "part", "ids", "rows", "vectors", "bounds"])

    asked = asking.repartition("pivot", "part").sortWithinPartitions("pivot", "part").mapInArrow(blocks, "pivot int, part int, ids array<long>, rows array<long>, vectors binary, bounds array<long>")

    def abroad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                now = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if now != key:
                    key, tree = now, tree_of(batch.column(2).slice(i, 1))
                ids, row, bound = (batch.column(c).slice(i, 1).flatten().to_numpy() for c in (3, 4, 6))
                v = np.frombuffer(batch.column(5)[i].as_py(), "<i8").reshape(len(ids), size)
                yield found(tree, row, ids, v, bound)

    away = asked.join(tree_table, ["pivot", "part"]).select("pivot", "part", "entries", "ids", "rows", "vectors", "bounds").mapInArrow(abroad, out_schema)
    best = Window.partitionBy("query_row", "query_id").orderBy(F.col("score").desc(), "vec_id", "row")
    ranked = home.unionAll(away).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != -(1 << 63), F.col("vec_id")).alias("vec_id"), "score")
