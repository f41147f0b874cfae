"""Resharding by minimum-cost flow.

Given rows with the shard each lies in, and new shards with equal capacities in bytes, a flow
from old to new shards that moves the fewest bytes is found; rows are then moved in blocks.

What reaches the driver is bounded by parameters: byte counts of ``BUCKETS`` hash buckets an old
shard, and the rows larger than 1/``FINE`` of a new shard, of which there are at most ``FINE``
times the number of new shards. Those large rows are placed one by one, so what is left is fine
enough to fill the new shards almost exactly. A row's place in the flow comes from a running sum
inside its block (a run of buckets of about ``BLOCK_BYTES``), so a hot old shard is many blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path

ROW_OVERHEAD = 16
MOST_BUCKETS = 65_536
BLOCK_BYTES = 16 << 20
FINE = 200


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_OVERHEAD)


def minimum_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray) -> np.ndarray:
    """Integer flow from each supply to each capacity with the least total cost.

    Successive shortest augmenting paths over the residual network; the total supply must fit.
    Sizes are numbers of shards, so dense matrices do.
    """
    n, m = len(supply), len(capacity)
    left, room = np.array(supply, np.int64), np.array(capacity, np.int64)
    flow = np.zeros((n, m), np.int64)
    if left.sum() > room.sum():
        raise ValueError("the capacities are too small")
    while left.any():
        d_old = np.where(left > 0, 0.0, np.inf)
        d_new = np.full(m, np.inf)
        # Where a path comes from; kept on ties, or a path could run in a circle.
        via_old, via_new = np.full(m, -1), np.full(n, -1)
        while True:
            reach = d_old[:, None] + cost
            near = reach.argmin(0)
            shorter = reach[near, np.arange(m)] < d_new - 1e-9
            d_new[shorter], via_old[shorter] = reach[near, np.arange(m)][shorter], near[shorter]
            back = np.where(flow > 0, d_new[None, :] - cost, np.inf)
            best = back.argmin(1)
            nearer = back[np.arange(n), best] < d_old - 1e-9
            if not nearer.any():
                break
            d_old[nearer], via_new[nearer] = back[np.arange(n), best][nearer], best[nearer]
        j = int(np.where(room > 0, d_new, np.inf).argmin())
        path, amount, end = [], int(room[j]), j
        while True:
            i = int(via_old[j])
            path.append((i, j, 1))
            if via_new[i] < 0:
                amount = min(amount, int(left[i]))
                break
            j = int(via_new[i])
            path.append((i, j, -1))
            amount = min(amount, int(flow[i, j]))
        for a, b, sign in path:
            flow[a, b] += sign * amount
        left[path[-1][0]] -= amount
        room[end] -= amount
    return flow


@dataclass
class Plan:
    """flow: bytes from each old to each new shard (small rows). segments: (old, from, to, shard)
    in bytes of an old shard's order. large: (doc_id, digest, shard). blocks: (old, bucket, block,
    bytes of the old shard before the block)."""

    flow: np.ndarray
    segments: list[tuple[int, int, int, int]]
    large: list[tuple[int, int, int]]
    blocks: list[tuple[int, int, int, int]]
    limit: int


def _keyed(docs: DataFrame, old: Column, n_old: int, id_col: str, text_col: str) -> DataFrame:
    buckets = max(1, MOST_BUCKETS // n_old)
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), old.cast("int").alias("old"), row_size(text).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest")
    ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)).cast("int"))


def make_plan(rows: DataFrame, n_old: int, n_new: int, cost: np.ndarray | None = None) -> Plan:
    """Solve the transfers. ``rows`` comes from ``_keyed``; ``cost`` per byte defaults to 0 for
    staying and 1 for any move."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    goal = [total * (k + 1) // n_new - total * k // n_new for k in range(n_new)]
    limit = max(1, total // (n_new * FINE))
    if cost is None:
        cost = 1.0 - np.eye(n_old, n_new)
    # One pass for the buckets and one for the large rows; both results are bounded.
    sums = rows.where(F.col("size") <= limit).groupBy("old", "bucket").agg(F.sum("size").alias("bytes")).collect()
    large = rows.where(F.col("size") > limit).groupBy("doc_id", "digest", "old").agg(F.sum("size").alias("bytes")).collect()
    supply = np.zeros(n_old, np.int64)
    for r in [*sums, *large]:
        supply[r["old"]] += r["bytes"]
    # The flow of all bytes says where an old shard's rows may go; large rows take their part.
    share, room = minimum_cost_flow(supply.tolist(), goal, cost), np.array(goal, np.int64)
    small = supply.copy()
    placed = []
    for r in sorted(large, key=lambda r: (-r["bytes"], r["doc_id"] is not None, r["doc_id"] or 0, r["digest"])):
        i, size = r["old"], r["bytes"]
        fit = np.minimum(share[i], room)
        j = int(fit.argmax())
        if fit[j] < size:
            j = int(room.argmax())
        placed.append((r["doc_id"], r["digest"], j))
        share[i, j] -= size
        room[j] -= size
        small[i] -= size
    # What large rows put over the goal is taken off the others' room, so that the rest just fits.
    over = int(np.clip(-room, 0, None).sum())
    room = np.clip(room, 0, None)
    while over > 0:
        open_ = np.flatnonzero(room)
        if not len(open_):
            break
        cut = np.minimum(room[open_], -(-over // len(open_)))
        cut[np.cumsum(cut) - cut >= over] = 0
        room[open_] -= cut
        over -= int(cut.sum())
    room[int(room.argmax())] += max(0, int(small.sum() - room.sum()))
    flow = minimum_cost_flow(small.tolist(), room.tolist(), cost)
    segments = []
    for i in range(n_old):
        at = 0
        for j in np.argsort(cost[i], kind="stable"):
            if flow[i, j]:
                segments.append((i, at, at + int(flow[i, j]), int(j)))
                at += int(flow[i, j])
    held = {(r["old"], r["bucket"]): r["bytes"] for r in sums}
    blocks, block = [], 0
    buckets = max(1, MOST_BUCKETS // n_old)
    for i in range(n_old):
        before, size = 0, 0
        for b in range(buckets):
            if size >= BLOCK_BYTES:
                before, size, block = before + size, 0, block + 1
            blocks.append((i, b, block, before))
            size += held.get((i, b), 0)
        block += 1
    return Plan(flow, segments, placed, blocks, limit)


def _placed(rows: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, text, old_shard, shard, block, rank: where each row goes.

    The tables sent to all tasks are bounded: MOST_BUCKETS rows, FINE times the new shards, and
    at most old plus new shards segments.
    """
    spark = rows.sparkSession
    blocks = F.broadcast(spark.createDataFrame(plan.blocks, "old int, bucket int, block int, before long"))
    large = F.broadcast(spark.createDataFrame(plan.large, "doc_id long, digest long, alone int").withColumnRenamed("doc_id", "id").withColumnRenamed("digest", "code"))
    # The first segment of an old shard reaches back, the last one on, over all bytes.
    first = {i: min(s[1] for s in plan.segments if s[0] == i) for i, *_ in plan.segments}
    last = {i: max(s[2] for s in plan.segments if s[0] == i) for i, *_ in plan.segments}
    far = 1 << 62
    spans = [(i, -far if lo == first[i] else 2 * lo, far if hi == last[i] else 2 * hi, j) for i, lo, hi, j in plan.segments]
    segments = F.broadcast(spark.createDataFrame(spans, "of int, lo long, hi long, along int"))
    inside = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "digest")
    weight = F.when(F.col("size") > plan.limit, 0).otherwise(F.col("size"))
    rows = rows.join(blocks, ["old", "bucket"]).withColumn("to", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("middle", 2 * (F.col("before") + F.col("to")) - weight)
    big = (F.col("size") > plan.limit) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("code"))
    rows = rows.join(large, big, "left").join(segments, F.col("alone").isNull() & (F.col("old") == F.col("of")) & (F.col("middle") >= F.col("lo")) & (F.col("middle") < F.col("hi")), "left")
    rows = rows.withColumn("shard", F.coalesce("alone", "along"))
    order = Window.partitionBy("block", "shard").orderBy(F.col("doc_id").asc_nulls_first(), "digest")
    return rows.select("doc_id", "text", F.col("old").alias("old_shard"), "shard", "block", F.row_number().over(order).alias("rank"))


def reshard(docs: DataFrame, old: Column, n_old: int, n_new: int, cost: np.ndarray | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Plan]:
    """Move rows to ``n_new`` shards of near-equal bytes and write those shards below ``path``
    (default: the shared scratch folder), one folder a shard.

    ``old`` gives a row's present shard, 0 to n_old - 1. A shard that neither gives nor takes
    rows (see ``Plan.flow``) need not be written and stays where it is if ``old`` says so for all
    its rows; here every shard that receives or keeps rows is written. Returns the rows read back
    from the files (doc_id, text, old_shard, shard, slot) and the plan. Slots count from 0 without
    gaps inside a shard.

    A null text counts as empty, null doc_ids come first; rows equal in id and text go together
    if they are large. An empty table gives empty shards.
    """
    spark = docs.sparkSession
    rows = _keyed(docs, old, n_old, id_col, text_col)
    plan = make_plan(rows, n_old, n_new, cost)
    path = path or scratch_path(spark, "shards")
    _placed(rows, plan).write.partitionBy("shard").parquet(path)
    files = spark.read.schema("doc_id long, text string, old_shard int, block int, rank int, shard int").parquet(path)
    pieces = files.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each block and shard that meet: at most blocks plus segments plus large rows.
    offsets = F.broadcast(pieces.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    out = files.join(offsets, ["shard", "block"])
    return out.select("doc_id", "text", "old_shard", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot")), plan
