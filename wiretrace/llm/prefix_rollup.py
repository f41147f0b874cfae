"""The trie of conversation prefixes, by ROLLUP over positional turn-id columns.

A conversation is laid out in blocks of ``WIDTH`` turns: one row for each block, with the ids of
its turns in columns t1..t8 and a key for all turns before the block (the node that the prior
block ends at). ``GROUP BY block, key, ROLLUP (t1, ..., t8)`` then aggregates the prefixes of all
depths of all blocks together; grouping_id tells a prefix's depth. A second ROLLUP over one
conversation of each distinct path sums up subtrees:

* A node is named by its smallest member. A conversation names the nodes of one stretch of its
  path, from some depth down, and each node has one name; so what the nodes of a subtree add up
  to is what their names' conversations add up to. Only a node's own name counts nodes above the
  node, too: the running sum along its stretch is taken off.
* A leaf is counted by the conversation that names it.

Memory: rows are of fixed width; a task aggregates by hash with map-side combine, so a first turn
that a third of all conversations share is no hot task. Nothing is gathered but conv_ids of one
end node and one range of ``ID_RANGE`` ids, which bounds them; the digest of an end node runs
over those ranges as a stream. Running values along one conversation are taken in buckets.

Defined cases: rows with a null conv_id take no part; a null role or text is empty; rows of equal
turn are ordered by role and MD5 of the text; equal rows are turns of their own; other columns are
not looked at; an empty table has no nodes, not even the root. A long text is only hashed and
measured. Prefixes are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretrace.operators.scan import running, running_sum, xor_step

from .common import stored
from .turns import numbered_turns, place_hash

WIDTH = 8
#: conversations are rebuilt from those with numbers divisible by this, and from at most so many of their turns
FAMILY = 5
MOST_SHARED = 8
ID_RANGE = 1 << 16


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first one of its family."""
    return F.crc32(conv_id.cast("string")) % (MOST_SHARED + 1)


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, pos, ta, tb, bytes), and all conv_ids.

    ``turns`` comes from :func:`numbered_turns`. The first turns of a family's first
    conversation, at most eight, travel as one array.
    """
    turn = F.struct("pos", "ta", "tb", "bytes")
    first = F.sort_array(F.collect_list(F.when(F.col("pos") <= MOST_SHARED, turn)))
    convs = stored(turns.groupBy("conv_id").agg(first.alias("head"), F.count("*").alias("n")), "conversations")
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("given"))
    plan = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), shared_turns(F.col("conv_id")).alias("h")).join(heads, "base", "left")
    taken = F.slice("given", F.lit(1), F.col("h").cast("int"))
    plan = plan.select("conv_id", "h", F.coalesce(taken, F.array().cast("array<struct<pos:bigint,ta:bigint,tb:bigint,bytes:bigint>>")).alias("given"))
    front = plan.select("conv_id", F.inline("given"))
    shift = plan.select("conv_id", (F.size("given") - F.col("h")).alias("shift"), "h")
    own = turns.join(shift, "conv_id").where("pos > h").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "ta", "tb", "bytes")
    return front.unionByName(own), convs.select("conv_id")


def blocks_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, block, k1, k2 (of all turns before the block), e1, e2 (with the block's), n (turns
    in the block), t1..t8 (struct of x1, x2, bytes, or null). Every conversation has a block 0.

    x1 and x2 are the id of a turn with its place; keys are the exclusive or of those passed.
    """
    made = (
        turns.select("conv_id", F.expr(f"(pos - 1) div {WIDTH}").alias("block"), F.expr(f"(pos - 1) % {WIDTH}").alias("slot"), *[place_hash(s, "pos", "ta", "tb").alias(f"x{s}") for s in (1, 2)], "bytes")
        .groupBy("conv_id", "block")
        .agg(
            F.expr("count(*) AS n"),
            *[F.expr(f"bit_xor(x{s}) AS x{s}") for s in (1, 2)],
            *[F.expr(f"max(CASE WHEN slot = {i} THEN struct(x1, x2, bytes) END) AS t{i + 1}") for i in range(WIDTH)],
        )
    )
    places = [f"t{i + 1}" for i in range(WIDTH)]
    keyed = running(made, ["conv_id"], "block", [xor_step(f"e{s}", F.col(f"x{s}")) for s in (1, 2)])
    keyed = keyed.selectExpr("conv_id", "block", "n", "e1 ^ x1 AS k1", "e2 ^ x2 AS k2", "e1", "e2", *places)
    silent = convs.join(turns.where("pos = 1").select("conv_id"), "conv_id", "left_anti")
    empty = [f"CAST(NULL AS struct<x1:bigint,x2:bigint,bytes:bigint>) AS {t}" for t in places]
    return keyed.unionByName(silent.selectExpr("conv_id", *[f"0L AS {c}" for c in ("block", "n", "k1", "k2", "e1", "e2")], *empty))


def rolled_up(blocks: DataFrame, sums: dict[str, str]) -> DataFrame:
    """One row a node: depth, n1, n2 (its key), p1, p2 (its parent's), bytes of its last text, and
    ``sums`` (name to SQL aggregate)."""
    places = [f"t{i + 1}" for i in range(WIDTH)]
    columns = ", ".join(places)
    key = {s: " ^ ".join([f"k{s}", *[f"coalesce({t}.x{s}, 0L)" for t in places]]) for s in (1, 2)}
    # grouping_id has a bit for each column rolled up: 255 is the bare key, 0 all eight turns.
    # A conversation that ends before a depth has no turn there and is no member.
    return blocks.sparkSession.sql(
        f"""
        WITH grouped AS (
          SELECT block, k1, k2, {columns}, {WIDTH} - bit_count(grouping_id()) AS level, {", ".join(f"{v} AS {k}" for k, v in sums.items())}
          FROM {{blocks}} GROUP BY block, k1, k2, ROLLUP ({columns})
        ), keyed AS (
          SELECT block, level, {key[1]} AS n1, {key[2]} AS n2, CASE level {" ".join(f"WHEN {i + 1} THEN {t}" for i, t in enumerate(places))} END AS last, {", ".join(sums)}
          FROM grouped WHERE CASE WHEN level = 0 THEN block = 0 ELSE CASE level {" ".join(f"WHEN {i + 1} THEN {t} IS NOT NULL" for i, t in enumerate(places))} END END
        )
        SELECT block * {WIDTH} + level AS depth, n1, n2, n1 ^ coalesce(last.x1, 0L) AS p1, n2 ^ coalesce(last.x2, 0L) AS p2, coalesce(last.bytes, 0L) AS bytes, {", ".join(sums)}
        FROM keyed
        """,
        blocks=blocks,
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, n1, n2, ends_sha256 of the conversations (conv_id) that end at each node."""
    key = ["depth", "n1", "n2"]
    part = F.floor(F.col("conv_id") / ID_RANGE)
    chunks = ends.groupBy(*key, part.alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"depth": [k[0] for k, _ in done], "n1": [k[1] for k, _ in done], "n2": [k[2] for k, _ in done], "ends_sha256": [d for _, d in done]}, schema)

        schema = pa.schema([("depth", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("ends_sha256", pa.string())])
        done: list = []
        for batch in batches:
            for d, a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "n1", "n2", "ids"))):
                if (d, a, b) != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = (d, a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield out()
            done.clear()
        if state is not None:
            done.append((now, state.hexdigest()))
            yield out()

    sorted_chunks = chunks.repartition(*key).sortWithinPartitions(*key, "part")
    return sorted_chunks.mapInArrow(digest, "depth long, n1 long, n2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and last_bytes.

    ``rebuild``: over the conversations rebuilt within their families; else as they are.
    """
    turns = numbered_turns(conversations, with_text=False)
    turns = stored(turns, "numbered")
    made, convs = rebuilt_turns(turns) if rebuild else (turns, turns.select("conv_id").distinct())
    blocks = stored(blocks_of(made, convs), "prefix-blocks")

    nodes = stored(rolled_up(blocks, {"conv_id": "min(conv_id)", "n_convs": "count(*)"}), "prefix-nodes")
    key = ["depth", "n1", "n2"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count("*").alias("n_children"))
    weight = (F.col("n_convs") - 1) * F.col("bytes")
    facts = running_sum(nodes.join(children, key, "left").withColumn("w", weight), ["conv_id"], "depth", F.col("w"), "upto")
    facts = stored(facts.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "prefix-facts")

    names = facts.groupBy("conv_id").agg(F.sum("w").alias("weight"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"))
    sums = rolled_up(blocks.join(names, "conv_id"), {"weights": "sum(weight)", "n_leaves": "sum(leaves)"}).select(*key, "weights", "n_leaves")

    last = blocks.groupBy("conv_id").agg(F.max(F.struct("block", "n", "e1", "e2")).alias("b"))
    ends = last.select("conv_id", (F.col("b.block") * WIDTH + F.col("b.n")).alias("depth"), F.col("b.e1").alias("n1"), F.col("b.e2").alias("n2"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = facts.join(sums, key).join(end_digests(ends), key, "left").join(parents, ["depth", "p1", "p2"], "left")
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("weights") - (F.col("upto") - F.col("w"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.col("bytes").alias("last_bytes"),
    )
