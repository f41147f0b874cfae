"""Chat formatting as a prefix tree: turns that conversations share are emitted once.

Every conversation becomes a sequence of formatted turns. Conversations that begin alike share
tree nodes; a tree is written depth-first as one stream of tokens (here: code points), and each
node carries what a model needs to see it as part of a conversation: the position at which it
begins in its conversations, and the stretches of the stream that its tokens attend to.

Layout. A node belongs to the smallest conv_id that passes it; the nodes of one such *chain* are
consecutive turns. In depth-first order a chain comes whole, then the chains that leave it, the
deepest branch first (then by conv_id); so a path is one stretch of each chain that it passes,
and an ancestor interval is one chain's stretch. Chains are sorted over the cluster by the
branches on their path, and stretches placed by sums over the sort's ranges.

Text. ``<|im_start|>role\\n text <|im_end|>\\n``. Inside roles and texts one backslash is put
between ``<`` (with any backslashes after it) and ``|``, so no control string is left in them and
taking one away restores the text; in roles, line feeds and backslashes are escaped as well.
Only the texts of assistant turns are under the loss mask.

Memory and hot keys: prefixes are compared by keys of fixed size, and the smallest conv_id of each
is aggregated before rows are shuffled; joins against chains that many conversations pass are
equi-joins with one row a chain or node on one side, which Spark splits. Only the list of a
path's chains is gathered, one entry a branch.

Defined cases: rows with a null conv_id take no part; a null role or text is empty; order and ties
of turns are those of :mod:`wiretrace.llm.turns`; equal rows are turns of their own; equal
conversations end at one node; very long texts are pieces of their own size in one row; other
columns are not looked at; an empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretrace.operators.scan import running, sum_step, xor_step

from .common import stored
from .turns import numbered_turns, place_hash

START, END = "<|im_start|>", "<|im_end|>"
ROLE_UNDER_LOSS = "assistant"

NODES = "tree long, start long, end long, chain long, nth long, depth long, position long, attends array<struct<start:bigint,end:bigint>>, piece string, loss_start long, loss_end long"
MEMBERS = "conv_id long, tree long, path array<struct<chain:bigint,turns:bigint,start:bigint,end:bigint,depth:bigint>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escaped_role(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escaped(plain)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def chat_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of the forest; columns as in ``NODES`` and ``MEMBERS``.

    nodes: sorted by tree and place in its stream; ``piece`` is the formatted turn, ``loss_start``
    and ``loss_end`` its stretch of the stream under the loss mask (null: none). A node attends to
    ``attends`` and, causally, to itself. members: for each conversation the stretches of its path.
    """
    turns = numbered_turns(conversations, with_text=True)
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    turns = turns.select("conv_id", "pos", "ta", "tb", F.col("role") == ROLE_UNDER_LOSS, head.alias("head"), escaped(F.col("text")).alias("body"))
    turns = turns.toDF("conv_id", "pos", "ta", "tb", "loss", "head", "body").selectExpr(
        "conv_id", "pos", "ta", "tb", "loss", "char_length(head) AS head_chars", f"char_length(head) + char_length(body) + {len(END) + 1} AS chars", f"concat(head, body, '{END}\\n') AS piece"
    )
    turns = stored(turns, "chat-turns")

    keyed = turns.select("conv_id", "pos", "chars", *[place_hash(s, "pos", "ta", "tb").alias(f"x{s}") for s in (1, 2)])
    keyed = running(keyed, ["conv_id"], "pos", [xor_step("k1", F.col("x1")), xor_step("k2", F.col("x2")), sum_step("upto", F.col("chars").cast("long"))])
    keyed = stored(keyed.selectExpr("conv_id", "pos", "chars", "k1", "k2", "upto - chars AS position"), "chat-prefixes")
    owners = keyed.groupBy("pos", "k1", "k2").agg(F.min("conv_id").alias("chain"))
    steps = stored(keyed.join(owners, ["pos", "k1", "k2"]).select("conv_id", "pos", "chars", "position", "chain"), "chat-steps")

    # the stretch of each chain that a conversation passes
    parts = steps.groupBy("conv_id", "chain").agg(F.min("pos").alias("first"), F.count("*").alias("turns"), F.sum("chars").cast("long").alias("chars"), F.min("position").alias("position"))
    parts = stored(parts, "chat-parts")
    path = F.sort_array(F.collect_list(F.struct("first", "chain")))
    branches = parts.groupBy("conv_id").agg(path.alias("path"), F.max(F.when(F.col("chain") == F.col("conv_id"), F.struct("chars", "position", "first"))).alias("own")).where("own IS NOT NULL")
    chains = branches.selectExpr("conv_id AS chain", "path[0].chain AS tree", "transform(path, p -> struct(1 - p.first AS back, p.chain AS chain)) AS place", "own.chars AS chars", "own.position AS position", "own.first AS first")
    ordered = chains.repartitionByRange("tree", "place").sortWithinPartitions("tree", "place").select("chain", "tree", "chars", "position", "first", F.monotonically_increasing_id().alias("at"))
    ordered = stored(ordered, "chat-chains")
    # one bucket a range of the sort, so that no tree is added up in one task
    placed = running(ordered, ["tree"], "at", [sum_step("upto", F.col("chars"))], bucket_rows=1 << 33)
    placed = stored(placed.selectExpr("chain", "tree", "upto - chars AS begin", "position AS opens", "first"), "chat-places")

    stretch = parts.join(placed.select("chain", "tree", "begin"), "chain").selectExpr("conv_id", "tree", "struct(first, chain, turns, begin AS start, begin + chars AS end) AS s")
    members = stretch.groupBy("conv_id", "tree").agg(F.sort_array(F.collect_list("s")).alias("s"))
    members = stored(members.selectExpr("conv_id", "tree", "transform(s, x -> struct(x.chain AS chain, x.turns AS turns, x.start AS start, x.end AS end, x.first AS depth)) AS path"), "chat-members")

    above = members.selectExpr("conv_id AS chain", "transform(filter(path, x -> x.chain <> conv_id), x -> struct(x.start AS start, x.end AS end)) AS above")
    made = steps.where("chain = conv_id").drop("conv_id").join(placed, "chain").join(above, "chain")
    made = made.selectExpr("tree", "chain AS conv_id", "pos", "begin + position - opens AS start", "pos - first + 1 AS nth", "begin", "position", "chars", "above")
    nodes = made.join(turns.select("conv_id", "pos", "piece", "loss", "head_chars"), ["conv_id", "pos"])
    nodes = nodes.selectExpr(
        "tree",
        "start",
        "start + chars AS end",
        "conv_id AS chain",
        "nth",
        "pos AS depth",
        "position",
        "CASE WHEN start > begin THEN concat(above, array(struct(begin AS start, start AS end))) ELSE above END AS attends",
        "piece",
        "CASE WHEN loss THEN start + head_chars END AS loss_start",
        f"CASE WHEN loss THEN start + chars - {len(END) + 1} END AS loss_end",
    )
    return nodes.repartitionByRange("tree", "start").sortWithinPartitions("tree", "start"), members


def write_chat_tree(conversations: DataFrame, path: str) -> None:
    """The forest as Parquet below ``path``: ``nodes`` in depth-first order, and ``members``."""
    nodes, members = chat_tree(conversations)
    nodes.write.parquet(f"{path}/nodes")
    members.write.parquet(f"{path}/members")


def read_chat_tree(spark, path: str) -> DataFrame:
    """conv_id, depth, piece, loss_from, loss_to (within the piece) of every turn, as written.

    Turns of a conversation's own chain are taken as they lie; those that it shares come by join.
    """
    nodes = spark.read.schema(NODES).parquet(f"{path}/nodes").selectExpr("chain", "nth", "depth", "piece", "loss_start - start AS loss_from", "loss_end - start AS loss_to")
    members = spark.read.schema(MEMBERS).parquet(f"{path}/members")
    shared = members.selectExpr("conv_id", "inline(filter(path, x -> x.chain <> conv_id))").selectExpr("conv_id", "chain", "explode(sequence(1L, turns)) AS nth")
    columns = ["conv_id", "depth", "piece", "loss_from", "loss_to"]
    return nodes.withColumnRenamed("chain", "conv_id").select(*columns).unionByName(shared.join(nodes, ["chain", "nth"]).select(*columns))


def digest_chats(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of turns read back.

    A conversation is read turn by turn from sorted rows; a task holds one batch of them.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, all_hash, loss_chars, loss_hash, chars = None, 0, None, 0, None, 0

        def row() -> dict:
            return {"conv_id": now, "n_turns": turns, "turns_sha256": all_hash.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss_hash.hexdigest(), "formatted_chars": chars}

        for batch in batches:
            done = []
            for conv, piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_from", "loss_to"))):
                if all_hash is None or conv != now:
                    if all_hash is not None:
                        done.append(row())
                    now, turns, all_hash, loss_chars, loss_hash, chars = conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                cut = piece.index("\n")
                role, text = unescaped_role(piece[len(START) : cut]), unescaped(piece[cut + 1 : -len(END) - 1])
                all_hash.update(f"{role}\n{text}\n".encode())
                turns, chars = turns + 1, chars + len(piece)
                if a is not None:
                    said = unescaped(piece[a:b])
                    loss_chars += len(said)
                    loss_hash.update(said.encode())
            yield pa.RecordBatch.from_pylist(done, schema)
        if all_hash is not None:
            yield pa.RecordBatch.from_pylist([row()], schema)

    by_conv = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return by_conv.select("conv_id", "piece", "loss_from", "loss_to").mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
