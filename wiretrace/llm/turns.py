"""Turns of conversations in order, with ids of their contents.

Order: by turn (null first), then role and MD5 of the text; a null role or text is empty. Equal
rows are turns of their own. Rows with a null conv_id belong to no conversation and take no part.

Numbering does not gather a conversation: rows are sorted by ranges over the cluster, and only
the number of rows of each (conversation, range) is summed up, so a conversation that holds a
third of all rows is dealt over as many tasks as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def turn_id(role: str = "role", text: str = "text") -> list:
    """Two 64-bit hashes of a turn's contents, as columns ``ta`` and ``tb``. Turns that agree in
    both (128 bits) count as equal."""
    return [F.xxhash64(F.lit(k), role, text).alias(name) for k, name in ((1, "ta"), (2, "tb"))]


def place_hash(seed: int, place: str, ta: str, tb: str):
    """Hash of a turn at a place; the exclusive or of those of a sequence stands for the sequence."""
    return F.xxhash64(F.lit(seed), F.col(place).cast("long"), ta, tb)


def numbered_turns(conversations: DataFrame, with_text: bool) -> DataFrame:
    """conv_id, pos (from 1), ta, tb, bytes (UTF-8 of the text), and role and text if wanted."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.select("*", *turn_id(), F.octet_length("text").cast("long").alias("bytes"), F.md5("text").alias("digest"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    ranged = (rows if with_text else rows.drop("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    kept = ["conv_id", "ta", "tb", "bytes"] + ["role", "text"] * with_text
    placed = stored(ranged.select(*kept, F.monotonically_increasing_id().alias("at")), "turns")
    part = F.shiftright("at", 33)
    counts = placed.groupBy("conv_id", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return placed.withColumn("part", part).join(base, ["conv_id", "part"]).select((F.col("at") + F.col("shift")).alias("pos"), *kept)
