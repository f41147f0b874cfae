"""Connected components of a graph given by its links, by rounds of joins.

Each round links every node to the smallest node in sight of it and of its neighbours ("large
star", then "small star"), which halves path lengths; rounds are written to the shared folder. A
hub's many links are never gathered: minima are aggregated, and joins split hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of every node of ``edges`` (a, b).

    Self-links and repeated links change nothing; no links give no rows. Nodes are longs.
    """
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    before = None
    while True:
        both = current.unionAll(current.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        # larger neighbours of a node are linked to the smallest node it sees
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # then smaller neighbours, and the node itself
        floor = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(floor, "v")
        current = stored(
            small.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionAll(floor.select("v", F.col("m").alias("u"))).distinct(),
            "links",
        )
        # the set of links stands still exactly when every component is a star
        state = current.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    stars = current.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.unionAll(current.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
