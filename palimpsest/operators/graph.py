"""Connected components and parent chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_shared, save_shared

#: Edges up to which the nodes' least neighbours are broadcast, 16 bytes or so each; a hub then needs no
#: task of its own.
BROADCAST_EDGES = 500_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """Large: every larger neighbour of a node is tied to the least in its neighbourhood, the node
    included. Small: the node and its smaller neighbours are tied to the least of them. ``few``: the
    edges are within the bound for broadcasting."""
    hint = F.broadcast if few else lambda x: x
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        out = both.where("b > a").join(hint(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(hint(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node that an edge (a, b) joins to another.

    Large and small stars alternate until the edges are stars. Each round is written to the shared
    folder, which cuts the lineage; nodes are of any ordered type."""
    now = save_shared(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark or not seen[0]:
            break
        mark, last, few = seen, now, 2 * seen[0] <= BROADCAST_EDGES
        now = save_shared(_star(_star(now, True, few), False, few), "edges")
        drop_shared(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def heads(parents: DataFrame) -> DataFrame:
    """key and head of every key: its parents are followed to the end, however long the chain is, by joining
    each key's ancestor with that one's own until nothing changes. A key on a circle is its own head; one
    that leads into a circle ends at the circle's least key."""
    now = save_shared(parents.select("key", F.coalesce("parent", "key").alias("head")), "heads")
    steps, keys = 1, now.count()
    while True:
        up = now.select(F.col("key").alias("__k"), F.col("head").alias("__h"))
        after = save_shared(now.join(up, F.col("head") == F.col("__k"), "left").select("key", F.coalesce("__h", "head").alias("head")), "heads")
        moved = after.join(now.withColumnRenamed("head", "__old"), "key").where("head <> __old").limit(1).count()
        drop_shared(now)
        now, steps = after, 2 * steps
        if not moved or steps >= keys:  # every chain has ended: what still moves goes round
            break
    up = parents.where("parent is not null and parent <> key").select(F.col("key").alias("a"), F.col("parent").alias("b"))
    on = now.select(F.col("head").alias("a")).distinct().join(up, "a", "left_semi")
    return _break_circles(now, up, on) if on.limit(1).count() else now


def _break_circles(now: DataFrame, up: DataFrame, on: DataFrame) -> DataFrame:
    """``on``: the heads that have a parent still, which are the keys on circles."""
    circle = components(up.join(on, "a", "left_semi").join(on.withColumnRenamed("a", "b"), "b", "left_semi"))
    circle = circle.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
    mine = circle.select(F.col("__n").alias("__own"))
    out = now.join(circle, F.col("head") == F.col("__n"), "left").join(mine, F.col("key") == F.col("__own"), "left")
    return out.select("key", F.when(F.col("__own").isNotNull(), F.col("key")).otherwise(F.coalesce("__c", "head")).alias("head"))
