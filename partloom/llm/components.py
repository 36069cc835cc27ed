"""Connected components of an edge table, in DataFrame joins; nothing but whether edges are left reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node reachable.

    Rounds of contraction: every node points to its smallest neighbour if that is smaller than itself, pointers are
    followed three steps, and the edges move to what their ends point to. A node that stays is the smallest of its
    neighbours, so each round at least halves what is left of a component, until no edge is left; there is no other limit.
    A node with a great many links is only ever an aggregate's key or one side of a join that Spark splits. Links of a
    node with itself give it a row. Null ends are left out.
    """
    known = links.filter("a is not null and b is not null").select("a", "b")
    edges = stash(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = stash(nodes.withColumn("root", F.col("node")))
    own = stash(edges.filter("a <> b"))
    drop_stash(edges)
    while not own.isEmpty():
        up = stash(own.groupBy("a").agg(F.min("b").alias("b")))
        far = up.join(up.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select("a", F.coalesce("c", "b").alias("b"))
        step = lambda at: far.select(F.col("a").alias(at), F.col("b").alias(f"{at}_up"))
        far = stash(far.join(up.select(F.col("a").alias("b"), F.col("b").alias("c")), "b", "left").select("a", F.coalesce("c", "b").alias("b")))
        moved = own.join(step("a"), "a", "left").join(step("b"), "b", "left").select(F.coalesce("a_up", "a").alias("p"), F.coalesce("b_up", "b").alias("q"))
        following = stash(moved.filter("p <> q").select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct())
        named = stash(labels.join(step("root"), "root", "left").select("node", F.coalesce("root_up", "root").alias("root")))
        for done in (own, labels, up, far):
            drop_stash(done)
        own, labels = following, named
    return labels
