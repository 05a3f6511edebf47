"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, component): the smallest node that each can reach.

    Every round hooks each current root onto the smallest root beside it and then follows
    the pointers to their ends; edges inside one component are dropped, so the table
    shrinks. The state is a table in the shared folder after each step. Minima are
    pre-aggregated before they are shuffled. Nodes without an edge are not listed.
    """
    live = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    labels = materialize(nodes.withColumn("component", F.col("node")))
    while not live.isEmpty():
        # hook: each root takes the smallest neighbouring root (always smaller than itself)
        hook = live.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("parent"))
        hook = materialize(hook)
        # follow pointers until nothing moves
        while True:
            up = hook.select(F.col("root").alias("r2"), F.col("parent").alias("p2"))
            jumped = materialize(hook.join(up, F.col("parent") == F.col("r2"), "left").select("root", "parent", F.coalesce("p2", "parent").alias("next")))
            moved = not jumped.where("next <> parent").isEmpty()
            hook = jumped.select("root", F.col("next").alias("parent"))
            if not moved:
                break
        labels = materialize(labels.join(hook, F.col("component") == F.col("root"), "left").select("node", F.coalesce("parent", "component").alias("component")))
        ends = hook.select(F.col("root"), F.col("parent"))
        left = live.join(ends.toDF("ra", "pa"), F.col("a") == F.col("ra"), "left").select(F.coalesce("pa", "a").alias("a"), "b")
        both = left.join(ends.toDF("rb", "pb"), F.col("b") == F.col("rb"), "left").select("a", F.coalesce("pb", "b").alias("b"))
        live = materialize(both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return labels
