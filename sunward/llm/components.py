"""Connected components of a graph given as pairs, in rounds of joins."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .shared import release, stored


def components(pairs: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node in ``pairs`` (a, b: longs).

    Alternates two steps on the edges until none changes: each node sends its larger neighbours
    to the smallest node it knows (itself included), then its smaller ones. A node's smallest
    neighbour is a grouped minimum and meets the node's edges in a join, so a node with a third
    of all edges is never gathered in one place; each step is written to the shared folder.
    Repeated pairs, pairs with themselves and either direction are fine; no pairs, no rows.
    """
    edges = stored(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        before = edges
        both = before.unionByName(before.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # every node's larger neighbours go to the smallest node it knows
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), "edges")
        # every node and its smaller neighbours go to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stored(moved.distinct(), "edges")
        release(large)
        same = edges.join(before, ["u", "v"], "left_semi").count()
        done = same == edges.count() == before.count()
        release(before)
        if done:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stored(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
