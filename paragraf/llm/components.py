"""Connected components by rounds of contraction, all of it in joins and aggregates.

Each round every node points to its smallest neighbour, if that is smaller than itself; pointers are
followed by doubling to the ends of their trees, and edges are replaced by those between ends. An end
that nothing points to has, after the round, neighbours that are all smaller, so two rounds at least
halve the nodes, and doubling takes the logarithm of a tree's depth: stars, paths and dense groups end
in one round or two. Hubs are no bottleneck: minima are combined before the shuffle, and what points to
a hub meets it in a join whose skewed partitions Spark splits. The driver learns only whether edges, or
pointers that moved, are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a long, b long); nodes have the same root if connected.

    Loops and rows with a null end are left out, repeated edges count once; no edges give no rows.
    """
    rounds: list[DataFrame] = []
    live = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b")
    live = common.checkpoint(live.distinct())
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("near"))
        trees = common.checkpoint(least.select(F.col("a").alias("node"), F.least("a", "near").alias("root")))
        moving = True
        while moving:
            step = trees.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = trees.join(step, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            jumped = common.checkpoint(jumped)
            moving = not jumped.where("moved").isEmpty()
            trees = jumped.select("node", "root")
        rounds.append(trees)
        left = trees.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = trees.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = live.join(left, "a").join(right, "b").where("ra <> rb")
        live = common.checkpoint(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not rounds:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for trees in rounds[1:]:
        step = trees.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return found
