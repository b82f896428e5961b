"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Stash


def connected_components(spark: SparkSession, links: DataFrame, stash: Stash) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b: long);
    component is the smallest node reachable.

    Each round points every node at its smallest smaller neighbour, follows
    the pointers to their roots and contracts the links to those roots.  A
    star takes two or three rounds whatever its size.  Self links and
    repeated links are harmless; no links give an empty table.
    """
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cur = stash.keep(pairs.where("a < b").distinct())
    labels = stash.keep(
        cur.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        .withColumn("component", F.col("node")))
    while not cur.isEmpty():
        parent = stash.keep(cur.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        while True:  # pointer jumping
            top = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            jumped = stash.keep(
                parent.join(top, "up", "left")
                .select("node", F.coalesce("upper", "up").alias("up"),
                        F.col("upper").isNotNull().alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            stash.drop(parent)
            parent = jumped
            if not moved:
                break
        roots = parent.select(F.col("node").alias("component"), "up")
        after = stash.keep(labels.join(roots, "component", "left")
                           .select("node", F.coalesce("up", "component").alias("component")))
        up_a = parent.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        up_b = parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        left = (cur.join(up_a, "a", "left").join(up_b, "b", "left")
                .select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y"))
                .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                .where("a < b").distinct())
        nxt = stash.keep(left)
        stash.drop(cur, parent, labels)
        cur, labels = nxt, after
    return labels
