"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouping by node with a minimum, so nothing but edges moves and no
component is gathered in one task. Every step links nodes to smaller ones, and it
ends when each node hangs on the least node of its component, after a number of
rounds that grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("low").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them. Edges come as a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("low"))
    ends = F.when(F.col("a") > F.col("low"), F.array("a", "b")).otherwise(F.array("b"))
    return edges.join(least, "b").select(F.col("low").alias("a"), F.explode(ends).alias("b")).distinct()


def roots_of_forest(parents: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, root) of edges (a, b) in which every b has one parent a: the node 2^jumps steps up,
    or the top of its tree if that is nearer. A node of the same component, though perhaps not its root."""
    now = parents.select(F.col("b").alias("node"), F.col("a").alias("root"))
    for _ in range(jumps):
        above = now.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        now = cut(now.join(above, F.col("root") == F.col("mid"), "left").select("node", F.coalesce("top", "root").alias("root")))
    return now


def joined_roots(forest: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of every node below a root, from roots_of_forest and further links (a, b).

    Trees are contracted to their roots first, so only links between trees, and what is left of
    long chains, need the iteration.
    """
    top = forest.select(F.col("node").alias("mid"), F.col("root").alias("top"))
    ends = links.select(F.col("a"), F.col("b"))
    for end in ("a", "b"):
        ends = ends.join(top, F.col(end) == F.col("mid"), "left").withColumn(end, F.coalesce("top", end)).drop("mid", "top")
    chains = forest.select(F.col("root").alias("b")).distinct().join(top, F.col("b") == F.col("mid")).select(F.col("top").alias("a"), "b")
    rest = cut(ends.where("a != b").unionByName(chains).distinct())
    if rest.isEmpty():
        return forest
    above = components(rest)
    moved = forest.join(above.select(F.col("node").alias("mid"), F.col("root").alias("top")), F.col("root") == F.col("mid"), "left")
    moved = moved.select("node", F.coalesce("top", "root").alias("root"))
    return cut(moved.unionByName(above.join(forest, "node", "left_anti")).where("node != root"))


def moved_roots(root: DataFrame, above: DataFrame) -> DataFrame:
    """(node, root) after roots were linked with each other; ``above`` has the (node, root) of those links."""
    mid = above.select(F.col("node").alias("mid"), F.col("root").alias("top"))
    moved = root.join(mid, F.col("root") == F.col("mid"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut(moved.unionByName(above.join(root, "node", "left_anti")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge other than its component's least node.

    ``edges`` has columns a and b; loops and repeats are ignored.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = cut(edges.where(F.col("a") != F.col("b")).select(low.alias("a"), high.alias("b")).distinct())
    mark = None
    while True:
        # A forest of stars: no node is both an end and a centre, and no node has two centres.
        facts = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if (facts["n"], facts["h"]) == mark or not facts["n"]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = (facts["n"], facts["h"])
        now = cut(_small_star(_large_star(now)))
