"""Connected groups of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import materialise


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), which are hashed keys: the root is the same for all nodes of a group.

    In every step each node joins its smallest neighbour, trees are flattened by doubling, and edges are drawn between the roots.
    A node with edges never stays alone, so at least half of the roots go in each step; as keys are hashed, trees are shallow.
    The number of steps follows the logarithm of the nodes, however long a chain of edges is.
    """
    left = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("root")), "tree")
        while True:
            above = tree.select(F.col("node").alias("root"), F.col("root").alias("_upper")).filter("root <> _upper")
            moved = tree.join(above, "root", "left")
            if moved.filter("_upper is not null").isEmpty():
                break
            tree = materialise(moved.select("node", F.coalesce("_upper", "root").alias("root")), "tree")
        if roots is None:
            roots = tree
        else:
            later = tree.select(F.col("node").alias("root"), F.col("root").alias("_later"))
            roots = materialise(roots.join(later, "root", "left").select("node", F.coalesce("_later", "root").alias("root")), "roots")
        a, b = (tree.select(F.col("node").alias(x), F.col("root").alias(f"_{x}")) for x in "ab")
        joined = left.join(a, "a").join(b, "b").filter("_a <> _b")
        left = materialise(joined.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
