"""Shared helpers of this package: tables, ranks without one big task, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factweave.session import materialise

#: Rows of a block that is ranked or numbered on its own.
BLOCK_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as it takes to be none of the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key() -> list[Column]:
    """A 128-bit key (r1, r2) of doc_id and text, so that rows of different texts differ though they share an id or have none."""
    parts = [F.col(c).cast("string") for c in ("doc_id", "text")]
    flagged = [x for p in parts for x in (p.isNull(), p)]
    return [F.xxhash64(F.lit(3), *flagged).alias("r1"), F.xxhash64(F.lit(4), *flagged).alias("r2")]


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """`df` with `_rank` (from 0) and the running totals `sums` (each without its own row), in `order`.

    The rows are sorted by range over all tasks and written; a task adds up its own rows, and one row per task is added up
    again, so no task ever holds all rows. Rows that tie in `order` must be equal or the caller must not mind their order.
    """
    ordered = df.withColumns({f"_v_{name}": value for name, value in sums.items()})
    ordered = materialise(ordered.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ordered")
    own = Window.partitionBy("_part").orderBy("_row")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    inner = ordered.withColumn("_rank", F.row_number().over(own) - 1)
    inner = inner.withColumns({name: F.coalesce(F.sum(f"_v_{name}").over(before), F.lit(0)) for name in sums})
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_b__rank"), *[F.sum(f"_v_{name}").alias(f"_b_{name}") for name in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = ["_rank", *sums]
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_b_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name in names])
    out = inner.join(parts, "_part")
    return out.withColumns({name: F.col(name) + F.col(f"_b_{name}") for name in names}).drop(
        "_part", "_row", *[f"_v_{name}" for name in sums], *[f"_b_{name}" for name in names])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each connected group, for every node that has an edge.

    Every round hangs a node on the smallest neighbour seen so far and then halves the paths. What is left after a round is
    written, so lineage stays short and a lost executor costs one round at most. The work follows the number of edges; a
    node with very many edges is aggregated before it is shuffled.
    """
    left = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()
    left = materialise(left, "edges")
    parents: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).filter("up < node")
        hung = materialise(hung, "hung")
        # Two steps up at once: the parent of a parent is still in the same group.
        above = hung.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        hung = materialise(hung.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("up")), "hung")
        parents.append(hung)
        up_a, up_b = (hung.select(F.col("node").alias(x), F.col("up").alias(f"_{x}")) for x in "ab")
        moved = left.join(up_a, "a", "left").join(up_b, "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
        left = materialise(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), "edges")
    if not parents:
        return edges.select(F.least(a, b).alias("node"), F.least(a, b).alias("root")).limit(0)
    # A node was hung in the round that removed it, or is a root. Later rounds move what earlier rounds hung it on.
    roots = parents[-1].select("node", F.col("up").alias("root"))
    for hung in reversed(parents[:-1]):
        later = roots.select(F.col("node").alias("up"), "root")
        roots = hung.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root")).unionByName(roots)
        roots = roots.groupBy("node").agg(F.min("root").alias("root"))
    roots = materialise(_settled(roots), "roots")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _settled(roots: DataFrame) -> DataFrame:
    """Follow `root` until nothing moves."""
    roots = materialise(roots, "roots")
    while True:
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("_upper"))
        moved = roots.join(above, "root", "inner")
        if moved.isEmpty():
            return roots
        roots = materialise(roots.join(above, "root", "left").select("node", F.coalesce("_upper", "root").alias("root")), "roots")
