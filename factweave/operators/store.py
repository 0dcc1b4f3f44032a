"""Tables that change: upserts and patches as joins, written as new snapshots.

A snapshot is never overwritten while it is read: every write makes `snapshot=<n>` and the newest complete one is
current, so a failed writer leaves the old state in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.skew import keep_first, keep_last


def upsert_articles(stored: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Insert by `normalized_url`; an existing article stays as it is, except a missing score is filled."""
    fresh = keep_first(incoming, ["normalized_url"], *order)
    late = fresh.select("normalized_url", F.col("relevance_score").alias("_score"))
    kept = stored.join(late, "normalized_url", "left").withColumn("relevance_score", F.coalesce("_score", "relevance_score")).select(*stored.columns)
    return kept.unionByName(fresh.join(stored.select("normalized_url"), "normalized_url", "left_anti").select(*stored.columns))


def patch_incidents(stored: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Per column the patch value when it has one, else the stored value; unknown keys are inserted."""
    patch = patches.select(key, *[F.col(c).alias(f"_p_{c}") for c in patches.columns if c != key])
    joined = stored.join(patch, key, "full_outer")
    value = lambda c: F.coalesce(f"_p_{c}", c) if c in patches.columns else F.col(c)
    return joined.select(key, *[value(c).alias(c) for c in stored.columns if c != key]).select(*stored.columns)


def replace_children(stored: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in `incoming` are replaced, other parents keep theirs."""
    parents = incoming.select(parent).distinct()
    return stored.join(parents, parent, "left_anti").unionByName(incoming.select(*stored.columns))


def upsert_children(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Merge on a natural key, last one wins."""
    fresh = keep_last(incoming, keys, *order).select(*stored.columns)
    same = [stored[k].eqNullSafe(fresh[k]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return stored.join(fresh, condition, "left_anti").unionByName(fresh)


def append_history(stored: DataFrame, incoming: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows to append to a history table; with `keys`, rows already present (NULL equals NULL) are left out."""
    if not keys:
        return incoming
    condition = None
    for k in keys:
        same = incoming[k].eqNullSafe(stored[k])
        condition = same if condition is None else condition & same
    return incoming.join(stored, condition, "left_anti")


def snapshot_path(root: str, table: str, number: int) -> str:
    return f"{root.rstrip('/')}/{table}/snapshot={number:010d}"


def _numbers(spark: SparkSession, root: str, table: str) -> list[int]:
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{table}")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    done = []
    for status in fs.listStatus(base):
        path = status.getPath()
        if path.getName().startswith("snapshot=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            done.append(int(path.getName().split("=")[1]))
    return sorted(done)


def write_snapshot(df: DataFrame, root: str, table: str, number: int | None = None) -> int:
    """Write the next snapshot (or replace exactly `number`, so that a repeated micro-batch is harmless)."""
    if number is None:
        number = (_numbers(df.sparkSession, root, table) or [0])[-1] + 1
    df.write.mode("overwrite").parquet(snapshot_path(root, table, number))
    return number


def read_snapshot(spark: SparkSession, root: str, table: str, before: int | None = None) -> DataFrame | None:
    """The newest complete snapshot (below `before` if given), None when there is none."""
    numbers = [n for n in _numbers(spark, root, table) if before is None or n < before]
    return spark.read.parquet(snapshot_path(root, table, numbers[-1])) if numbers else None


def read_deltas(spark: SparkSession, root: str, table: str, before: int | None = None) -> DataFrame | None:
    """All complete snapshots (below `before` if given) of a table that only grows, with their number as `snapshot`."""
    numbers = [n for n in _numbers(spark, root, table) if before is None or n < before]
    if not numbers:
        return None
    paths = [snapshot_path(root, table, n) for n in numbers]
    return spark.read.option("basePath", f"{root.rstrip('/')}/{table}").parquet(*paths)


def read_current(spark: SparkSession, root: str, table: str, key: str, before: int | None = None) -> DataFrame | None:
    """The newest row of every key over all deltas: a batch writes what it changed, not the whole table."""
    deltas = read_deltas(spark, root, table, before)
    return None if deltas is None else keep_last(deltas, [key], "snapshot").drop("snapshot")
