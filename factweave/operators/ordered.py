"""Order-dependent columns per key that do not need a whole key in one task.

A key's rows are cut into buckets of its order (a day, for example). Inside a bucket an ordinary window does the
work; what a bucket inherits from the ones before it is one row per (key, bucket), computed by a window over buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_range_bucket(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add a bucket of equal ranges of a numeric column, as many as a shuffle has partitions; it never falls as the column rises."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(column).cast("double")
    low, high = df.agg(F.min(value), F.max(value)).first()
    width = ((high or 0.0) - (low or 0.0)) / parts or 1.0
    return df.withColumn(name, F.floor((value - F.lit(low or 0.0)) / F.lit(width)))


def with_previous(df: DataFrame, key: str, bucket: str, order: list[str], columns: list[str], prefix: str = "prev_",
                  exists: str = "has_prev") -> DataFrame:
    """Add each column's value in the key's previous row, and whether there is one."""
    inside = Window.partitionBy(key, bucket).orderBy(*order)
    row = F.struct(*columns)
    ends = df.groupBy(key, bucket).agg(F.max_by(row, F.struct(*order)).alias("_end"))
    carry = ends.select(key, bucket, F.lag("_end").over(Window.partitionBy(key).orderBy(bucket)).alias("_carry"))
    staged = df.withColumn("_prev", F.lag(row).over(inside)).join(carry, [key, bucket], "left")
    staged = staged.withColumn("_prev", F.coalesce("_prev", "_carry"))
    return staged.select(*df.columns, *[F.col("_prev")[c].alias(prefix + c) for c in columns], F.col("_prev").isNotNull().alias(exists))


def running_merge(df: DataFrame, key: str, bucket: str, order: list[str], latest: list[str] = (), earliest: list[str] = (),
                  largest: list[str] = ()) -> DataFrame:
    """Running state per key: latest non-null, earliest non-null, largest value so far, replacing the columns."""
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    ends = df.groupBy(key, bucket).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in latest],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in earliest],
        *[F.max(c).alias(c) for c in largest])
    carry = ends.select(
        key, bucket,
        *[F.last(c, ignorenulls=True).over(before).alias(f"_b_{c}") for c in latest],
        *[F.first(c, ignorenulls=True).over(before).alias(f"_b_{c}") for c in earliest],
        *[F.max(c).over(before).alias(f"_b_{c}") for c in largest])
    staged = df.select("*", *[F.last(c, ignorenulls=True).over(inside).alias(f"_i_{c}") for c in latest],
                       *[F.first(c, ignorenulls=True).over(inside).alias(f"_i_{c}") for c in earliest],
                       *[F.max(c).over(inside).alias(f"_i_{c}") for c in largest]).join(carry, [key, bucket], "left")
    merged = {c: F.coalesce(f"_i_{c}", f"_b_{c}") for c in latest}
    merged |= {c: F.coalesce(f"_b_{c}", f"_i_{c}") for c in earliest}
    merged |= {c: F.greatest(f"_i_{c}", f"_b_{c}") for c in largest}
    return staged.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in df.columns])
