"""Joins and aggregates that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import materialise, table_bytes

# A row of any table here takes at least this many bytes, so a smaller table cannot hold a hot key.
MIN_ROW_BYTES = 2
HOT_ROWS = 100_000
HOT_SHARE = 1_000
SALTS = 32
PAIRS_PER_TASK = 1 << 20


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_ROWS, share: int = HOT_SHARE) -> DataFrame:
    """Keys with at least `min_rows` rows, heaviest `share` of them.

    The result is bounded by `share` rows whatever the input, so it may be broadcast.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= min_rows)
    return counts.orderBy(F.desc("_rows"), key).limit(share).select(key)


def salted_join(many: DataFrame, few: DataFrame, key: str, spread: str, min_rows: int = HOT_ROWS,
                salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Join `many` (any key may be hot) with `few` (few rows per key), splitting hot keys over `salts` tasks.

    Rows of a hot key are spread by a hash of `spread`; the matching `few` rows are repeated once per salt. Rows of
    ordinary keys are left alone. A table too small to hold a hot key is joined as it is.
    """
    if table_bytes(many) < min_rows * MIN_ROW_BYTES:
        return many.join(few, key, how)
    hot = F.broadcast(hot_keys(many, key, min_rows).withColumn("_hot", F.lit(True)))
    salted = many.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    repeated = few.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def split_join(many: DataFrame, few: DataFrame, keys: list[str], spread: str, most_pairs: int = PAIRS_PER_TASK) -> DataFrame:
    """Inner join on `keys` in which no task makes many more than `most_pairs` pairs of one key.

    The pairs of every key are counted first. A key with more is dealt out: its `many` rows by a hash of `spread`, its
    `few` rows to all shares. The keys that are dealt out are written, so whether they are broadcast follows their true size.
    """
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_many")).join(few.groupBy(*keys).agg(F.count(F.lit(1)).alias("_few")), keys)
    shares = F.least(F.col("_many"), F.ceil(F.col("_many") * F.col("_few") / most_pairs)).cast("int")
    heavy = materialise(counts.filter(F.col("_many") * F.col("_few") > most_pairs).select(*keys, shares.alias("_shares")), "heavy-keys")
    # A number of its own keeps partitions from being merged for their few bytes: their pairs are many.
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if heavy.isEmpty():
        return many.repartition(parts, *keys).join(few.repartition(parts, *keys), keys)
    dealt = many.join(heavy, keys, "left").withColumn("_share", F.coalesce(F.pmod(F.xxhash64(spread), "_shares").cast("int"), F.lit(0))).drop("_shares")
    repeated = few.join(heavy, keys, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_shares"), F.lit(1)) - 1))).drop("_shares")
    keys = [*keys, "_share"]
    return dealt.repartition(parts, *keys).join(repeated.repartition(parts, *keys), keys).drop("_share")


def keep_first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key, the first in `order`. A partial aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key, the last in `order`."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)
