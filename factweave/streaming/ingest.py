"""Scans as micro-batches: incremental file ingest, exact-key dedup in a stream, daily counts, the whole scan per batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from factweave.config import ScanConfig
from factweave.functions.url import normalise_url
from factweave.operators.skew import keep_first
from factweave.operators.store import read_current, read_deltas, read_snapshot, write_snapshot
from factweave.plans.scan import scan
from factweave.session import materialise

# Room for the articles of one micro-batch in `seq`.
BATCH_SPAN = 10**12


def read_increments(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", pattern: str | None = None,
                    files_per_batch: int | None = None) -> DataFrame:
    """A directory of files as a stream; every file is read once, whenever the query is triggered."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def distinct_articles(stream: DataFrame, store: str, checkpoint: str, table: str = "distinct") -> StreamingQuery:
    """Never the same URL twice, however late an article comes: what is new is appended to `table` in `store`.

    A batch keeps the earliest article of each URL and drops URLs that earlier batches wrote. There is no watermark, since
    one would lose articles older than it; what is remembered are the written URLs.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("normalized_url", normalise_url(F.coalesce("canonical_url", "url")))
        fresh = keep_first(keyed, ["normalized_url"], "published_at", "url")
        known = read_deltas(batch.sparkSession, store, table, before=batch_id + 1)
        if known is not None:
            fresh = fresh.join(known.select("normalized_url"), "normalized_url", "left_anti")
        write_snapshot(fresh, store, table, batch_id + 1)

    return run_available(stream, one_batch, checkpoint)


def daily_counts(stream: DataFrame, time: str, keys: list[str], late: str = "45 days") -> DataFrame:
    """Tumbling one-day counts in the state of a stream; rows later than `late` are dropped with it. `count_days` keeps them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("day"), *keys).agg(F.count(F.lit(1)).alias("count"))


def count_days(stream: DataFrame, time: str, keys: list[str], store: str, checkpoint: str, late: str = "45 days") -> StreamingQuery:
    """Counts per day and `keys` that lose no row: `counted_days` reads them at any time.

    A batch writes its own counts, no state is held. Days that ended more than `late` before the newest time of earlier batches
    are closed: rows that come for them go into the table of corrections, so that whoever took over a closed day can see what has
    changed since. A batch that is repeated writes the same rows again. Rows without a time are counted with a null day.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, batch_id + 1
        day = F.to_date(time)
        rows = materialise(batch.groupBy(day.alias("day"), *keys).agg(F.count(F.lit(1)).alias("count"), F.max(time).alias("newest")), "day-counts")
        marks = read_deltas(spark, store, "marks", before=number)
        seen = None if marks is None else marks.agg(F.max("newest")).first()[0]
        closed = F.lit(False) if seen is None else F.coalesce(F.col("day") + F.expr("INTERVAL 1 DAY") <= F.lit(seen) - F.expr(f"INTERVAL {late}"), F.lit(False))
        write_snapshot(rows.filter(~closed).drop("newest"), store, "counts", number)
        write_snapshot(rows.filter(closed).drop("newest"), store, "corrections", number)
        write_snapshot(rows.agg(F.max("newest").alias("newest")), store, "marks", number)

    return run_available(stream, one_batch, checkpoint)


def counted_days(spark: SparkSession, store: str, keys: list[str]) -> DataFrame:
    """(day, keys, count, corrections): all counts of `count_days`, and how many of them came after the day was closed."""
    counts, late = (read_deltas(spark, store, name) for name in ("counts", "corrections"))
    both = counts.select("day", *keys, "count", F.lit(0).alias("late")).unionByName(late.select("day", *keys, "count", F.lit(1).alias("late")))
    return both.groupBy("day", *keys).agg(F.sum("count").alias("count"), F.sum(F.col("count") * F.col("late")).alias("corrections"))


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there, batch by batch, then stop."""
    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def scan_batches(articles: DataFrame, store: str, checkpoint: str, config: ScanConfig, now: datetime, **options) -> StreamingQuery:
    """The whole scan per micro-batch against the tables in `store`.

    Batch n reads what the batches before it wrote and writes exactly delta n + 1 of each table, so a batch that is repeated
    after a failure gives the same state instead of counting its articles twice, and what it writes follows the batch, not
    the history. Files arrive in any order, so `seq` counts inside a batch and batches follow one another: it is shifted by
    `BATCH_SPAN` per batch. Articles beyond the extraction budget wait in a table of their own and come first in the next
    batch.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark, number = batch.sparkSession, batch_id + 1
        batch = batch.withColumn("seq", F.col("seq") + F.lit(batch_id * BATCH_SPAN))
        waiting = read_snapshot(spark, store, "deferred", before=number)
        if waiting is not None:
            batch = waiting.unionByName(batch, allowMissingColumns=True)
        known, links, moved = (read_deltas(spark, store, name, before=number) for name in ("articles", "links", "changes"))
        known = None if known is None else known.drop("snapshot")
        result = scan(batch, config, now, stored_articles=known, stored_incidents=read_current(spark, store, "incidents", "incident_id", before=number),
                      stored_links=links, stored_changes=moved, **options)
        added = result.articles
        if known is not None:
            added = added.join(known.select("normalized_url"), "normalized_url", "left_anti").select(*added.columns)
        put_off = result.stages.filter("stage = 'deferred'").select("seq")
        tables = {"articles": added, "incidents": result.incidents, "links": result.links, "changes": result.changes, "entities": result.entities,
                  "evidence": result.evidence, "highlights": result.highlights, "stages": result.stages, "deferred": batch.join(put_off, "seq", "left_semi")}
        for name, rows in tables.items():
            write_snapshot(rows, store, name, number)

    return run_available(articles, one_batch, checkpoint)
