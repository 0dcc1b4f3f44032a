"""The composed scan, and streams over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factweave.config import ScanConfig
from factweave.operators.store import read_deltas
from factweave.plans import scan as scan_plan
from factweave.session import checkpoint_root
from factweave.streaming import ingest
from workload import sqlparts as S
from workload.feed_queries import NOW_DT
from workload.views import table, view

CONFIG = ScanConfig(max_extractions=None)


def _bulletins(spark, sf):
    return view(spark, sf, "v_bulletin")


def scan_funnel(spark, sf):
    """Funnel of one scan over all bulletins, last 30 days."""
    return scan_plan.funnel(scan_plan.scan(_bulletins(spark, sf), CONFIG, NOW_DT), "2001-07-31")


def scan_incidents(spark, sf):
    """Incidents that scan creates or updates."""
    found = scan_plan.scan(_bulletins(spark, sf), CONFIG, NOW_DT).incidents
    return found.select("incident_id", "title", F.col("incident_date").cast("string").alias("incident_date"), "country", "operator", "asset", "incident_type", "severity", "severity_score",
                        "confidence", "confidence_score", "relevance_score", "status", "source_count")


def _folder(spark, name):
    return f"{checkpoint_root(spark)}/factweave/{name}-{uuid.uuid4().hex}"


def _increments(spark, sf, name):
    """A driver table, a file or a folder of files, as a stream. A pattern finds either by its name."""
    return ingest.read_increments(spark, f"{sf.rstrip('/')}/{name}.parque[t]", table(spark, sf, name).schema)


def stream_daily_counts(spark, sf):
    """Events per day and type, counted by a stream that reads the table incrementally."""
    stream = _increments(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _folder(spark, "daily")
    ingest.run_available(ingest.daily_counts(stream, "ts", ["event_type"]), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}"), _folder(spark, "daily-cp"), "update")
    # A window's newest count replaces the ones of earlier batches.
    rows = spark.read.parquet(out)
    return rows.groupBy(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "event_type").agg(F.max_by("count", "batch").alias("count"))


DAILY_SQL = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS count FROM events GROUP BY ALL"


def stream_late_counts(spark, sf):
    """The same counts from six files out of order, some of which come long after their days were closed."""
    source, store = _folder(spark, "shuffled-events"), _folder(spark, "late")
    events = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    # Days 0, 6, 12, ... in one file, days 5, 11, ... in another, the newest days first; files are read in order of their writing.
    part = F.pmod(F.unix_date(F.to_date("ts")), F.lit(3)) + F.when(F.dayofmonth("ts") <= 15, 3).otherwise(0)
    for number in range(6):
        events.filter(part == number).coalesce(1).write.mode("append").parquet(source)
    stream = ingest.read_increments(spark, source, events.schema, files_per_batch=1)
    ingest.count_days(stream, "ts", ["event_type"], store, _folder(spark, "late-cp"), late="2 days")
    return ingest.counted_days(spark, store, ["event_type"]).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "count")


def stream_distinct_pages(spark, sf):
    """Page URLs that survive exact-key dedup in a stream."""
    stream = _increments(spark, sf, "pages").select(
        "url", F.lit(None).cast("string").alias("canonical_url"), F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("published_at"))
    store = _folder(spark, "pages")
    ingest.distinct_articles(stream, store, _folder(spark, "pages-cp"))
    return read_deltas(spark, store, "distinct").select("normalized_url")


PAGES_SQL = f"SELECT DISTINCT {S.normalise_url('url')} AS normalized_url FROM pages"


def stream_scan(spark, sf):
    """The scan as micro-batches over bulletin files: stage of every article."""
    source = _folder(spark, "bulletins")
    _bulletins(spark, sf).repartitionByRange(2, "seq").write.parquet(source)
    stream = ingest.read_increments(spark, source, _bulletins(spark, sf).schema, files_per_batch=1)
    store = _folder(spark, "store")
    ingest.scan_batches(stream, store, _folder(spark, "scan-cp"), CONFIG, NOW_DT)
    return spark.read.parquet(f"{store}/stages").groupBy("snapshot", "stage").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "scan_funnel": (scan_funnel, None),
    "scan_incidents": (scan_incidents, None),
    "stream_daily_counts": (stream_daily_counts, DAILY_SQL),
    "stream_late_counts": (stream_late_counts, DAILY_SQL),
    "stream_distinct_pages": (stream_distinct_pages, PAGES_SQL),
    "stream_scan": (stream_scan, None),
}
