"""Dashboard aggregates. Each block is one pass with partial aggregation; only counts travel."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.taxonomy import SEVERITIES, label

# (dimension, column, how many, labelled): fixed report layout
TOP_LISTS = (
    ("top_operators", "operator", 8, False),
    ("top_countries", "country", 8, False),
    ("top_incident_types", "incident_type", 8, True),
    ("by_sector", "oil_gas_sector", 5, True),
    ("by_lifecycle_stage", "lifecycle_stage", 11, True),
)


def _within(today: date, days: int) -> Column:
    return F.col("incident_date").between(F.lit(today - timedelta(days=days)), F.lit(today))


def recent(incidents: DataFrame, today: date, days: int = 30) -> DataFrame:
    return incidents.filter(_within(today, days))


def kpis(incidents: DataFrame, today: date) -> DataFrame:
    """One row of conditional counts over today, 7 and 30 days back (both ends counted)."""
    c = F.col
    month = _within(today, 30)
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    well_category = F.coalesce("well_integrity_category", F.lit(""))
    process = F.coalesce("process_safety_category", F.lit(""))
    return incidents.filter(month).agg(
        count(c("incident_date") == F.lit(today)).alias("incidents_today"),
        count(_within(today, 7)).alias("incidents_last_7_days"),
        F.count(F.lit(1)).alias("incidents_last_30_days"),
        count(c("severity") == "critical").alias("critical_incidents"),
        count(c("severity") == "high").alias("high_severity_incidents"),
        count(c("environment").isin("offshore", "subsea")).alias("offshore_incidents"),
        count(c("environment") == "onshore").alias("onshore_incidents"),
        count(c("is_well_integrity_related")).alias("well_integrity_incidents"),
        count(c("incident_type").isin("well_control", "blowout") | (well_category == "well_control")).alias("well_control_incidents"),
        count((c("incident_type") == "loss_of_containment") | (process == "loss_of_primary_containment")
              | (well_category == "loss_of_containment")).alias("loss_of_containment_incidents"),
        F.coalesce(F.bool_and("is_mock"), F.lit(False)).alias("is_mock"),
    )


def top_lists(incidents: DataFrame, today: date) -> DataFrame:
    """All top-k lists in one pass: (dimension, rank, key, label, count)."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("dimension"), F.col(column).alias("key"), F.lit(k).alias("k"), F.lit(labelled).alias("labelled"))
        for name, column, k, labelled in TOP_LISTS])
    counted = (
        recent(incidents, today).select(F.explode(entries).alias("e")).select("e.*")
        .filter(F.col("key") != "")
        .groupBy("dimension", "key", "k", "labelled").agg(F.count(F.lit(1)).alias("count"))
    )
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("count"), F.asc("key")))
    ranked = counted.withColumn("rank", rank).filter(F.col("rank") <= max(k for _, _, k, _ in TOP_LISTS)).filter(F.col("rank") <= F.col("k"))
    return ranked.select("dimension", "rank", "key", F.when(F.col("labelled"), label(F.col("key"))).otherwise(F.col("key")).alias("label"), "count")


def severity_buckets(incidents: DataFrame, today: date) -> DataFrame:
    """Counts for every severity, zeros included."""
    domain = incidents.sparkSession.createDataFrame([(s, i) for i, s in enumerate(reversed(SEVERITIES))], "key string, position int")
    counted = recent(incidents, today).groupBy(F.col("severity").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return domain.join(counted, "key", "left").select("position", "key", label(F.col("key")).alias("label"), F.coalesce("n", F.lit(0)).alias("count"))


def daily_trend(incidents: DataFrame, today: date, days: int = 30) -> DataFrame:
    """One row per day of the last `days` days, zero-filled."""
    spark = incidents.sparkSession
    calendar = spark.range(days).select(F.date_sub(F.lit(today), F.col("id").cast("int")).alias("date"))
    counted = incidents.filter(_within(today, days - 1)).groupBy(F.col("incident_date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counted, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("count"))


def visible_to(incidents: DataFrame, states: DataFrame, user_id) -> DataFrame:
    """Incidents the user has not archived."""
    hidden = states.filter((F.col("user_id") == F.lit(user_id)) & (F.col("state") == "archived")).select(F.col("incident_id").alias("id"))
    return incidents.join(hidden, "id", "left_anti")
