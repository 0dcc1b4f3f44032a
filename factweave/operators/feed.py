"""Feed and search: filters, orders, pages and cards over an incident table.

Everything is a predicate or a top-k, so a page costs one scan with pushed-down filters and no full sort.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave import taxonomy as X
from factweave.config import IncidentFilters
from factweave.functions.text import fold_case, fold_literal
from factweave.functions.time import effective_date, passes_window, resolve_window

SEARCH_COLUMNS = ("title", "summary", "operator", "company", "asset", "installation", "field", "well_name", "country",
                  "region", "city", "incident_type")
FULL_TEXT_COLUMNS = ("title", "operator", "company", "asset", "installation", "field", "well_name", "country", "summary")
CARD_COLUMNS = ("id", "title", "summary", "incident_date", "country", "operator", "asset", "incident_type",
                "environment", "oil_gas_sector", "severity", "confidence", "source_count", "status",
                "last_updated_at", "detected_at", "is_well_integrity_related", "is_mock", "relevance_score")


def _is(column: Column) -> Column:
    """A tri-state flag counts only when it is true."""
    return F.coalesce(column, F.lit(False))


def _has(value: str) -> Column:
    return (F.col("incident_type") == value) | _is(F.array_contains("secondary_incident_types", value))


FEED_FILTERS = {
    "all": lambda: F.lit(True),
    "critical": lambda: F.col("severity") == "critical",
    "well_integrity": lambda: _is(F.col("is_well_integrity_related")),
    "well_control": lambda: F.col("incident_type").isin("well_control", "blowout")
    | _is(F.col("well_integrity_category") == "well_control") | _is(F.col("well_control_event")),
    "offshore": lambda: F.col("environment").isin("offshore", "subsea"),
    "drilling": lambda: F.col("lifecycle_stage").isin("drilling", "completion"),
    "production": lambda: F.col("lifecycle_stage").isin("production", "injection"),
    "pipeline": lambda: _is(F.col("installation_type") == "pipeline") | F.col("incident_type").isin("pipeline_leak", "pipeline_rupture"),
    "refinery": lambda: _is(F.col("installation_type") == "refinery"),
    "lng": lambda: _is(F.col("installation_type") == "lng_facility"),
    "fire": lambda: _has("fire"),
    "explosion": lambda: _has("explosion"),
    "leak_release": lambda: F.col("incident_type").isin(*X.LEAK_TYPES),
    "spill": lambda: (F.col("incident_type") == "oil_spill") | _is(F.col("spill")),
}


def matches_text(query: str) -> Column:
    """Every word of the query is a folded substring of the searchable columns taken together."""
    text = fold_case(F.concat_ws(" ", *SEARCH_COLUMNS))
    words = [w for w in fold_literal(query).split() if w]
    # The one-element array binds the folded text, so that it is computed once for all words.
    return F.exists(F.array(text), lambda t: reduce(lambda a, b: a & b, [F.contains(t, F.lit(w)) for w in words], F.lit(True)))


def full_text_candidates(query: str) -> Column:
    """Whole-word match of every query word over the indexed columns, or the query inside the title."""
    words = lambda text: F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    document = words(F.concat_ws(" ", *FULL_TEXT_COLUMNS))
    wanted = words(F.lit(query))
    all_words = (F.size(F.array_except(wanted, document)) == 0) & (F.size(wanted) > 0)
    return all_words | F.contains(F.lower("title"), F.lit(query.lower()))


def facet_conditions(filters: IncidentFilters) -> list[Column]:
    """OR inside a facet, AND across facets; an empty facet does not restrict."""
    plain = (("oil_gas_sector", filters.sectors), ("severity", filters.severities), ("confidence", filters.confidences),
             ("environment", filters.environments), ("lifecycle_stage", filters.lifecycle_stages), ("incident_type", filters.incident_types))
    conditions = [F.col(name).isin(*values) for name, values in plain if values]
    if filters.countries:
        conditions.append(fold_case(F.coalesce("country", F.lit(""))).isin(*[fold_literal(v) for v in filters.countries]))
    if filters.operators:
        name = fold_case(F.coalesce("operator", F.lit("")))
        conditions.append(reduce(lambda a, b: a | b, [F.contains(name, F.lit(fold_literal(v))) for v in filters.operators]))
    if filters.well_integrity_only:
        conditions.append(_is(F.col("is_well_integrity_related")))
    if filters.process_safety_only:
        conditions.append(_is(F.col("is_process_safety_event")))
    if filters.min_relevance:
        conditions.append(F.col("relevance_score") >= filters.min_relevance)
    return conditions


def visible(filters: IncidentFilters) -> Column:
    """By user state; no state means new, archived rows are hidden unless asked for."""
    state = F.coalesce("user_state", F.lit("new"))
    if filters.states:
        return state.isin(*filters.states)
    return F.lit(True) if filters.include_archived else state != "archived"


def with_user_state(incidents: DataFrame, states: DataFrame, user_id) -> DataFrame:
    """Join one user's states; `states` has one row per (user_id, incident_id)."""
    own = states.filter(F.col("user_id") == F.lit(user_id)).select(F.col("incident_id").alias("id"), F.col("state").alias("user_state"))
    return incidents.join(own, "id", "left")


def filter_incidents(incidents: DataFrame, filters: IncidentFilters, now: datetime) -> DataFrame:
    """All feed predicates; needs `first_published_at`, the publication time of the leading source."""
    window = resolve_window(now, filters.period, filters.from_date, filters.to_date)
    day = effective_date(F.col("incident_date"), F.col("first_published_at"), filters.date_axis)
    conditions = [passes_window(day, window), FEED_FILTERS[filters.feed_filter](), *facet_conditions(filters)]
    if filters.query and filters.query.strip():
        conditions.append(matches_text(filters.query))
    if "user_state" in incidents.columns:
        conditions.append(visible(filters))
    return incidents.filter(reduce(lambda a, b: a & b, conditions))


def feed_order(sort: str) -> list[Column]:
    """The four orders, with the id as tie-break."""
    orders = {
        "detected_at_desc": [F.desc_nulls_last("detected_at")],
        "severity_desc": [F.desc(X.severity_rank(F.col("severity"))), F.desc_nulls_last("severity_score"), F.desc_nulls_last("incident_date")],
        "relevance_desc": [F.desc_nulls_last("relevance_score")],
        "incident_date_desc": [F.desc_nulls_last("incident_date"), F.desc_nulls_last("last_updated_at")],
    }
    return [*orders[sort], F.asc("id")]


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page; planned as a top-k, never as a full sort."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def cards(incidents: DataFrame) -> DataFrame:
    return incidents.select(*CARD_COLUMNS)


def page_totals(filtered: DataFrame, offset: int, limit: int) -> DataFrame:
    """`total` rows behind a page and the next cursor, NULL on the last page."""
    after = F.least(F.col("total"), F.lit(offset + limit).cast("bigint"))
    return filtered.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.when((F.col("total") > offset) & (after < F.col("total")), after).alias("next_cursor"))


def leading_publication(evidence: DataFrame, key: str) -> DataFrame:
    """Publication time of the first source per incident: lowest tier, then newest."""
    newest_first = F.struct("source_tier", (-F.unix_micros(F.coalesce("published_at", F.lit("1970-01-01").cast("timestamp_ntz")).cast("timestamp"))).alias("_age"))
    return evidence.groupBy(key).agg(F.min_by("published_at", newest_first).alias("first_published_at"))
