"""Thresholds and weights. Every operator takes these as arguments; the values here are the defaults."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: scoring, matching and paging defaults -------------------------------------------
RELEVANCE_FEED = 70
RELEVANCE_REVIEW = 50
CLASSIFIER_REJECT_BELOW = 0.35
TIE_BREAK_MIN_CONFIDENCE = 0.7
TIE_BREAK_MIN_HEADLINE = 0.7
NOTIFY_MIN_CONFIDENCE_SCORE = 50
ANSWER_TTL_SECONDS = 24 * 60 * 60
PUBLICATION_LEAD_IN_DAYS = 45

FUZZY_TITLE_SIMILARITY = (17, 19)  # 0.95 * containment >= 0.85, kept as the exact ratio 17/19
FUZZY_WINDOW_SECONDS = 48 * 3600
TITLE_WINDOW_SECONDS = 7 * 24 * 3600

GROUPING_WEIGHTS = {
    "date": 0.2,
    "country": 0.15,
    "operator": 0.2,
    "asset": 0.2,
    "incident_type": 0.1,
    "headline": 0.1,
    "entities": 0.05,
}
GROUPING_MATCH = 0.72
GROUPING_REVIEW = 0.55
GROUPING_MAX_GAP_DAYS = 7
GROUPING_FETCH_DAYS = 8
GROUPING_HEADLINE_ESCALATION = 0.75
GROUPING_MIN_COVERAGE = 0.75

PERIOD_DAYS = {"today": 0, "last_7_days": 7, "last_14_days": 14, "last_30_days": 30, "all_time": None}

TIER_CONFIDENCE_POINTS = {1: 45, 2: 32, 3: 25, 4: 14, 5: 5}
TIER_RELEVANCE_POINTS = {1: 20, 2: 16, 3: 14, 4: 8, 5: 4}
MODEL_SEVERITY_POINTS = {"low": 20, "moderate": 45, "high": 70, "critical": 90}


@dataclass(frozen=True)
class IncidentFilters:
    """The saved parameters of a feed request; empty lists mean no restriction."""

    period: str = "last_30_days"
    date_axis: str = "incident_date"
    from_date: str | None = None
    to_date: str | None = None
    query: str | None = None
    feed_filter: str = "all"
    sectors: tuple[str, ...] = ()
    severities: tuple[str, ...] = ()
    confidences: tuple[str, ...] = ()
    countries: tuple[str, ...] = ()
    operators: tuple[str, ...] = ()
    environments: tuple[str, ...] = ()
    lifecycle_stages: tuple[str, ...] = ()
    incident_types: tuple[str, ...] = ()
    well_integrity_only: bool = False
    process_safety_only: bool = False
    states: tuple[str, ...] = ()
    include_archived: bool = False
    min_relevance: int = 0
    limit: int = 25
    cursor: int = 0
    sort: str = "incident_date_desc"


@dataclass(frozen=True)
class ScanConfig:
    """Parameters of one scan run."""

    period: str = "last_30_days"
    date_axis: str = "incident_date"
    regions: tuple[str, ...] = ("worldwide",)
    custom_countries: tuple[str, ...] = ()
    include_keywords: tuple[str, ...] = ()
    exclude_keywords: tuple[str, ...] = ()
    max_extractions: int | None = None  # no budget: every article is extracted
    relevance_feed: int = RELEVANCE_FEED
    relevance_review: int = RELEVANCE_REVIEW
