"""Read plans: feed page, its totals, and search."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame

from factweave.config import IncidentFilters
from factweave.operators import feed


def feed_page(incidents: DataFrame, filters: IncidentFilters, now: datetime) -> DataFrame:
    """Cards of one page: filter, top-k, project."""
    rows = feed.filter_incidents(incidents, filters, now)
    return feed.cards(feed.page(rows, feed.feed_order(filters.sort), filters.cursor, filters.limit))


def feed_totals(incidents: DataFrame, filters: IncidentFilters, now: datetime) -> DataFrame:
    """Total rows behind the page and the next cursor."""
    return feed.page_totals(feed.filter_incidents(incidents, filters, now), filters.cursor, filters.limit)


def search(incidents: DataFrame, query: str, now: datetime, filters: IncidentFilters = IncidentFilters(), prefilter: bool = False) -> DataFrame:
    """Incidents answering a query; a query always looks at all time. `prefilter` adds the whole-word index test."""
    rows = incidents.filter(feed.full_text_candidates(query)) if prefilter else incidents
    return feed.filter_incidents(rows, replace(filters, query=query, period="all_time", from_date=None, to_date=None), now)
