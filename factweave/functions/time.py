"""Windows and effective dates. All day arithmetic is in UTC dates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.config import PERIOD_DAYS


@dataclass(frozen=True)
class TimeWindow:
    """Inclusive date bounds; `from_date` is None for all time."""

    from_date: date | None
    to_date: date


def _parse(value: str | None) -> date | None:
    try:
        return date.fromisoformat(value) if value and len(value) == 10 else None
    except ValueError:
        return None


def resolve_window(now: datetime, period: str, from_date: str | None = None, to_date: str | None = None) -> TimeWindow:
    """An explicit start overrides the period; an explicit end counts only together with a start."""
    start = _parse(from_date)
    if start is not None:
        return TimeWindow(start, _parse(to_date) or now.date())
    days = PERIOD_DAYS[period]
    return TimeWindow(None if days is None else now.date() - timedelta(days=days), now.date())


def effective_date(incident_date: Column, published_at: Column, axis: str) -> Column:
    """The date a record is filtered on: publication day only, or incident date falling back to it."""
    published = published_at.cast("date")
    return published if axis == "published_at" else F.coalesce(incident_date, published)


def effective_date_is_estimate(incident_date: Column, published_at: Column, axis: str) -> Column:
    if axis == "published_at":
        return F.lit(False)
    return incident_date.isNull() & published_at.isNotNull()


def in_window(day: Column, window: TimeWindow) -> Column:
    """True when the date lies inside; an unknown date never does."""
    inside = day <= F.lit(window.to_date)
    if window.from_date is not None:
        inside = inside & (day >= F.lit(window.from_date))
    return F.coalesce(inside, F.lit(False))


def passes_window(day: Column, window: TimeWindow) -> Column:
    """The feed's rule: all time lets everything pass, including dates after the window."""
    return F.lit(True) if window.from_date is None else in_window(day, window)


def passes_publication_window(published_at: Column, window: TimeWindow, lead_in_days: int) -> Column:
    """Publication pre-filter: not older than the lead-in before the window, not after it, NULL passes."""
    if window.from_date is None:
        return F.lit(True)
    day = published_at.cast("date")
    return F.coalesce((F.datediff(F.lit(window.from_date), day) <= lead_in_days) & (day <= F.lit(window.to_date)), F.lit(True))
