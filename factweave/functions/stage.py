"""Where an expensive column is computed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, *columns: str) -> DataFrame:
    """Compute `columns` here, exactly once per row.

    A later filter on a derived column is normally pushed below the projection by copying the expression, and every
    column it builds on with it; for rule tables of a hundred patterns that multiplies the work. Passing the columns
    through a one-row generator keeps such filters above it. It adds no shuffle and no rows.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns)))).select(*df.columns)
