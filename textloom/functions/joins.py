"""Broadcasts of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 100_000


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``most`` rows, which is looked up; else df itself, for a join by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
