"""Broadcasts only of what was counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows; else as it is, for a shuffle join.

    At most ``max_rows + 1`` rows are counted.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
