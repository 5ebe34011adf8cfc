"""Deals as a stream: late-tolerant deduplication and monthly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(deals: DataFrame, time: str, keys: list[str], late: str = "30 days") -> DataFrame:
    """One row per key among those that arrive within the watermark of each other."""
    return deals.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def deals_per_month(deals: DataFrame, time: str, late: str | None = "30 days") -> DataFrame:
    """(month, n) by event time, one row per month. For output mode ``update`` or ``complete``: a calendar month is no fixed
    window, so a count is final when the watermark has passed the month's end, and the state of a month stays.

    ``late`` is None for a stream that has its watermark already, as after ``deduplicated``."""
    marked = deals if late is None else deals.withWatermark(time, late)
    return marked.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
