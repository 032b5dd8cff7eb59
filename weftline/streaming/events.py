"""Streaming forms of two batch operators; the reference pipeline has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_urls(articles: DataFrame, url: str = "url", time: str = "ts", late: str = "1 day") -> DataFrame:
    """First article of each URL, with state kept for as long as articles may be late."""
    return articles.withWatermark(time, late).dropDuplicatesWithinWatermark([url])


def counts(events: DataFrame, keys: list[str], time: str = "ts", width: str = "12 days", late: str = "1 day") -> DataFrame:
    """Counts in tumbling windows, each given out once it is complete."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
