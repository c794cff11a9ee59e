"""The operators on streams: the scan as it is (one narrow stage), and counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarp.operators.scan import scan


def scan_stream(documents: DataFrame, **options) -> DataFrame:
    """Findings of a stream of documents, in append mode; the options are those of the scan. Nothing is kept between batches."""
    return scan(documents, **options)


def counts_by_time(findings: DataFrame, time: str, width: str = "1 hour", late: str = "1 day", slide: str | None = None, key: str = "rule_id") -> DataFrame:
    """Findings by window of ``time`` and ``key``: tumbling, or sliding by ``slide``.

    Rows later than ``late`` behind the latest time seen are dropped, as their window's state is gone; null times are in no window.
    """
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counted = findings.where(F.col(time).isNotNull()).withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("findings"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "findings")
