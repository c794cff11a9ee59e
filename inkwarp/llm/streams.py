"""Deduplication of a stream, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from inkwarp.llm.history_dedup import HistoryIndex


def dedup_stream(records: DataFrame, index: HistoryIndex, units: Callable[[DataFrame], DataFrame], keys: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Add every micro-batch to the index and give (rec, first) of its repeats to ``sink``."""

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            index.add(units(df), keys(df))
            sink(index.firsts(), number)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
