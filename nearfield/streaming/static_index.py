"""Streams of queries against a static index: each micro-batch is an ordinary search plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Answer a stream of (qid, embedding) with ``search`` and write a directory for each batch.

    A batch that is repeated after a failure replaces its own directory, so each query is answered once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        search(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_latency(events: DataFrame, ts: str, seconds: str, window: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Count and mean of a latency stream by tumbling window; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count("*").alias("n"), F.avg(seconds).alias("mean_seconds"))
