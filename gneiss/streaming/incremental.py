"""Incremental and resumable processing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gneiss.sources.sinks import NewestRows, Parts


def remaining(work: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Work that no checkpoint has yet."""
    return work if done is None else work.join(done.select(*keys).distinct(), keys, "left_anti")


def resume(work: DataFrame, keys: list[str], store: Parts, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs ``step`` on the remaining work and adds its results as one part; a second call does nothing twice."""
    store.add(step(remaining(work, store.current(), keys)))
    return store.current()


def keep_newest(stream: DataFrame, store: NewestRows, checkpoint: str) -> StreamingQuery:
    """Stream of re-crawled rows into a table of the newest row per key.

    A micro-batch is reduced to its newest rows and rewrites the buckets of its keys; replaying a batch changes nothing.
    """
    return stream.writeStream.foreachBatch(lambda batch, _: store.merge(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, time: str, late: str, width: str, by: str) -> DataFrame:
    """Rows per window of event time and group. In update or append mode the state of a window goes once the watermark passes it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("rows"))


def keep_counts(counted: DataFrame, store: NewestRows, checkpoint: str) -> StreamingQuery:
    """Counts that a stream updates, each the last of its key; ``store`` has ``rows`` as its age, as counts only grow."""
    return counted.writeStream.outputMode("update").foreachBatch(lambda batch, _: store.merge(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
