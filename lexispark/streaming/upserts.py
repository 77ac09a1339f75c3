"""Upserts from a stream: each micro-batch replaces documents by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Store


def upsert_stream(stream: DataFrame, store: Store, checkpoint: str, available_now: bool = True, order: str | None = None) -> StreamingQuery:
    """Starts a query that upserts the stream into the store; of rows of one id the newest by the order column counts.

    The store's pointer records the last batch of the stream (by its checkpoint), so a batch that is replayed after it went live is left out.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store.upsert(batch, order, (checkpoint, number))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def first_by_id(stream: DataFrame, key: str, watermark: str, delay: str) -> DataFrame:
    """The first row of each id within the watermark's delay."""
    return stream.withWatermark(watermark, delay).dropDuplicatesWithinWatermark([key])
