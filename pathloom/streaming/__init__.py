"""Queries over streams of documents. A row is a document, so there is no state and no watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pathloom.plans.table import jsonpath_table


def start_matches(documents: DataFrame, query: str, sink: Callable[[DataFrame, int], None], checkpoint: str, column: str = "json", available_now: bool = False, **options) -> StreamingQuery:
    """Starts a stream that gives the matches of each batch of documents to sink(matches, batch_id).

    checkpoint keeps what has been read; a sink that overwrites what it wrote for the same batch_id makes it exactly once.
    available_now ends the stream when what is there is done.
    """
    writer = jsonpath_table(documents, column, query, **options).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
