"""Upgrading streams.

Decoding and upgrading look at one row at a time, so the operators take a
streaming DataFrame as they are, without state or watermark.  What is left is
routing: one query that writes upgraded rows and failed rows apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.history import History
from tidemark.operators import from_versioned, split_ok_failed


def upgraded_stream(stream: DataFrame, history: History, envelope: str = "envelope") -> DataFrame:
    """A stream of envelopes as a stream of (record, source_version, error)."""
    return from_versioned(stream, history, envelope)


def route(upgraded: DataFrame, ok_path: str, failed_path: str, checkpoint: str, format: str = "parquet", **trigger) -> StreamingQuery:
    """Start a query that appends good rows to one table and failed rows to another.

    A batch that is repeated after a failure writes the same folder again, so
    each row is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for df, path in zip(split_ok_failed(batch), (ok_path, failed_path), strict=True):
                df.write.mode("overwrite").format(format).save(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return upgraded.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
