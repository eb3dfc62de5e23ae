"""Structured Streaming into an index: each micro-batch is one atomic append, made once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.index import VectorIndex


def append_batch(index: VectorIndex, batch: DataFrame, number: int, stream: str, order: list[str] | None = None) -> bool:
    """Append a micro-batch and its number by one commit; whether it was new. One that is committed already (the writer
    died after its commit and before the stream's) changes nothing, and a failed one leaves nothing behind."""
    if number <= index.last_batch(stream) or batch.isEmpty():
        return False
    index.flush()
    try:
        index.add_batch(batch, order)
        index.flush(batch=(stream, number))
    except BaseException:
        index.discard()
        raise
    return True


def ingest(stream: DataFrame, index: VectorIndex, checkpoint: str, order: list[str] | None = None, **trigger) -> StreamingQuery:
    """Append the column `embedding` of every micro-batch to `index` and commit it; the checkpoint names the stream. An
    empty batch commits nothing."""
    put = stream.writeStream.foreachBatch(lambda batch, number: append_batch(index, batch, number, checkpoint, order) and None)
    return put.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
