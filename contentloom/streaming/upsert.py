"""Upsert records as they arrive into a snapshot table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from contentloom.operators.skew import pick
from contentloom.sources import snapshots

# Batches after which the changes are folded into the state.
FOLD_AFTER = 32


def upsert_stream(
    stream: DataFrame, root: str, key: Sequence[str], order: Sequence[str], checkpoint: str, available_now: bool = False, fold_after: int = FOLD_AFTER,
) -> StreamingQuery:
    """Add the newest row per key of each micro-batch to the table below ``root``.

    A batch costs what it holds, not what the table holds; every ``fold_after`` batches the changes are
    folded, so readers merge no more than that many and the log stays as short. A batch is published under
    the stream's identity, which lives in its checkpoint, and its number: a repeated batch changes
    nothing, while another stream or a new checkpoint never passes for it. A fold that failed is made up for
    by the next batch.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not snapshots.published(spark, root, stream_id, number):
            snapshots.publish_delta(pick(batch, list(key), order), root, stream_id, number)
        if snapshots.waiting(spark, root) >= fold_after:
            snapshots.compact(spark, root, key, order)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
