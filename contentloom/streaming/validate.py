"""Validate records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from contentloom.functions.model import Model
from contentloom.operators.validation import validate


def validated(stream: DataFrame, payload: str, m: Model) -> DataFrame:
    """Validation keeps no state, so the batch operator serves streams as it is."""
    return validate(stream, payload, m)


def validate_stream(stream: DataFrame, payload: str, m: Model, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Store valid and quarantined records as ``is_valid=true`` and ``is_valid=false``.

    The parquet sink commits each batch once, also when a batch is repeated.
    """
    writer = (
        validated(stream, payload, m).drop("validated_data")
        .writeStream.format("parquet").partitionBy("is_valid")
        .option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def validate_once_stream(
    stream: DataFrame, payload: str, m: Model, path: str, checkpoint: str, key: str, time: str, delay: str, available_now: bool = False,
) -> StreamingQuery:
    """As ``validate_stream``, but a record that comes again within ``delay`` is stored once.

    A record is known by ``key``. Spark keeps the keys it has seen until the watermark, the latest
    ``time`` less the delay, has passed them, so the state holds the keys of that span and no more; records that
    come later than that are dropped and counted in the query's progress. Only the first of a record's copies is parsed.
    """
    first = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return validate_stream(first, payload, m, path, checkpoint, available_now)
