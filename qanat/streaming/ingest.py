"""Drain-and-stop ingestion of events into bronze."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import RunContext
from ..operators.silver import to_bronze
from ..sources.lake import BATCH, Lake


def drain(lake: Lake, stream: DataFrame, ctx: RunContext, name: str = "bronze_events") -> int:
    """Append everything new since the checkpoint, then stop. Returns the last batch in bronze (-1 = none).

    A micro-batch is written as its own partition, so one that is replayed after a failure replaces
    itself instead of doubling.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        lake.put_batch(to_bronze(batch, ctx), "bronze", "events", batch_id)
        lake.advance("bronze", batch_id)

    query = (
        stream.writeStream.foreachBatch(put)
        .option("checkpointLocation", lake.checkpoint(name))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return lake.progress("bronze")


def new_events(lake: Lake, after: int) -> DataFrame:
    """Bronze rows of later batches than `after`; only their partitions are read."""
    return lake.read_or_empty("bronze", "events").where(F.col(BATCH) > after)


def dedupe_in_flight(stream: DataFrame, delay: str = "1 day", event_time: str = "event_created_at") -> DataFrame:
    """Drop redelivered events inside the stream. State is bounded by the watermark: a copy that comes
    later than `delay` passes here and is dropped by the silver merge."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["event_id"])
