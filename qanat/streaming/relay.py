"""Publish outbox rows at least once: a row counts as published only after the sink has taken it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import RunContext
from ..operators.posting import event_payment_ids, raw_lines
from ..operators.silver import trace_rows
from ..sources.events import write_lines
from ..sources.lake import Lake


def file_sink(folder: str) -> Callable[[DataFrame], None]:
    return lambda rows: write_lines(raw_lines(rows, F.lit("outbox")), folder)


def relay(
    lake: Lake, outbox_stream: DataFrame, send: Callable[[DataFrame], None], ctx: RunContext, name: str = "relay"
) -> None:
    """Send everything new in the outbox, then trace it. The stream's checkpoint is the published mark: when
    the sink fails, the micro-batch is not committed and the next run sends it again."""

    def publish(batch: DataFrame, _batch_id: int) -> None:
        send(batch)
        ids = trace_rows(event_payment_ids(batch), "event_hubs", ctx)
        lake.insert_absent(ids, "ops", "pipeline_trace", ["payment_id", "stage"])

    query = (
        outbox_stream.writeStream.foreachBatch(publish)
        .option("checkpointLocation", lake.checkpoint(name))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
