"""One row per key, by hash or sort aggregation with map-side combine: copies of one hot key are
folded before the shuffle, however many there are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def earliest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The whole row that comes first in `order`, for each key."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(first.alias("_row")).select(key, *[F.col("_row")[c].alias(c) for c in rest])


def earliest_copy(bronze: DataFrame) -> DataFrame:
    """Of all deliveries of an event, the first ingested one; ties go to the smaller source name."""
    return earliest_per_key(bronze.where(F.col("event_id").isNotNull()), "event_id", ["ingested_at", "source"])


def latest_balance(transactions: DataFrame) -> DataFrame:
    """Balance and booking time of the highest transaction id (the posting order) per account."""
    return transactions.groupBy("account_id").agg(
        F.max_by("balance_after", "transaction_id").alias("lake_balance"),
        F.max_by("booked_at", "transaction_id").alias("last_booked_at"),
    )


def one_posting_per_id(transactions: DataFrame, **columns: Column) -> DataFrame:
    """One row per transaction id (the smallest event id wins), keeping only `columns`.

    With fixed-width columns the aggregation stays a code-generated hash aggregate.
    """
    return transactions.groupBy("transaction_id").agg(
        *[F.min_by(c, F.col("event_id")).alias(n) for n, c in columns.items()]
    )
