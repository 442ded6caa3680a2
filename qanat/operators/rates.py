"""Request rates from cumulative counters (ts, region, workload, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import previous

SERIES = ("region", "workload")


def counter_increases(samples: DataFrame) -> DataFrame:
    """Each sample's increase since the series' previous one; after a reset the counter's own value counts.

    Samples are dealt by ranges of series and time, and each range hands its last sample on, so neither a busy series nor
    a busy minute is one task.
    """
    value, before = F.col("value"), F.col("_before")
    found = previous(samples.select("ts", *SERIES, "value"), SERIES, ("ts", "value"), {"_before": value})
    increase = F.when(value < before, value).otherwise(value - before)
    return found.select("ts", *SERIES, increase.alias("increase")).where(F.col("increase").isNotNull())


def request_rate(samples: DataFrame, by: tuple[str, ...] = ("region",), seconds: int = 60) -> DataFrame:
    """Per-second rate per window: the increase inside the window over its length. Unlike a scrape-aligned
    rate, nothing is extrapolated to the window's edges."""
    window = F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds")
    return (
        counter_increases(samples)
        .groupBy(window.alias("_w"), *by)
        .agg((F.sum("increase") / F.lit(float(seconds))).alias("rate"))
        .select(F.col("_w.start").cast("timestamp_ntz").alias("window_start"), *by, "rate")
    )


def latest_rate(rates: DataFrame) -> DataFrame:
    """The newest rate per region."""
    return rates.groupBy("region").agg(
        F.max("window_start").alias("window_start"), F.max_by("rate", "window_start").alias("rate")
    )
