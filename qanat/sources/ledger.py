"""The operational ledger's tables: parquet folders or a JDBC database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import MONEY


class ParquetLedger:
    """Ledger tables as folders: companies, users, accounts, beneficiaries, payments, transactions,
    scheduled_payments, outbox."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")


class JdbcLedger:
    """The same tables over JDBC. `splits` names a numeric column per large table, with its bounds, so that
    executors read ranges in parallel; other tables are read by one task."""

    def __init__(self, spark: SparkSession, url: str, options: Mapping[str, str] | None = None,
                 splits: Mapping[str, tuple[str, int, int, int]] | None = None):
        self.spark, self.url = spark, url
        self.options, self.splits = dict(options or {}), dict(splits or {})

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.format("jdbc").option("url", self.url).option("dbtable", name).options(**self.options)
        if name in self.splits:
            column, low, high, parts = self.splits[name]
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
        return reader.load()


class FrameLedger:
    """Ledger tables given as DataFrames."""

    def __init__(self, **tables: DataFrame):
        self.tables = tables

    def table(self, name: str) -> DataFrame:
        return self.tables[name]


def reference_accounts(ledger) -> DataFrame:
    return ledger.table("accounts").select(
        F.col("account_id").cast("int").alias("account_id"),
        F.col("company_id").cast("int").alias("company_id"),
        "account_kind",
        F.col("reference_balance").cast(MONEY).alias("reference_balance"),
    )


def scheduled_payments(ledger) -> DataFrame:
    return ledger.table("scheduled_payments").select(
        F.col("company_id").cast("int").alias("company_id"), "kind", F.col("amount").cast(MONEY).alias("amount"), "due_date"
    )


def scoring_state(forecast: DataFrame, anomalies: DataFrame) -> DataFrame:
    """What serving holds: one row per model version with its first forecast date (NULL for anomalies)."""
    keys = ["model_name", "model_version"]
    return forecast.groupBy(*keys).agg(F.min("forecast_date").alias("first_date")).unionByName(
        anomalies.select(*keys).distinct().withColumn("first_date", F.lit(None).cast("date"))
    )


def write_jdbc(df: DataFrame, url: str, table: str, options: Mapping[str, str] | None = None, batch: int = 1000) -> None:
    """Replace a database table's rows by a frame: executors fill a staging table of the same shape in
    parallel; the caller's database swaps it in one statement."""
    df.write.format("jdbc").mode("overwrite").options(**dict(options or {})).option("url", url).option(
        "dbtable", f"{table}_staging"
    ).option("batchsize", batch).save()
