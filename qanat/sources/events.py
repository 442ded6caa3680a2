"""Event sources: (body, source) streams from a landing folder or a Kafka topic."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import Settings


def kafka_options(s: Settings) -> dict[str, str]:
    """Reader options; a long pause past the topic's retention must not fail the job."""
    if not s.kafka_servers:
        raise ValueError("the kafka source needs kafka_servers")
    options = {
        "kafka.bootstrap.servers": s.kafka_servers,
        "subscribe": s.kafka_topic,
        "startingOffsets": "earliest",
        "failOnDataLoss": "false",
        "maxOffsetsPerTrigger": str(s.max_records_per_batch),
    }
    if s.kafka_connection_string:
        options |= {
            "kafka.security.protocol": "SASL_SSL",
            "kafka.sasl.mechanism": "PLAIN",
            "kafka.sasl.jaas.config": (
                "org.apache.kafka.common.security.plain.PlainLoginModule required "
                f'username="$ConnectionString" password="{s.kafka_connection_string}";'
            ),
        }
    return options


def from_kafka(records: DataFrame) -> DataFrame:
    """Kafka records -> (body, source); the source names topic, partition and offset."""
    return records.select(
        F.col("value").cast("string").alias("body"),
        F.concat_ws(":", F.lit("kafka"), "topic", "partition", "offset").alias("source"),
    )


def from_text(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("source"))


def read_stream(spark: SparkSession, s: Settings) -> DataFrame:
    if s.source == "kafka":
        return from_kafka(spark.readStream.format("kafka").options(**kafka_options(s)).load())
    if s.source == "files":
        return from_text(spark.readStream.format("text").option("maxFilesPerTrigger", s.max_files_per_batch).load(s.landing_dir))
    raise ValueError(f"source must be kafka or files, not {s.source!r}")


def write_lines(raw: DataFrame, folder: str) -> None:
    """One set of JSON-line files per call; the committer moves them into place when they are whole."""
    raw.select(F.col("body").alias("value")).write.mode("append").text(folder)


def keyed_records(outbox_lines: DataFrame) -> DataFrame:
    """(key, value) records for a topic keyed by company, in id order inside each company.

    Input: (id, company_id, body).
    """
    return (
        outbox_lines.repartition("company_id")
        .sortWithinPartitions("company_id", "id")
        .select(F.col("company_id").cast("string").alias("key"), F.col("body").alias("value"))
    )


def export_json(tables: Mapping[str, DataFrame], folder: str) -> None:
    """A whole dataset as JSON: one folder of JSON lines per table, written by the executors."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "static").option("ignoreNullFields", "false").json(f"{folder}/{name}")
