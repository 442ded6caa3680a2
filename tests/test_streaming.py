"""Streams: drain and stop, replayed micro-batches, the relay and in-flight dedupe."""

import pytest
from pyspark.sql import functions as F

from qanat.context import Settings
from qanat.operators.silver import to_bronze
from qanat.sources.events import export_json, from_kafka, kafka_options, keyed_records, read_stream, write_lines
from qanat.sources.lake import Lake
from qanat.streaming.ingest import dedupe_in_flight, drain
from qanat.streaming.relay import file_sink, relay
from tests.ledgers import NOW, job, land, ledger, transfer_lines


def lines_stream(spark, folder):
    return read_stream(spark, Settings(landing_dir=str(folder)))


def test_drain_takes_each_line_once(spark, tmp_path):
    j = job(spark, tmp_path, ledger(spark))
    land(j, "a", transfer_lines())
    ctx = j.settings.context("r", NOW)
    assert drain(j.lake, read_stream(spark, j.settings), ctx) == 0
    assert drain(j.lake, read_stream(spark, j.settings), ctx) == 0  # nothing new
    land(j, "b", transfer_lines(first_id=11))
    assert drain(j.lake, read_stream(spark, j.settings), ctx) == 1
    bronze = j.lake.read("bronze", "events")
    assert bronze.count() == 6
    assert bronze.where(F.col("source").endswith("a.jsonl")).count() == 3


def test_a_replayed_micro_batch_replaces_itself(spark, tmp_path):
    j = job(spark, tmp_path, ledger(spark))
    ctx = j.settings.context("r", NOW)
    raw = spark.createDataFrame([(b, "f") for b in transfer_lines()], "body string, source string")
    for _ in range(2):
        j.lake.put_batch(to_bronze(raw, ctx), "bronze", "events", 4)
    assert j.lake.read("bronze", "events").count() == 3


def test_unknown_source_is_refused(spark):
    with pytest.raises(ValueError):
        read_stream(spark, Settings(source="fax"))


def test_kafka_options_and_records(spark):
    with pytest.raises(ValueError):
        kafka_options(Settings(source="kafka"))
    o = kafka_options(Settings(source="kafka", kafka_servers="h:9093", kafka_connection_string="secret"))
    assert o["startingOffsets"] == "earliest" and o["failOnDataLoss"] == "false" and "secret" in o["kafka.sasl.jaas.config"]
    records = spark.createDataFrame([(bytearray(b"{}"), "t", 3, 14)], "value binary, topic string, partition int, offset long")
    assert from_kafka(records).first() == ("{}", "kafka:t:3:14")


def test_keyed_records_keep_a_companys_order(spark):
    rows = spark.createDataFrame([(i, i % 3, f"b{i}") for i in range(50)], "id long, company_id int, body string")
    parts = keyed_records(rows).withColumn("p", F.spark_partition_id()).collect()
    seen = {}
    for r in parts:
        seen.setdefault(r["key"], []).append((r["p"], int(r["value"][1:])))
    for pairs in seen.values():
        assert len({p for p, _ in pairs}) == 1 and [i for _, i in pairs] == sorted(i for _, i in pairs)


OUTBOX = "id long, company_id int, aggregate_type string, aggregate_id string, event_type string, payload string, created_at timestamp_ntz"


def outbox(spark, folder, ids):
    rows = [(i, 1, "payment", str(i), "payment.executed", "{}", NOW) for i in ids]
    spark.createDataFrame(rows, OUTBOX).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(OUTBOX).parquet(str(folder))


def test_relay_marks_only_what_the_sink_took(spark, tmp_path):
    j = job(spark, tmp_path, ledger(spark))
    ctx = j.settings.context("r", NOW)
    stream = outbox(spark, tmp_path / "outbox", [1, 2, 3])

    def broken(_rows):
        raise OSError("sink is down")

    with pytest.raises(Exception, match="sink is down"):
        relay(j.lake, stream, broken, ctx)
    assert not j.lake.exists("ops", "pipeline_trace")

    relay(j.lake, stream, file_sink(j.settings.landing_dir), ctx)
    relay(j.lake, outbox(spark, tmp_path / "outbox", [4]), file_sink(j.settings.landing_dir), ctx)
    landed = to_bronze(spark.read.text(j.settings.landing_dir).select(F.col("value").alias("body"), F.lit("f").alias("source")), ctx)
    assert sorted(r["event_id"] for r in landed.collect()) == [1, 2, 3, 4]
    assert {(r["payment_id"], r["stage"]) for r in j.lake.read("ops", "pipeline_trace").collect()} == {(i, "event_hubs") for i in range(1, 5)}


def test_relayed_events_arrive_in_bronze(spark, tmp_path):
    j = job(spark, tmp_path, ledger(spark))
    ctx = j.settings.context("r", NOW)
    relay(j.lake, outbox(spark, tmp_path / "outbox", [1, 2]), file_sink(j.settings.landing_dir), ctx)
    assert drain(j.lake, read_stream(spark, j.settings), ctx) == 0
    assert j.lake.read("bronze", "events").where("event_type = 'payment.executed'").count() == 2


def test_dedupe_in_flight(spark, tmp_path):
    j = job(spark, tmp_path, ledger(spark))
    land(j, "a", transfer_lines() + transfer_lines())
    ctx = j.settings.context("r", NOW)
    events = to_bronze(lines_stream(spark, j.settings.landing_dir), ctx).withColumn("event_created_at", F.col("ingested_at"))
    q = (
        dedupe_in_flight(events.select("event_id", "event_created_at")).writeStream.format("memory").queryName("unique_events")
        .outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert sorted(r["event_id"] for r in spark.table("unique_events").collect()) == [1, 2, 3]


def test_written_lines_come_back(spark, tmp_path):
    raw = spark.createDataFrame([("a", "x"), ("b", "y")], "body string, source string")
    write_lines(raw, str(tmp_path / "out"))
    write_lines(raw, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_lake_versions(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    assert not lake.exists("gold", "daily_flows")
    lake.overwrite(spark.range(3), "gold", "x")
    reader = lake.read("gold", "x")
    lake.publish({("gold", "x"): spark.range(5), ("gold", "y"): spark.range(2)})
    assert (reader.count(), lake.read("gold", "x").count(), lake.read("gold", "y").count()) == (3, 5, 2)


def test_partition_replace_keeps_other_dates(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))

    def rows(day, balance):
        return spark.createDataFrame(
            [(1, day, balance)], "company_id int, as_of_date string, total_cash int"
        ).select("company_id", F.col("as_of_date").cast("date").alias("as_of_date"), F.col("total_cash").cast("decimal(18,2)").alias("total_cash"))

    def whole(day, balance, company=1):
        base = rows(day, balance).withColumn("company_id", F.lit(company))
        blank = {c: F.lit(0).cast("decimal(18,2)") for c in ("available", "scheduled_out_7d", "payroll_due_amount", "forecast_low")}
        return base.withColumns({**blank, "payroll_due_date": F.lit(None).cast("date"), "refreshed_at": F.lit(None).cast("timestamp_ntz")})

    both = whole("2026-10-04", 1).unionByName(whole("2026-10-05", 2)).unionByName(whole("2026-10-05", 3, company=2))
    lake.replace_keyed(both, "serving", "cash_position", ["company_id", "as_of_date"])
    lake.replace_keyed(whole("2026-10-05", 9), "serving", "cash_position", ["company_id", "as_of_date"])
    got = {(r["company_id"], str(r["as_of_date"])): int(r["total_cash"]) for r in lake.read("serving", "cash_position").collect()}
    assert got == {(1, "2026-10-04"): 1, (1, "2026-10-05"): 9, (2, "2026-10-05"): 3}


def test_first_trace_row_stays(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))

    def row(at):
        return spark.createDataFrame([(1, "gold", at)], "payment_id long, stage string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))

    for at in ("2026-10-05 01:00:00", "2026-10-05 02:00:00"):
        lake.insert_absent(row(at), "ops", "pipeline_trace", ["payment_id", "stage"])
    assert [str(r["at"]) for r in lake.read("ops", "pipeline_trace").collect()] == ["2026-10-05 01:00:00"]


def test_export_as_json(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "b")], "id long, name string")
    export_json({"t": rows}, str(tmp_path / "out"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out" / "t")).collect())
    assert lines == ['{"id":1,"name":null}', '{"id":2,"name":"b"}']
