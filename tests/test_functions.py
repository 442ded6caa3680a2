"""Column functions on literal rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from qanat.functions import money as m
from qanat.functions import text as x
from qanat.functions import times as t


def column(spark, values, dtype, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_aed_texts(spark):
    values = ["1900000.00", "-120000.00", "0.05", "90071992547409931.07", None, "12.5"]
    assert column(spark, values, "string", m.aed_text) == [
        "AED 1,900,000", "−AED 120,000", "AED 0.05", "AED 90,071,992,547,409,931.07", "—", "AED 12.50",
    ]
    assert column(spark, ["590000.00", "-225000.00"], "string", m.signed_aed_text) == ["+AED 590,000", "−AED 225,000"]


def test_fils_never_pass_a_float(spark):
    assert column(spark, ["90071992547409931.07", "-1.5", "x", "1.234"], "string", m.to_fils) == [9007199254740993107, -150, None, None]


def test_short_aed(spark):
    values = [190_000_000, 45_000_000, 99_900, -12_000_000, 200_000_000, 99_995_000]
    assert column(spark, values, "long", m.chart_label) == [
        "AED 1.9m", "AED 450k", "AED 999", "−AED 120k", "AED 2m", "AED 1000k",
    ]


def test_amount_input(spark):
    values = ["450,000", "AED 450000.5", "aed 1", "0", "-3", "1.234", "12a", " 7 "]
    assert column(spark, values, "string", m.typed_amount) == ["450000.00", "450000.50", "1.00", None, None, None, None, "7.00"]


def test_multiplier(spark):
    assert column(spark, [4.0, 3.54, 12.4, 9.96, 10.0, 2.25], "double", m.multiplier) == ["4", "3.5", "12", "10", "10", "2.2"]


def test_rounding_and_scores(spark):
    assert [str(v) for v in column(spark, ["0.005", "-0.005", "1.114999"], "string", lambda c: m.money(c.cast("decimal(20,6)")))] == ["0.01", "-0.01", "1.11"]
    assert [str(v) for v in column(spark, [1.7, -0.2, 0.81234], "double", m.score4)] == ["1.0000", "0.0000", "0.8123"]


def test_bad_text_gives_null(spark):
    assert column(spark, ["12.345", "abc", None], "string", m.parse_money)[1:] == [None, None]
    assert column(spark, ["2026-10-05T08:00:00", "2026-10-05T08:00:00+04:00", "soon"], "string", t.parse_ts) == [
        datetime(2026, 10, 5, 8), datetime(2026, 10, 5, 4), None,
    ]
    assert column(spark, ["2026-10-05", "x"], "string", t.parse_date) == [date(2026, 10, 5), None]


def test_gulf_day_starts_at_20_utc(spark):
    at = [datetime(2026, 10, 2, 20, 30), datetime(2026, 10, 2, 22, 0)]  # Friday evening UTC
    assert column(spark, at, "timestamp_ntz", t.gulf_date) == [date(2026, 10, 3)] * 2
    assert column(spark, at, "timestamp_ntz", t.gulf_weekend) == [True, True]
    assert column(spark, at, "timestamp_ntz", t.weekday_clock) == ["Saturday 00:30", "Saturday 02:00"]


def test_calendar(spark):
    days = [date(2026, 10, d) for d in (2, 3, 4, 5)]
    assert column(spark, days, "date", t.business_day) == [date(2026, 10, 2)] + [date(2026, 10, 5)] * 3
    assert column(spark, [date(2026, 10, 5), date(2026, 10, 6)], "date", t.next_payroll_thursday) == [date(2026, 10, 8), date(2026, 10, 15)]
    assert column(spark, days, "date", t.weekday) == [4, 5, 6, 0]


def test_iso_text(spark):
    at = [datetime(2026, 10, 5, 8), datetime(2026, 10, 5, 8, 0, 0, 120)]
    assert column(spark, at, "timestamp_ntz", t.iso_ts) == ["2026-10-05T08:00:00", "2026-10-05T08:00:00.000120"]


def test_payment_id_of_an_event(spark):
    df = spark.createDataFrame(
        [("payment", "7", "{}"), ("transaction", "9", '{"payment_id": 7}'), ("transaction", "9", "{bad"), ("payment", "x", "{}"),
         ("transaction", "9", '{"payment_id": null}')],
        "a string, b string, c string",
    )
    assert [r[0] for r in df.select(x.payment_id(F.col("a"), F.col("b"), F.col("c"))).collect()] == [7, 7, None, None, None]


def test_status_text(spark):
    df = spark.createDataFrame(
        [("EXECUTED", []), ("REJECTED", []), ("AWAITING_APPROVAL", ["A", "B"]), ("AWAITING_APPROVAL", [])], "s string, n array<string>"
    )
    assert [r[0] for r in df.select(x.status_text(F.col("s"), F.col("n"))).collect()] == [
        "Executed", "Rejected", "Awaiting approval from A or B", "Awaiting approval",
    ]


def test_seed_keys(spark):
    assert column(spark, [5], "long", lambda c: x.seed_event_id("payments", c)) == [-1_000_000_000_005]
    assert column(spark, [5], "long", lambda c: x.seed_key("transactions", c)) == ["seed-transactions-5"]


@pytest.mark.parametrize("bad", ["ledger", "x"])
def test_unknown_stage_is_refused(spark, bad):
    from qanat.operators.silver import trace_rows
    from qanat.plans.views import context

    with pytest.raises(ValueError):
        trace_rows(spark.range(1).withColumnRenamed("id", "payment_id"), bad, context())


def test_multiplier_rounds_the_binary_value(spark):
    from qanat.functions.money import multiplier

    values = [2.45, 0.35, 1.05, 9.95, 3.15, 0.25, 0.75, 0.05, 4.0, 3.5, 9.96, 10.5, 11.5, 12.0, 1e9, 0.0] + [i / 1000 for i in range(0, 10_000, 7)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", multiplier(F.col("x")).alias("t")).collect()
    for r in rows:
        want = f"{r.x:.0f}" if r.x >= 10 else f"{r.x:.1f}".removesuffix(".0")
        assert r.t == want, r


def test_clock_changes_of_the_session_zone_play_no_part(spark):
    from pyspark.sql import Window

    from qanat.functions.times import parse_ts, time_block
    from qanat.operators.skew import running

    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        texts = [(i, f"2026-03-29 {h:02d}:{m:02d}:00") for i, (h, m) in enumerate((h, m) for h in range(1, 5) for m in (0, 15, 30, 45))]
        rows = spark.createDataFrame(texts, "id long, text string").withColumn("t", F.col("text").cast("timestamp_ntz"))
        blocks = [r.b for r in rows.withColumn("b", time_block(F.col("t"), 60)).orderBy("t").collect()]
        assert blocks == sorted(blocks)
        done = running(rows, [], ["t", "id"], {"n": F.lit(1).cast("long")}, inclusive=True)
        assert [r.n for r in done.orderBy(F.col("text")).collect()] == list(range(1, 17))
        assert done.select(F.row_number().over(Window.orderBy("t")) == F.col("n")).distinct().count() == 1
        cases = [("2026-01-05T01:00:00Z", "2026-01-05 01:00:00"), ("2026-07-05T01:00:00+04:00", "2026-07-04 21:00:00"), ("2026-01-05 01:00:00.5", "2026-01-05 01:00:00.500000"), ("2026-01-05", "2026-01-05 00:00:00"), ("x", None), (None, None)]
        got = spark.createDataFrame(cases, "a string, b string").select(parse_ts(F.col("a")).alias("t"), "b").collect()
        assert [None if r.t is None else str(r.t) for r in got] == [r.b for r in got]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
