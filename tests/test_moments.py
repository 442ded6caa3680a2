"""Training from moments: the same profile as from every day of the history."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest

from qanat.functions.times import date_lit
from qanat.operators import forecast, gold_state
from qanat.operators.history import daily_flow_history
from qanat.plans import batch
from qanat.sources.lake import Lake
from tests.ledgers import NOW, job, land, ledger, transfer_lines

FLOWS = "company_id int, flow_date date, other_net decimal(18,2), supplier_net decimal(18,2), payroll_net decimal(18,2), transfer_net decimal(18,2)"


def flows(spark):
    rng, zero, out = random.Random(3), Decimal(0), []
    for company, start, days in ((1, date(2025, 11, 12), 200), (2, date(2026, 2, 27), 9), (3, date(2026, 3, 4), 40)):
        for k in range(days):
            if k == 0 or rng.random() < 0.6:
                other = Decimal(rng.randrange(-(10**14), 10**14)) / 100 if company == 1 else Decimal("1234567.89")
                out.append((company, start + timedelta(days=k), other, Decimal(rng.randrange(-(10**9), 0)) / 100, zero, zero))
    out.append((4, None, Decimal(5), Decimal(5), zero, zero))
    return spark.createDataFrame(out, FLOWS).cache()


@pytest.mark.parametrize("until", ["2025-11-12", "2025-11-13", "2026-01-01", "2026-03-01", "2026-03-05", "2026-03-31", "2026-12-24"])
def test_equals_a_fit_of_every_day(spark, until):
    daily, cut = flows(spark), date_lit(until)
    found = forecast.fit_from_moments(gold_state.flow_moments(daily), daily, cut)
    wanted = forecast.fit_profile(daily_flow_history(daily, cut))
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in wanted.schema]
    key = lambda r: (r["company_id"], r["weekday"])
    got, full = sorted(found.collect(), key=key), sorted(wanted.collect(), key=key)
    assert [key(r) for r in got] == [key(r) for r in full]
    for a, b in zip(got, full):
        assert (a["other_mean"], a["supplier_mean"], a["days"]) == (b["other_mean"], b["supplier_mean"], b["days"])
        assert a["other_sd"] == pytest.approx(b["other_sd"], rel=1e-9, abs=1e-3)
        assert a["supplier_sd"] == pytest.approx(b["supplier_sd"], rel=1e-9, abs=1e-3)


def test_equal_days_have_no_spread_and_empty_tables_no_profile(spark):
    rows = [(1, date(2026, 1, 5) + timedelta(days=k), Decimal("9999999999.99"), Decimal(0), Decimal(0), Decimal(0)) for k in range(28)]
    daily = spark.createDataFrame(rows, FLOWS)
    found = forecast.fit_from_moments(gold_state.flow_moments(daily), daily, date_lit("2026-02-02")).collect()
    assert len(found) == 7 and {(r["days"], r["other_sd"], r["other_mean"]) for r in found} == {(4, 0.0, Decimal("9999999999.99"))}
    none = daily.limit(0)
    assert forecast.fit_from_moments(gold_state.flow_moments(none), none, date_lit("2026-02-02")).collect() == []


def test_only_the_last_month_is_read_of_the_days(spark, tmp_path):
    flows(spark).where("flow_date is not null").write.parquet(f"{tmp_path}/daily")
    gold_state.flow_moments(flows(spark)).write.parquet(f"{tmp_path}/moments")
    read = spark.read.parquet
    plan = forecast.fit_from_moments(read(f"{tmp_path}/moments"), read(f"{tmp_path}/daily"), date_lit("2026-03-31"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(flow_date,2026-03-01)" in text and "LessThan(flow_date,2026-03-31)" in text
    assert "LessThan(month,2026-03-01)" in text


def test_the_lake_keeps_moments_of_what_it_holds(spark, tmp_path):
    """A later batch rewrites the moments of its buckets only; they equal those of all daily flows."""
    j = job(spark, tmp_path, ledger(spark))
    land(j, "a", transfer_lines())
    batch.run_batch(j, "run-a", NOW)
    land(j, "b", transfer_lines(payment_id=9_002, first_id=20, first_tx=6_000))
    batch.run_batch(j, "run-b", NOW)
    lake = Lake(spark, j.lake.root)
    wanted = sorted(map(repr, gold_state.flow_moments(lake.read("gold", "daily_flows")).collect()))
    assert wanted and sorted(map(repr, lake.read("state", "flow_moments").collect())) == wanted
