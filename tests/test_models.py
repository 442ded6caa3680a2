"""Forecast figures on golden input, and the forest against a plain reading of its definition."""

import math
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from qanat.context import RunContext
from qanat.operators import anomaly, forecast, forest, history, serving
from qanat.operators.gold import daily_flows, payment_features
from tests.ledgers import AS_OF, BALANCES, NOW, ledger, money

CTX = RunContext("r", NOW, AS_OF)


def cash(spark, extra=0):
    rows = [(AS_OF, 1, k, money(Decimal(v) + (extra if k == "operating" else 0))) for k, v in BALANCES.items()]
    return spark.createDataFrame(rows, "position_date date, company_id int, account_kind string, balance decimal(18,2)")


def scheduled(spark, *rows):
    return spark.createDataFrame([(1, k, money(a), d) for k, a, d in rows], "company_id int, kind string, amount decimal(18,2), due_date date")


def test_golden_position(spark):
    p = serving.company_position(cash(spark), ledger(spark).table("scheduled_payments"), None, CTX).first()
    assert (p["total_cash"], p["available"], p["forecast_low"]) == (money(5_800_000), money(1_780_000), money(-120_000))
    assert p["scheduled_out_7d"] == money(1_780_000)


@pytest.mark.parametrize(("offset", "low"), [(9, 3_559_900), (10, 3_560_000)])
def test_payroll_counts_up_to_nine_days_ahead(spark, offset, low):
    s = scheduled(spark, ("payroll", 60, AS_OF + timedelta(days=offset)), ("payroll", 40, AS_OF + timedelta(days=offset)))
    p = serving.company_position(cash(spark), s, None, CTX).first()
    assert (p["payroll_due_amount"], p["forecast_low"]) == (money(100), money(low))


def test_no_schedule_means_zero_and_no_payroll(spark):
    p = serving.company_position(cash(spark), scheduled(spark, ("payroll", 5, AS_OF - timedelta(days=1))), None, CTX).first()
    assert (p["scheduled_out_7d"], p["payroll_due_date"], p["payroll_due_amount"]) == (money(0), None, None)
    assert p["forecast_low"] == p["available"] == money(3_560_000)


def test_a_company_without_accounts_has_no_position(spark):
    s = spark.createDataFrame([(7, "payroll", money(1), AS_OF)], "company_id int, kind string, amount decimal(18,2), due_date date")
    assert [r["company_id"] for r in serving.company_position(cash(spark), s, None, CTX).collect()] == [1]


def test_known_payroll_wins_over_its_repeat(spark):
    s = scheduled(spark, ("payroll", 100, AS_OF), ("payroll", 70, AS_OF + timedelta(days=28)), ("payroll", 30, AS_OF + timedelta(days=1)))
    days = forecast.payroll_days(forecast.known_outflows(s, F.lit(AS_OF)), F.lit(AS_OF))
    got = {(r["day"] - AS_OF).days: r["amount"] for r in days.collect()}
    assert got == {0: money(100), 1: money(30), 28: money(70), 29: money(30)}


def flow_history(spark, days=56):
    start = AS_OF - timedelta(days=days)
    rows = [(1, start + timedelta(days=i), money(1000 * ((start + timedelta(days=i)).weekday() + 1)), money(-100), money(0), money(0)) for i in range(days)]
    return history.daily_flow_history(
        spark.createDataFrame(rows, "company_id int, flow_date date, other_net decimal(18,2), supplier_net decimal(18,2), payroll_net decimal(18,2), transfer_net decimal(18,2)"),
        F.lit(AS_OF),
    )


def project(spark, s, extra=0):
    profile = forecast.fit_profile(flow_history(spark))
    rows = forecast.project(profile, forecast.latest_non_reserve(cash(spark, extra)), s, F.lit(AS_OF))
    return rows.orderBy("forecast_date").collect()


def test_projection_day_by_day(spark):
    s = scheduled(spark, ("supplier", 500, AS_OF + timedelta(days=2)), ("tax", 50, AS_OF + timedelta(days=3)), ("payroll", 9000, AS_OF + timedelta(days=3)))
    rows = project(spark, s)
    balance = money(3_560_000)
    for k, r in enumerate(rows):
        day = AS_OF + timedelta(days=k)
        balance += money(1000 * (day.weekday() + 1))
        balance -= {2: 500, 3: 9050}.get(k, 0)
        if k > 3:  # past the last known supplier date (tax counts as one)
            balance -= 100
        assert (r["forecast_date"], r["predicted_balance"]) == (day, balance)
        assert r["lower_bound"] == r["upper_bound"] == balance  # a perfectly regular history has no spread
    assert len(rows) == 30


def test_more_cash_moves_the_whole_path(spark):
    s = ledger(spark).table("scheduled_payments")
    a, b = project(spark, s), project(spark, s, extra=450_000)
    assert {y["lower_bound"] - x["lower_bound"] for x, y in zip(a, b)} == {money(450_000)}


def test_one_observation_has_no_spread(spark):
    profile = forecast.fit_profile(flow_history(spark, days=7)).collect()
    assert len(profile) == 7 and all(r["other_sd"] == 0.0 and r["days"] == 1 for r in profile)


def test_history_fills_quiet_days(spark):
    flows = spark.createDataFrame(
        [(1, AS_OF - timedelta(days=5), *[money(1)] * 4), (1, AS_OF - timedelta(days=2), *[money(2)] * 4), (1, AS_OF, *[money(9)] * 4),
         (2, AS_OF, *[money(9)] * 4)],
        "company_id int, flow_date date, other_net decimal(18,2), supplier_net decimal(18,2), payroll_net decimal(18,2), transfer_net decimal(18,2)",
    )
    rows = history.daily_flow_history(flows, F.lit(AS_OF)).orderBy("flow_date").collect()
    assert [int(r["other_net"]) for r in rows] == [1, 0, 0, 2, 0]
    assert [r["weekday"] for r in rows] == [(AS_OF - timedelta(days=d)).weekday() for d in (5, 4, 3, 2, 1)]


def test_backtest_of_a_regular_history(spark):
    row = forecast.backtest(flow_history(spark)).first()
    assert (row["holdout_mae"], row["band80_coverage"], row["companies"], row["training_days"]) == (0.0, 1.0, 1.0, 56.0)
    assert row["naive_mae"] > 0 and row["mae_skill"] == 1.0
    assert forecast.backtest(flow_history(spark, days=20)).count() == 0  # nothing left to fit on


PAY = "event_id long, payment_id long, company_id int, status string, from_account_id int, to_account_id int, beneficiary_id int, beneficiary_name string, amount decimal(18,2), value_date date, executed_at timestamp_ntz"


def features(spark, rows):
    tx = spark.createDataFrame([], "payment_id long, transaction_id long, amount decimal(18,2)")
    return payment_features(spark.createDataFrame(rows, PAY), tx, CTX)


def test_first_time_needs_28_days_of_history(spark):
    def pay(i, ben, days):
        at = NOW - timedelta(days=60) + timedelta(days=days)
        return (i, i, 1, "EXECUTED", 1, None, ben, f"S{ben}", money(100), at.date(), at)

    got = {r["payment_id"]: r for r in features(spark, [pay(1, 5, 0), pay(2, 6, 27), pay(3, 7, 28), pay(4, 7, 29)]).collect()}
    assert [got[i]["is_first_time_beneficiary"] for i in (1, 2, 3, 4)] == [False, False, True, False]
    assert [got[i]["beneficiary_prior_count"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]


def test_own_transfers_have_no_payee_history(spark):
    at = NOW
    rows = [(i, i, 1, "EXECUTED", 1, 2, None, None, money(100), at.date(), at + timedelta(minutes=i)) for i in range(1, 5)]
    rows += [(9, 4, 1, "EXECUTED", 1, 2, None, None, money(100), at.date(), at + timedelta(minutes=4))]  # redelivered
    got = {r["payment_id"]: r for r in features(spark, rows).collect()}
    assert [got[i]["same_day_duplicates"] for i in (1, 2, 3, 4)] == [0, 1, 2, 3]
    assert all(r["beneficiary_prior_count"] is None and r["amount_to_prior_mean"] is None for r in got.values())


def test_flows_drop_unknown_accounts_and_reserve(spark):
    accounts = spark.createDataFrame([(1, 1, "operating", money(0)), (2, 1, "reserve", money(0))], "account_id int, company_id int, account_kind string, reference_balance decimal(18,2)")
    tx = spark.createDataFrame(
        [(1, 1, 1, 1, money(10), "customer", AS_OF), (2, 2, 1, 2, money(20), "transfer", AS_OF), (3, 3, 1, 7, money(40), "fee", AS_OF),
         (4, 1, 1, 1, money(99), "customer", AS_OF), (5, 5, 1, 1, money(-3), "supplier", AS_OF)],
        "event_id long, transaction_id long, company_id int, account_id int, amount decimal(18,2), category string, value_date date",
    )
    row = daily_flows(tx, accounts, CTX).first()
    assert (row["other_net"], row["supplier_net"], row["transfer_net"], row["total_net"]) == (money(10), money(-3), money(0), money(7))


# ---------------------------------------------------------------- forest


def test_expected_path():
    assert forest.expected_path(np.array([1, 2])).tolist() == [0.0, 1.0]
    assert forest.expected_path(256.0) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_tree_splits_every_cell_apart_and_counts_weights():
    rng = np.random.default_rng(1)
    values = np.column_stack([np.arange(40.0), np.zeros(40)])
    weights = np.ones(40)
    weights[0] = 1000.0
    tree = forest.grow_tree(values, weights, rng)
    leaves = tree[tree["feature"] < 0]
    assert set(tree.loc[tree["feature"] >= 0, "feature"]) == {0}  # the constant column is never split
    paths = forest.walk(values, tree)
    assert len(paths) == 40 and paths.max() <= math.ceil(math.log2(1039)) + forest.expected_path(1000.0)
    # A heavy cell ends deeper than its depth alone: copies count as points that are still together.
    assert paths[0] > forest.expected_path(999.0)
    assert len(leaves) == 40


def test_weighted_cells_score_like_repeated_points():
    """Repeating a point gives the same expected path as weighting its cell."""
    rng = np.random.default_rng(3)
    values, weights = rng.normal(size=(60, 2)).round(1), rng.integers(1, 5, size=60).astype(float)
    repeated = np.repeat(values, weights.astype(int), axis=0)

    def mean_path(points, w):
        return np.mean([forest.walk(values, forest.grow_tree(points, w, np.random.default_rng([9, t]))) for t in range(300)], axis=0)

    assert np.allclose(mean_path(values, weights), mean_path(repeated, np.ones(len(repeated))), rtol=0.15)


def test_scores_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *[float(v) for v in rng.normal(size=2).round(2)], int(rng.integers(8, 17)), 0, 0, 0) for i in range(400)]
    rows.append((400, 4.0, 4.0, 2, 1, 1, 3))
    frame = spark.createDataFrame(rows, "payment_id long, log_amount_rel double, log_ratio double, hour_gst int, is_weekend int, is_first_time int, dup_count long")

    def scores(df):
        cells = forest.cell_table(df)
        nodes = forest.fit_forest(cells, n_trees=30)
        return {r["payment_id"]: r["score"] for r in forest.score(df, nodes, F.lit(401), n_trees=30).collect()}

    a, b = scores(frame.repartition(1)), scores(frame.repartition(7))
    assert a == b and len(a) == 401
    assert max(a, key=a.get) == 400 and a[400] > 0.65


def test_rarity_of_new_values_is_looked_up_as_of(spark):
    ref = spark.createDataFrame([("dup_count", 1.0, 90), ("dup_count", 3.0, 10)], "feature string, extremity double, n long")
    wanted = spark.createDataFrame([("dup_count", v) for v in (0.5, 1.0, 2.0, 3.0, 5.0)], "feature string, extremity double")
    got = {r["extremity"]: round(r["rarity"], 9) for r in anomaly.shares(ref, wanted).collect()}
    assert got == {0.5: 1.0, 1.0: 1.0, 2.0: 0.1, 3.0: 0.1, 5.0: 0.0}
