"""The whole batch on tiny input: golden figures, redelivery, idle batches and recovery."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from qanat.plans import batch, scoring
from qanat.plans.batch import run_backfill, run_batch, start_up
from tests.ledgers import NOW, history, job, land, ledger, transfer_lines


def position(j):
    return j.lake.read("serving", "cash_position").where(F.col("as_of_date") == date(2026, 10, 5)).first()


def stages(j):
    return {r["stage"] for r in j.lake.read("ops", "pipeline_trace").collect()}


def test_one_transfer_through_the_lake(spark, tmp_path):
    j = job(spark, tmp_path, ledger(spark))
    land(j, "a", transfer_lines())
    row = run_batch(j, "run-a", NOW)
    assert (row["events_ingested"], row["events_new"], row["companies_refreshed"]) == (3, 3, 1)
    p = position(j)
    assert (p["available"], p["total_cash"], p["forecast_low"]) == (Decimal("2230000.00"), Decimal("5800000.00"), Decimal("330000.00"))
    assert (p["payroll_due_date"], p["payroll_due_amount"]) == (date(2026, 10, 8), Decimal("1900000.00"))
    assert stages(j) == {"bronze", "silver", "gold", "serving"}
    assert j.lake.read("gold", "payment_features").first()["counterparty"] == "Own account transfer"


def test_redelivery_changes_nothing(spark, tmp_path):
    j = job(spark, tmp_path, ledger(spark))
    land(j, "a", transfer_lines())
    land(j, "b", transfer_lines())
    row = run_batch(j, "run-a", NOW)
    assert (row["events_ingested"], row["events_new"]) == (6, 3)
    land(j, "c", transfer_lines())
    again = run_batch(j, "run-b", NOW)
    assert (again["events_ingested"], again["events_new"]) == (3, 0)
    assert j.lake.read("silver", "transactions").count() == 2
    assert j.lake.read("silver", "payments").count() == j.lake.read("gold", "payment_features").count() == 1
    assert position(j)["available"] == Decimal("2230000.00")


def test_idle_batch_writes_only_its_run_row(spark, tmp_path):
    j = job(spark, tmp_path, ledger(spark))
    land(j, "a", transfer_lines())
    run_batch(j, "run-a", NOW)
    before = position(j), j.lake.version("gold", "daily_flows")
    idle = run_batch(j, "run-b", NOW)
    assert (idle["events_ingested"], idle["events_new"], idle["companies_refreshed"]) == (0, 0, 0)
    assert (position(j), j.lake.version("gold", "daily_flows")) == before
    runs = {r["run_id"]: r["events_new"] for r in j.lake.read("ops", "pipeline_runs").collect()}
    assert runs == {"run-a": 3, "run-b": 0}


def test_unreadable_lines_stay_in_bronze(spark, tmp_path):
    j = job(spark, tmp_path, ledger(spark))
    land(j, "a", ["", "   ", "not json", '{"id": "x"}', *transfer_lines()])
    row = run_batch(j, "run-a", NOW)
    assert (row["events_ingested"], row["events_new"]) == (5, 3)
    assert j.lake.read("bronze", "events").where("event_id is null").count() == 2


@pytest.mark.parametrize("stage", ["run_silver", "run_gold", "run_serving"])
def test_a_run_that_dies_is_finished_by_the_next(spark, tmp_path, monkeypatch, stage):
    j = job(spark, tmp_path, ledger(spark))
    land(j, "a", transfer_lines())

    def die(*_a, **_k):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(batch, stage, die)
        with pytest.raises(RuntimeError):
            run_batch(j, "run-a", NOW)
    row = run_batch(j, "run-b", NOW)
    assert (row["events_ingested"], row["events_new"], row["companies_refreshed"]) == (3, 3, 1)
    assert position(j)["available"] == Decimal("2230000.00")
    assert stages(j) == {"bronze", "silver", "gold", "serving"}


def test_a_silver_write_that_is_replayed_adds_nothing(spark, tmp_path, monkeypatch):
    """The second silver table fails after the first was written; the replay completes both."""
    j = job(spark, tmp_path, ledger(spark))
    land(j, "a", transfer_lines())
    merge = j.lake.merge_insert

    def once(df, layer, table, key, number, keys_in=None):
        if table == "payments":
            raise RuntimeError("lost")
        merge(df, layer, table, key, number)

    with monkeypatch.context() as m:
        m.setattr(j.lake, "merge_insert", once)
        with pytest.raises(RuntimeError):
            run_batch(j, "run-a", NOW)
    assert run_batch(j, "run-b", NOW)["events_new"] == 3
    assert j.lake.read("silver", "transactions").count() == 2 and j.lake.read("silver", "payments").count() == 1


def test_score_before_train_is_skipped(spark, tmp_path):
    j = job(spark, tmp_path, ledger(spark))
    ctx = j.settings.context("x", NOW)
    assert scoring.train(j.lake, j.settings, ctx)["status"] == "skipped"
    assert scoring.score(j.lake, j.ledger, j.settings, ctx, moved=True)["status"] == "skipped"
    assert not j.lake.exists("serving", "forecast")


def test_backfill_train_and_score(spark, tmp_path):
    pays, posts, balances = history()
    j = job(spark, tmp_path, ledger(spark, balances, pays, posts), n_trees=100)
    result = start_up(j, "start", NOW)
    total = len(pays) + len(posts)
    assert (result["bronze_appended"], result["silver_inserted"]) == (total, total)
    assert result["train"]["status"] == "trained"
    again = run_backfill(j, j.settings.context("again", NOW))
    assert again == {"bronze_appended": 0, "silver_inserted": 0}

    ctx = j.settings.context("score", NOW)
    assert scoring.score(j.lake, j.ledger, j.settings, ctx, moved=False)["status"] == "scored"
    rows = j.lake.read("serving", "forecast").orderBy("forecast_date").collect()
    assert len(rows) == 30 and rows[0]["forecast_date"] == date(2026, 10, 5)
    assert all(r["lower_bound"] <= r["predicted_balance"] <= r["upper_bound"] for r in rows)
    drop = rows[2]["predicted_balance"] - rows[3]["predicted_balance"]  # payroll on the fourth day
    assert drop > Decimal("1520000")

    reasons = {r["payment_id"]: r["reason"] for r in j.lake.read("serving", "anomalies").collect()}
    spike, twin, night = len(pays) - 3, len(pays) - 1, len(pays)
    assert {spike, twin, night} <= set(reasons) and len(reasons) <= 8
    assert reasons[spike].startswith("Unusual: 4") and "supplier's average" in reasons[spike]
    assert reasons[twin] == "Possible duplicate: same supplier, amount and day as an earlier payment"
    assert reasons[night] == "Unusual: Saturday 02:00 payment to a first-time beneficiary"
    assert [r["id"] for r in j.lake.read("serving", "anomalies").orderBy("id").collect()] == list(range(1, len(reasons) + 1))

    assert scoring.score(j.lake, j.ledger, j.settings, ctx, moved=False)["status"] == "unchanged"
    models = {r["model_name"]: r for r in j.lake.read("serving", "models").collect()}
    chosen = {r["name"]: r["value"] for r in j.lake.read("ml", "payment_anomaly.parameters").collect()}
    assert chosen == {"seed": str(j.settings.ml_seed), "n_trees": "100", "grid": "0.05", "threshold": "0.65"}
    assert set(models) == {"cash_forecast", "payment_anomaly"} and '"holdout_mae"' in models["cash_forecast"]["metrics"]

    # 450,000 more non-Reserve cash moves the whole path with it, without retraining.
    land(j, "a", transfer_lines(first_tx=10_000_001))
    operating = balances[1] + Decimal("450000")
    lines = transfer_lines(first_tx=10_000_001)[2].replace("3310000.00", f"{operating:.2f}")
    land(j, "b", [lines.replace('"id": 3', '"id": 30')])
    run_batch(j, "run-a", NOW)
    moved = {r["forecast_date"]: r for r in j.lake.read("serving", "forecast").collect()}
    assert moved[date(2026, 10, 8)]["lower_bound"] != rows[3]["lower_bound"]


def test_retraining_makes_a_new_champion(spark, tmp_path):
    pays, posts, balances = history(35)
    j = job(spark, tmp_path, ledger(spark, balances, pays, posts), n_trees=20)
    start_up(j, "start", NOW)
    ctx = j.settings.context("again", NOW)
    assert scoring.train(j.lake, j.settings, ctx)["payment_anomaly"] == "2"
    assert scoring.score(j.lake, j.ledger, j.settings, ctx, moved=False)["status"] == "scored"
    assert {r["model_version"] for r in j.lake.read("serving", "forecast").collect()} == {"2"}


def test_gold_of_moved_companies_equals_a_full_recompute(spark, tmp_path):
    """A batch that moves one company recomputes it alone; the result is what computing everything gives."""
    pays, posts, balances = history(20)
    j = job(spark, tmp_path, ledger(spark, balances, pays, posts))
    run_backfill(j, j.settings.context("seed", NOW))
    other = [line.replace('"company_id": 1', '"company_id": 2').replace('\\"company_id\\": 1', '\\"company_id\\": 2') for line in transfer_lines(first_tx=10_000_001)]
    land(j, "a", other)
    ctx = j.settings.context("run-a", NOW)
    batch.run_bronze(j, ctx)
    batch.run_silver(j, ctx)
    assert batch.run_gold(j, ctx)
    drop = ["run_id", "computed_at"]
    part = {t: {tuple(r) for r in j.lake.read("gold", t).drop(*drop).collect()} for t in ("payment_features", "daily_flows")}
    runs = {r["company_id"]: r["run_id"] for r in j.lake.read("gold", "payment_features").collect()}
    assert runs == {1: "seed", 2: "run-a"}  # company 1 was not touched
    batch.run_gold(j, j.settings.context("full", NOW), force=True)
    for t, rows in part.items():
        assert {tuple(r) for r in j.lake.read("gold", t).drop(*drop).collect()} == rows


def test_settings_from_text(spark):
    from qanat.cli import parser, utc_moment
    from qanat.context import Settings

    line = parser().parse_intermixed_args(["gold", "--run-id", "7", "AS_OF=2026-10-05", "ML_SEED=", "CADENCE_SECONDS=30", "SOURCE=kafka"])
    s = Settings.read(dict(line.settings), {"SOURCE": "files", "N_TREES": "20"})
    assert (line.stage, line.run_id, s.as_of, s.ml_seed, s.cadence_seconds, s.source, s.n_trees) == ("gold", "7", date(2026, 10, 5), 42, 30, "kafka", 20)
    assert utc_moment("2026-10-05T08:00:00+04:00") == utc_moment("2026-10-05T04:00:00Z") == utc_moment("2026-10-05T04:00:00")
    assert Settings(as_of=None).day(NOW.replace(hour=21)) == date(2026, 10, 6)  # Gulf midnight has passed
