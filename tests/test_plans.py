"""Physical plans: what must never appear, and what must reach the scan."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from qanat.operators import gold, readmodels
from qanat.plans import all_queries
from qanat.plans.views import Ledger, context

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def static(spark):
    """Plans as they are without run-time re-planning and without small-table broadcasts."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = sorted(n for n in all_queries.QUERIES if n not in {"anomaly_scores", "flagged_payments", "anomaly_metrics", "forest_cells"})


@pytest.mark.parametrize("name", [n for n in LAZY if not n.startswith(("feature_", "reference_", "strongest_", "anomaly_"))])
def test_no_cross_join_and_no_python_rows(static, name):
    text = plan(entry.queries()[name](static, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text


def test_scans_read_only_what_is_asked(static):
    L = Ledger(static, SF)
    text = plan(gold.daily_flows(L.silver_postings, L.accounts, context()))
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    assert any("value" in s and "props" not in s for s in scans)
    assert all("props" not in s for s in scans)


def test_filters_reach_the_scan(static, tmp_path):
    L = Ledger(static, SF)
    L.payments.where(F.col("status") == "EXECUTED").write.parquet(str(tmp_path / "p"))
    text = plan(static.read.parquet(str(tmp_path / "p")).where(F.col("status") == "EXECUTED").select("payment_id"))
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,EXECUTED)]" in text


def test_top_n_is_cut_before_the_shuffle(static):
    L = Ledger(static, SF)
    text = plan(readmodels.top_per_key(L.postings, "account_id", [F.desc("booked_at"), F.desc("transaction_id")], 5))
    assert "WindowGroupLimit" in text and text.index("Final") < text.index("Partial")


def test_latest_balance_is_a_hash_aggregate(static):
    L = Ledger(static, SF)
    from qanat.operators.dedupe import latest_balance

    text = plan(latest_balance(L.postings.withColumn("balance_after", F.col("amount"))))
    assert "HashAggregate" in text and "SortAggregate" not in text
