"""Tables that grow with the ledger are not broadcast: Spark's estimate of what explodes is far too small."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from qanat.operators.posting import decided_events
from qanat.operators.readmodels import user_profiles
from qanat.operators.skew import spread_join
from tests.ledgers import PAYMENT, POSTING

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_look_up_that_explodes_is_not_broadcast(spark):
    rows = spark.createDataFrame([(1, 11), (2, None), (3, 99), (4, 11)], "id long, k int")
    payees = spark.range(1, 3).select(F.explode(F.sequence(F.lit(1), F.lit(9))).alias("n"), "id")
    look_up = payees.select((F.col("id") * 10 + F.col("n")).cast("int").alias("k"), F.concat(F.lit("p"), "n").alias("name"))
    joined = spread_join(rows, look_up, ["k"], "id")
    assert "Broadcast" not in plan(joined)
    found = {(r["id"], r["name"]) for r in joined.collect()}
    assert found == {(1, "p1"), (2, None), (3, None), (4, "p1")}


def test_executed_payments_are_not_broadcast(spark):
    def rows(schema: str, key: str):
        columns = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in schema.split(", ")}
        return spark.range(3).select(*[v.alias(n) for n, v in (columns | {key: F.col("id"), "status": F.lit("EXECUTED")}).items()])

    payments, postings = rows("beneficiary_name string, " + PAYMENT, "payment_id"), rows(POSTING, "transaction_id")
    postings = postings.withColumn("payment_id", F.col("transaction_id"))
    events = decided_events(payments, postings, F.col("payment_id"), F.col("transaction_id"))
    semi = [line for line in plan(events).splitlines() if "LeftSemi" in line]
    assert semi and not [line for line in semi if "Broadcast" in line]


@pytest.mark.parametrize("name", ["backfill_payments", "posting_legs", "payments_view"])
def test_look_ups_of_queries_are_not_broadcast(spark, name):
    look_ups = [line for line in plan(entry.queries()[name](spark, SF)).splitlines() if "BroadcastHashJoin" in line and "_salt" in line]
    assert not look_ups


def test_companies_are_not_broadcast_to_their_users(spark):
    """Neither side is, whatever their sizes; users without a company are left out, repeated rows are joined each."""
    companies = spark.createDataFrame([(1, "A"), (2, "B"), (2, "C"), (None, "D")], "company_id int, name string")
    rows = [(n, f"u{n}", f"User {n}", "CFO", "approver", f"u{n}@x", c) for n, c in ((1, 1), (2, 2), (2, 2), (3, None), (4, 9))]
    users = spark.createDataFrame(rows, "user_id int, username string, display_name string, title string, role string, email string, company_id int")
    joined = user_profiles(users, companies)
    found = sorted((r["user_id"], r["company_name"]) for r in joined.collect())
    assert found == [(1, "A"), (2, "B"), (2, "B"), (2, "C"), (2, "C")]
    assert "Broadcast" not in plan(joined)
    joins = [line for line in plan(entry.queries()["user_profiles"](spark, SF)).splitlines() if "Join" in line and "company_id" in line]
    assert joins and not [line for line in joins if "Broadcast" in line]
