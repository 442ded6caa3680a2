"""Gold: cash position, payment features and daily flows, recomputed from silver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import RunContext
from ..functions.money import MONEY, safe_ratio
from ..functions.times import gulf_day_of_week, gulf_hour, gulf_weekend
from .dedupe import earliest_per_key, latest_balance, one_posting_per_id
from .skew import running, spread_join

FIRST_TIME_AFTER_DAYS = 28
OWN_TRANSFER = "Own account transfer"
BUCKETS = ("other", "supplier", "payroll", "transfer")


def cash_position_daily(accounts: DataFrame, transactions: DataFrame, ctx: RunContext) -> DataFrame:
    """One row per account for the business date; accounts the lake has not seen keep the ledger's balance."""
    return cash_position(accounts, latest_balance(transactions), ctx)


def cash_position(accounts: DataFrame, balances: DataFrame, ctx: RunContext) -> DataFrame:
    """As above, from (account_id, lake_balance, last_booked_at)."""
    joined = accounts.join(balances, "account_id", "left")
    seen = F.col("lake_balance").isNotNull()
    return joined.select(
        ctx.as_of.alias("position_date"),
        "company_id",
        "account_id",
        "account_kind",
        F.coalesce("lake_balance", "reference_balance").cast(MONEY).alias("balance"),
        F.when(seen, "lake").otherwise("reference").alias("balance_source"),
        "last_booked_at",
        ctx.now_col.alias("computed_at"),
        ctx.run_col.alias("run_id"),
    )


def executed_payments(payments: DataFrame) -> DataFrame:
    """One row per executed payment: the event with the smallest id."""
    return earliest_per_key(payments.where(F.col("status") == "EXECUTED"), "payment_id", ["event_id"])


def first_debit(transactions: DataFrame) -> DataFrame:
    """The first debit posting of each payment."""
    legs = transactions.where(F.col("payment_id").isNotNull() & (F.col("amount") < 0))
    return legs.groupBy("payment_id").agg(F.min("transaction_id").alias("transaction_id"))


def prior_payments(pay: DataFrame) -> DataFrame:
    """(payment_id, _prior_n, _prior_sum): the company's earlier payments to the same beneficiary.

    Payments without a beneficiary have no history; each gets its own key, so that they do not pile up
    on one NULL group.
    """
    keyed = pay.select(
        "payment_id",
        "company_id",
        "beneficiary_id",
        F.when(F.col("beneficiary_id").isNull(), F.col("payment_id")).alias("_solo"),
        "amount",
        "executed_at",
    )
    done = running(
        keyed,
        ["company_id", "beneficiary_id", "_solo"],
        ["executed_at", "payment_id"],
        {"_prior_n": F.lit(1).cast("long"), "_prior_sum": F.col("amount")},
    )
    return done.select("payment_id", F.coalesce("_prior_n", F.lit(0)).alias("_prior_n"), "_prior_sum")


def same_day_twins(pay: DataFrame) -> DataFrame:
    """(payment_id, same_day_duplicates): earlier payments of the same company, payee, amount and value date."""
    keys = ["company_id", "beneficiary_id", "to_account_id", "amount", "value_date"]
    done = running(
        pay.select("payment_id", *keys, "executed_at"),
        keys,
        ["executed_at", "payment_id"],
        {"same_day_duplicates": F.lit(1).cast("long")},
    )
    return done.select("payment_id", F.coalesce("same_day_duplicates", F.lit(0)).alias("same_day_duplicates"))


def payment_features(
    payments: DataFrame,
    transactions: DataFrame,
    ctx: RunContext,
    first_time_after_days: int = FIRST_TIME_AFTER_DAYS,
    keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """One row per executed payment: the anomaly model's input.

    The two histories are computed on narrow rows and meet the payment again on its id, which no hot key
    can unbalance. `keep` may set down the deduplicated payments, which are read five times.
    """
    wanted = [
        "company_id", "from_account_id", "to_account_id", "beneficiary_id", "beneficiary_name", "amount",
        "value_date", "executed_at",
    ]
    source = payments.select("event_id", "payment_id", "status", *wanted)
    pay = keep(executed_payments(source).select("payment_id", *wanted))
    return features(pay, first_debit(transactions), ctx, first_time_after_days)


def features(pay: DataFrame, debits: DataFrame, ctx: RunContext, first_time_after_days: int = FIRST_TIME_AFTER_DAYS) -> DataFrame:
    """As above, from executed payments (one row each) and the first debit of each (payment_id, transaction_id)."""
    history_start = pay.groupBy("company_id").agg(F.min("executed_at").alias("_company_first"))
    rows = (
        pay.join(prior_payments(pay), "payment_id")
        .join(same_day_twins(pay), "payment_id")
        .join(debits, "payment_id", "left")
    )
    rows = spread_join(rows, history_start, ["company_id"], "payment_id")

    known = F.col("beneficiary_id").isNotNull()
    mean = (F.col("_prior_sum") / F.col("_prior_n")).cast("decimal(38,6)").cast(MONEY)  # an average has six decimals
    settled = F.col("_company_first") + F.expr(f"INTERVAL {int(first_time_after_days)} DAYS")
    executed = F.col("executed_at")
    return rows.select(
        "payment_id",
        "company_id",
        "transaction_id",
        "from_account_id",
        "to_account_id",
        "beneficiary_id",
        F.coalesce("beneficiary_name", F.lit(OWN_TRANSFER)).alias("counterparty"),
        "amount",
        "value_date",
        "executed_at",
        F.log1p(F.col("amount").cast("double")).alias("log_amount"),
        gulf_hour(executed).alias("hour_gst"),
        gulf_day_of_week(executed).alias("day_of_week_gst"),
        gulf_weekend(executed).alias("is_weekend"),
        F.col("to_account_id").isNotNull().alias("is_internal"),
        F.when(known, F.col("_prior_n")).alias("beneficiary_prior_count"),
        F.when(known & (F.col("_prior_n") > 0), mean).alias("beneficiary_prior_mean"),
        (known & (F.col("_prior_n") == 0) & (executed >= settled)).alias("is_first_time_beneficiary"),
        "same_day_duplicates",
        ctx.run_col.alias("run_id"),
        ctx.now_col.alias("computed_at"),
    ).withColumn("amount_to_prior_mean", safe_ratio(F.col("amount"), F.col("beneficiary_prior_mean")))


def bucket_code(category: Column) -> Column:
    """The flow bucket of a category as its position in BUCKETS (a fixed-width aggregation buffer)."""
    code = F.lit(0)
    for i, name in enumerate(BUCKETS[1:], start=1):
        code = F.when(category == name, i).otherwise(code)
    return code.cast("tinyint")


def daily_flows(transactions: DataFrame, accounts: DataFrame, ctx: RunContext) -> DataFrame:
    """Net flow per company and Gulf day of the non-Reserve accounts, in four buckets.

    Postings are summed per account and day before they meet the account table, so the join carries
    account-days instead of postings and a hot account is no hot join key.
    """
    once = one_posting_per_id(
        transactions,
        company_id=F.col("company_id"),
        account_id=F.col("account_id"),
        flow_date=F.col("value_date"),
        amount=F.col("amount"),
        bucket=bucket_code(F.col("category")),
    )
    sums = [F.sum(F.when(F.col("bucket") == i, F.col("amount")).otherwise(0)).alias(f"{b}_net") for i, b in enumerate(BUCKETS)]
    account_days = once.groupBy("company_id", "account_id", "flow_date").agg(*sums, F.sum("amount").alias("total_net"))
    kinds = accounts.where(F.col("account_kind") != "reserve").select("account_id")
    nets = [f"{b}_net" for b in BUCKETS] + ["total_net"]
    return (
        account_days.join(kinds, "account_id")
        .groupBy("company_id", "flow_date")
        .agg(*[F.sum(n).cast(MONEY).alias(n) for n in nets])
        .withColumn("run_id", ctx.run_col)
        .withColumn("computed_at", ctx.now_col)
    )
