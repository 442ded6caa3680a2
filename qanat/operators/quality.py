"""Scoping, validation and reconciliation of ledger tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY
from .dedupe import latest_balance
from .history import id_block
from .skew import spread_join, union_all

STATUSES = ("AWAITING_APPROVAL", "EXECUTED", "REJECTED")


def scope(df: DataFrame, company_id: int | None) -> DataFrame:
    """Rows of the principal's company; None is the pipeline role, which sees everything."""
    return df if company_id is None else df.where(F.col("company_id") == company_id)


def scope_by(df: DataFrame, principals: DataFrame) -> DataFrame:
    """Rows of the companies a set of principals belongs to."""
    return df.join(principals.select("company_id").distinct(), "company_id", "left_semi")  # skew: left to AQE


def owned(requests: DataFrame, targets: DataFrame, target_id: str) -> DataFrame:
    """Requests (target_id, company_id, ...) whose target exists in the requester's own company."""
    keys = targets.select(F.col(target_id).alias("target_id"), "company_id")
    return requests.join(keys, ["target_id", "company_id"], "left_semi")


def denied(requests: DataFrame, targets: DataFrame, target_id: str, target_type: str, now: Column) -> DataFrame:
    """Audit rows of the others; a foreign target looks exactly like a missing one."""
    keys = targets.select(F.col(target_id).alias("target_id"), "company_id")
    return requests.join(keys, ["target_id", "company_id"], "left_anti").select(
        now.alias("occurred_at"),
        "user_id",
        "username",
        "company_id",
        F.lit("access_denied").alias("action"),
        F.lit(target_type).alias("target_type"),
        F.col("target_id").cast("string").alias("target_id"),
    )


def payment_rules() -> dict[str, Column]:
    """Rule name -> violated."""
    amount, to_acct, payee = F.col("amount"), F.col("to_account_id"), F.col("beneficiary_id")
    return {
        "amount_not_positive": ~F.coalesce(amount > 0, F.lit(False)),
        "more_than_two_decimals": F.coalesce(amount != F.round(amount, 2), F.lit(False)),
        "not_one_destination": to_acct.isNull() == payee.isNull(),
        "same_account": F.coalesce(to_acct == F.col("from_account_id"), F.lit(False)),
        "unknown_status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "reference_too_long": F.coalesce(F.length("reference") > 140, F.lit(False)),
    }


def validate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The rows with `violations`: the names of the broken rules, in rule order."""
    broken = F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()])
    return df.withColumn("violations", F.array_compact(broken))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows)."""
    ok = F.size("violations") == 0
    return checked.where(ok).drop("violations"), checked.where(~ok)


def foreign_key_violations(
    child: DataFrame, child_id: str, checks: Sequence[tuple[str, DataFrame, str]], table: str
) -> DataFrame:
    """(table, row_id, column, value) of every non-NULL reference without a parent; checks are
    (column, parent, parent key). Distinct missing values are found first, so a hot key is one key."""
    found = []
    for column, parent, key in checks:
        values = child.where(F.col(column).isNotNull()).select(column).distinct()
        missing = values.join(parent.select(F.col(key).alias(column)), column, "left_anti")
        rows = spread_join(child.select(child_id, column), missing, [column], child_id, how="inner")
        found.append(
            rows.select(
                F.lit(table).alias("table_name"),
                F.col(child_id).cast("long").alias("row_id"),
                F.lit(column).alias("column_name"),
                F.col(column).cast("string").alias("value"),
            )
        )
    return union_all(found)


def uniqueness_violations(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """(table, column, value, copies) of every non-NULL value that occurs more than once."""
    found = [
        df.where(F.col(k).isNotNull())
        .groupBy(F.col(k).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
        .select(F.lit(table).alias("table_name"), F.lit(k).alias("column_name"), "value", "copies")
        for k in keys
    ]
    return union_all(found)


def decision_outcomes(decisions: DataFrame, payments: DataFrame, users: DataFrame) -> DataFrame:
    """Each decision (decision_id, payment_id, user_id, verb) with the first rule that refuses it, or NULL."""
    asked = decisions.join(payments.select("payment_id", "created_by", "status"), "payment_id")
    joined = spread_join(asked, users.select("user_id", "role"), ["user_id"], "decision_id", how="inner")
    already = F.concat(F.lit("This payment is already "), F.lower("status"), F.lit("."))
    refusal = (
        F.when(
            F.col("created_by") == F.col("user_id"),
            F.concat(F.lit("You can't "), F.col("verb"), F.lit(" a payment you created.")),
        )
        .when((F.col("verb") == "approve") & (F.col("role") != "approver"), "Only an approver can approve payments.")
        .when(F.col("status") != "AWAITING_APPROVAL", already)
    )
    return joined.select("decision_id", "payment_id", "user_id", "verb", refusal.alias("refusal"))


def winning_decisions(decisions: DataFrame) -> DataFrame:
    """Of several decisions on a payment, the earliest; ties go to the smaller decision id."""
    first = F.min_by(F.struct("user_id", "verb"), F.struct("decided_at", "decision_id"))
    return decisions.groupBy("payment_id").agg(
        F.min(F.struct("decided_at", "decision_id"))["decision_id"].alias("decision_id"),
        first["user_id"].alias("user_id"),
        first["verb"].alias("verb"),
        F.count(F.lit(1)).alias("attempts"),
    )


def reconcile(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Accounts whose last balance differs from the ledger's, or that have none."""
    last = latest_balance(transactions).select("account_id", "lake_balance")
    joined = accounts.select("account_id", "company_id", "reference_balance").join(last, "account_id", "left")
    return joined.select(
        "account_id",
        "company_id",
        "reference_balance",
        "lake_balance",
        (F.col("lake_balance") - F.col("reference_balance")).cast(MONEY).alias("difference"),
        F.col("lake_balance").eqNullSafe(F.col("reference_balance")).alias("reconciled"),
    )


def broken_balances(transactions: DataFrame) -> DataFrame:
    """Postings whose balance_after is not the account's previous balance plus their amount.

    The previous balance is the neighbour's inside a block of ids, and for the first posting of a block the
    last one of the block before; an account is never one window.
    """
    rows = transactions.select("transaction_id", "account_id", "amount", "balance_after")
    rows = rows.withColumn("_block", id_block())
    w = Window.partitionBy("account_id", "_block").orderBy("transaction_id")
    ends = rows.groupBy("account_id", "_block").agg(F.max_by("balance_after", "transaction_id").alias("_last"))
    by_block = Window.partitionBy("account_id").orderBy("_block")
    carried = ends.select("account_id", "_block", F.lag("_last").over(by_block).alias("_carry"))
    near = rows.withColumn("_before", F.lag("balance_after").over(w)).join(carried, ["account_id", "_block"])
    expected = F.coalesce("_before", "_carry") + F.col("amount")
    return near.where(F.col("balance_after") != expected).select(
        "transaction_id", "account_id", "amount", "balance_after", expected.cast(MONEY).alias("expected_balance")
    )


def negative_balances(transactions: DataFrame) -> DataFrame:
    """Accounts whose lowest running balance is below zero."""
    low = transactions.groupBy("account_id").agg(F.min("balance_after").alias("lowest_balance"))
    return low.where(F.col("lowest_balance") < 0)


def insufficient_funds(payments: DataFrame, accounts: DataFrame) -> DataFrame:
    """Awaiting payments larger than the balance of their from-account."""
    waiting = payments.where(F.col("status") == "AWAITING_APPROVAL")
    funds = accounts.select(F.col("account_id").alias("from_account_id"), "company_id", "reference_balance")
    return (
        spread_join(waiting, funds, ["from_account_id", "company_id"], "payment_id", how="inner")
        .where(F.col("amount") > F.col("reference_balance"))
        .select("payment_id", "company_id", "from_account_id", "amount", "reference_balance")
    )


def evolve(old: DataFrame, new: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Old rows under the newer schema: missing columns appear and take their default."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def parity(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys whose stored row differs from the recomputed one, or that only one side has."""
    a = stored.select(*keys, F.struct(*values).alias("stored"))
    b = recomputed.select(*keys, F.struct(*values).alias("recomputed"))
    return a.join(b, list(keys), "full").where(~F.col("stored").eqNullSafe(F.col("recomputed")))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of several tables."""
    return union_all([t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, t in tables.items()])


def digest(df: DataFrame) -> DataFrame:
    """One row: a digest of all rows that depends neither on their order nor on the partitioning.

    Equal rows count: the hash words are added, not xor-ed away.
    """
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    words = [
        F.conv(F.substring(F.sha2(text, 256), 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").alias(f"w{i}") for i in range(4)
    ]
    sums = df.select(*words).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(f"w{i}").cast("string").alias(f"w{i}") for i in range(4)])
    joined = F.concat_ws(":", F.col("n_rows").cast("string"), *[F.coalesce(f"w{i}", F.lit("0")) for i in range(4)])
    return sums.select("n_rows", F.sha2(joined, 256).alias("digest"))
