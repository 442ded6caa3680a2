"""Ledger calendar: recurring schedules, payroll cycles, month-start items, sweeps and the account roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..functions.text import iban
from ..functions.times import business_day, gulf_date, next_payroll_thursday
from .forecast import PAYROLL_CYCLE_DAYS

# Fixed roster of a company: kind, label, in account order.
ACCOUNT_KINDS = (
    ("operating", "Operating"),
    ("reserve", "Reserve"),
    ("payroll", "Payroll"),
    ("collections", "Collections"),
)
MONTHLY_FEE = "525.00"
YEARLY_INTEREST = "0.035"


def _every(start: Column, end: Column, days: Column) -> Column:
    """start, start + days, ... up to end; no date when start is past end."""
    return F.when(start <= end, F.sequence(start, end, F.make_dt_interval(days=days)))


def recurring_schedule(payees: DataFrame, start: Column, end: Column) -> DataFrame:
    """Payees (cadence_days, offset_days, ...) -> one row per due date in [start, end), rolled to a business day."""
    first = F.date_add(start, F.col("offset_days"))
    raw = payees.select("*", F.explode(_every(first, end, F.col("cadence_days").cast("int"))).alias("_raw"))
    return raw.withColumn("due_date", business_day(F.col("_raw"))).drop("_raw").where(F.col("due_date") < end)


def payroll_cycle(payrolls: DataFrame, start: Column, as_of: Column) -> DataFrame:
    """Past payroll legs of (company_id, amount): funding transfer the day before, salaries on the day.

    Paydays go back from the next payroll Thursday in 28-day steps while the funding day is in range.
    """
    next_pay = next_payroll_thursday(as_of)
    count = F.floor(F.datediff(next_pay, F.date_add(start, 1)) / PAYROLL_CYCLE_DAYS).cast("int")
    back = F.when(count >= 1, F.sequence(F.lit(1), count))
    days = payrolls.select("*", F.explode(back).alias("_k")).withColumn(
        "payday", F.date_sub(next_pay, F.col("_k") * PAYROLL_CYCLE_DAYS)
    )

    def leg(kind: str, day: Column, amount: Column, category: str, counterparty: str) -> Column:
        return F.struct(
            F.lit(kind).alias("account_kind"),
            day.alias("value_date"),
            amount.cast(MONEY).alias("amount"),
            F.lit(category).alias("category"),
            F.lit(counterparty).alias("counterparty"),
        )

    payday, amount = F.col("payday"), F.col("amount")
    legs = F.array(
        leg("operating", F.date_sub(payday, 1), -amount, "transfer", "Payroll account"),
        leg("payroll", F.date_sub(payday, 1), amount, "transfer", "Operating account"),
        leg("payroll", payday, -amount, "payroll", "WPS salary transfer"),
    )
    return days.where(payday < as_of).select("company_id", "payday", F.inline(legs))


def month_start_items(accounts: DataFrame, start: Column, end: Column) -> DataFrame:
    """On the first of each month in [start, end): the fee from Operating, a month's interest to Reserve."""
    next_month = F.date_trunc("MONTH", F.add_months(start, 1)).cast("date")
    first = F.when(F.dayofmonth(start) == 1, start).otherwise(next_month)
    last = F.date_sub(end, 1)
    months = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 MONTH")))
    interest = (F.col("reference_balance") * F.lit(YEARLY_INTEREST).cast("decimal(5,3)") / 12).cast(MONEY)
    fee = F.col("account_kind") == "operating"
    return (
        accounts.where(F.col("account_kind").isin("operating", "reserve"))
        .select("account_id", "company_id", "account_kind", "reference_balance", F.explode(months).alias("value_date"))
        .select(
            "account_id",
            "company_id",
            "value_date",
            F.when(fee, F.lit("-" + MONTHLY_FEE).cast(MONEY)).otherwise(interest).alias("amount"),
            F.when(fee, "fee").otherwise("interest").alias("category"),
        )
    )


def daily_sweep(postings: DataFrame, accounts: DataFrame) -> DataFrame:
    """Two legs per company and day whose Collections receipts are positive: out of Collections, into Operating.

    Account-days are summed before the account table is joined.
    """
    days = (
        postings.where(F.col("category") == "customer")
        .groupBy("account_id", gulf_date(F.col("booked_at")).alias("value_date"))
        .agg(F.sum("amount").alias("_amount"))
    )
    collections = accounts.where(F.col("account_kind") == "collections").select("account_id", "company_id")
    total = (
        days.join(collections, "account_id")
        .groupBy("company_id", "value_date")
        .agg(F.sum("_amount").alias("_amount"))
        .where(F.col("_amount") > 0)
    )
    legs = F.array(
        F.struct(F.lit("collections").alias("account_kind"), (-F.col("_amount")).cast(MONEY).alias("amount")),
        F.struct(F.lit("operating").alias("account_kind"), F.col("_amount").cast(MONEY).alias("amount")),
    )
    return total.select("company_id", "value_date", F.inline(legs))


def account_roster(companies: DataFrame, *keep: str) -> DataFrame:
    """Four numbered accounts per company with their IBANs, and the company's columns in `keep`."""
    kinds = F.array(
        *[
            F.struct(F.lit(n).alias("account_no"), F.lit(kind).alias("account_kind"), F.lit(label).alias("name"))
            for n, (kind, label) in enumerate(ACCOUNT_KINDS, start=1)
        ]
    )
    listed = companies.select("company_id", *keep, F.inline(kinds))
    company, number = F.col("company_id"), F.col("account_no")
    return listed.select(
        ((company - 1) * len(ACCOUNT_KINDS) + number).cast("int").alias("account_id"),
        "company_id",
        "account_kind",
        "name",
        iban(company, F.lit(1000) + company * 10 + number, number).alias("iban"),
        *keep,
    )
