"""Daily histories: gap-free flow days, running balances and day-by-day positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..functions.times import gulf_date, weekday
from .serving import PAYROLL_DAYS, SUPPLIER_DAYS
from .skew import running, spread_join, union_all

FLOW_COLUMNS = ("other_net", "supplier_net", "payroll_net", "transfer_net")
# Posting ids per block of a running balance: a window holds at most this many postings, and a trillion
# postings make a million blocks.
ID_BLOCK = 1_000_000


def id_block(column: str = "transaction_id") -> Column:
    return F.floor(F.col(column) / F.lit(ID_BLOCK))


def date_spine(bounds: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """One row per day from first to last; rows with an empty range disappear."""
    days = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 DAY")))
    return bounds.select("*", F.explode(days).alias(name))


def daily_flow_history(flows: DataFrame, until: Column) -> DataFrame:
    """Every company's days from its own first flow day to the day before `until`, zeros filled in."""
    before = flows.where(F.col("flow_date") < until).select("company_id", "flow_date", *FLOW_COLUMNS)
    starts = before.groupBy("company_id").agg(F.min("flow_date").alias("_start"))
    spine = date_spine(starts, F.col("_start"), F.date_sub(until, 1), "flow_date").drop("_start")
    return spine.join(before, ["company_id", "flow_date"], "left").select(
        "company_id",
        "flow_date",
        weekday(F.col("flow_date")).alias("weekday"),
        *[F.coalesce(c, F.lit(0)).cast(MONEY).alias(c) for c in FLOW_COLUMNS],
    )


def running_balance(postings: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """balance_after of every posting: the account's opening balance plus all postings up to it, in id order."""
    done = running(postings, ["account_id"], ["transaction_id"], {"balance_after": F.col("amount")}, inclusive=True)
    if opening is None:
        return done.withColumn("balance_after", F.col("balance_after").cast(MONEY))
    opened = spread_join(done, opening.select("account_id", "opening_balance"), ["account_id"], "transaction_id")
    total = F.coalesce("opening_balance", F.lit(0)) + F.col("balance_after")
    return opened.withColumn("balance_after", total.cast(MONEY)).drop("opening_balance")


def opening_balances(accounts: DataFrame, postings: DataFrame) -> DataFrame:
    """The opening balance that makes the history end exactly at the account's present balance."""
    net = postings.groupBy("account_id").agg(F.sum("amount").alias("_net"))
    return accounts.join(net, "account_id", "left").select(
        "account_id", (F.col("reference_balance") - F.coalesce("_net", F.lit(0))).cast(MONEY).alias("opening_balance")
    )


def lowest_running_balance(with_balance: DataFrame) -> DataFrame:
    """The lowest balance each account ever reached."""
    return with_balance.groupBy("account_id").agg(F.min("balance_after").alias("lowest_balance"))


def start_of_day_balances(accounts: DataFrame, postings: DataFrame, first: Column, last: Column) -> DataFrame:
    """(company, day): total and Reserve cash before the day's postings, for every day first..last.

    `accounts` carries each account's opening balance. Account-days are summed before anything else, so
    the window below sees one row per company and day.
    """
    known = accounts.select("account_id", "company_id", "account_kind", "opening_balance")
    net = postings.groupBy("account_id", gulf_date(F.col("booked_at")).alias("_day")).agg(F.sum("amount").alias("_net"))
    reserve = F.col("account_kind") == "reserve"
    moves = net.join(known, "account_id").groupBy("company_id", "_day").agg(
        F.sum("_net").alias("_all"), F.sum(F.when(reserve, F.col("_net")).otherwise(0)).alias("_res")
    )
    opened = known.groupBy("company_id").agg(
        F.sum("opening_balance").alias("_open"),
        F.sum(F.when(reserve, F.col("opening_balance")).otherwise(0)).alias("_open_res"),
    )
    # Days before the first one shown still count towards its balance.
    clipped = moves.select("company_id", F.greatest(F.date_add("_day", 1), first).alias("as_of_date"), "_all", "_res")
    arriving = clipped.where(F.col("as_of_date") <= last).groupBy("company_id", "as_of_date").agg(
        F.sum("_all").alias("_all"), F.sum("_res").alias("_res")
    )
    spine = date_spine(opened, first, last, "as_of_date")
    upto = Window.partitionBy("company_id").orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(arriving, ["company_id", "as_of_date"], "left").select(
        "company_id",
        "as_of_date",
        (F.col("_open") + F.coalesce(F.sum("_all").over(upto), F.lit(0))).alias("total_cash"),
        (F.col("_open_res") + F.coalesce(F.sum("_res").over(upto), F.lit(0))).alias("reserve_cash"),
    )


def outflow_days(postings: DataFrame, scheduled: DataFrame, kind: str) -> DataFrame:
    """(company, day, amount): past outflows of a category and scheduled ones of the same kind."""
    past = postings.where(F.col("category") == kind).select(
        "company_id", gulf_date(F.col("booked_at")).alias("day"), (-F.col("amount")).alias("amount")
    )
    known = scheduled.where(F.col("kind") == kind).select("company_id", F.col("due_date").alias("day"), "amount")
    return union_all([past, known]).groupBy("company_id", "day").agg(F.sum("amount").cast(MONEY).alias("amount"))


def forward_sum(days: DataFrame, value: str, width: int, name: str, day: str = "as_of_date") -> DataFrame:
    """Per company: the sum of `value` over the day and the next width - 1 days (rows may skip days)."""
    w = Window.partitionBy("company_id").orderBy(F.unix_date(F.col(day))).rangeBetween(0, width - 1)
    return days.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def next_event(days: DataFrame, events: DataFrame, day: str = "as_of_date") -> DataFrame:
    """Forward as-of join: the first event of the company on or after each day (`due_date`, `due_amount`).

    One union and one window over company-days; no pairs of days and events are formed.
    """
    marks = union_all(
        [
            days.select("company_id", day).withColumn("_event", F.lit(None).cast("struct<day:date,amount:decimal(38,2)>")),
            events.select(
                "company_id",
                F.col("day").alias(day),
                F.struct("day", F.col("amount").cast("decimal(38,2)").alias("amount")).alias("_event"),
            ),
        ]
    )
    ahead = Window.partitionBy("company_id").orderBy(F.unix_date(F.col(day)).desc()).rangeBetween(Window.unboundedPreceding, 0)
    found = marks.withColumn("_next", F.min("_event").over(ahead)).where(F.col("_event").isNull())
    return days.join(
        found.select("company_id", day, F.col("_next.day").alias("due_date"), F.col("_next.amount").alias("due_amount")),
        ["company_id", day],
        "left",
    )


def daily_positions(
    accounts: DataFrame, postings: DataFrame, scheduled: DataFrame, first: Column, last: Column
) -> DataFrame:
    """The serving position of every company and day: liquidity as it would have been shown then."""
    balances = start_of_day_balances(accounts, postings, first, last)
    supplier = outflow_days(postings, scheduled, "supplier")
    payroll = outflow_days(postings, scheduled, "payroll")
    # Outflow days join the spine, so a company-day exists for each shown day and each outflow day.
    ahead = balances.select("company_id", F.col("as_of_date").alias("day"), F.lit(1).alias("_shown")).join(
        supplier, ["company_id", "day"], "full"
    )
    sched = forward_sum(ahead, "amount", SUPPLIER_DAYS, "scheduled_out_7d", "day").where(F.col("_shown") == 1)
    dated = next_event(balances.select("company_id", "as_of_date"), payroll)
    joined = balances.join(
        sched.select("company_id", F.col("day").alias("as_of_date"), "scheduled_out_7d"), ["company_id", "as_of_date"]
    ).join(dated, ["company_id", "as_of_date"])
    available = F.col("total_cash") - F.col("reserve_cash") - F.col("scheduled_out_7d")
    near = F.datediff(F.col("due_date"), F.col("as_of_date")) < PAYROLL_DAYS
    return joined.select(
        "company_id",
        "as_of_date",
        F.col("total_cash").cast(MONEY).alias("total_cash"),
        available.cast(MONEY).alias("available"),
        F.col("scheduled_out_7d").cast(MONEY).alias("scheduled_out_7d"),
        F.col("due_date").alias("payroll_due_date"),
        F.col("due_amount").cast(MONEY).alias("payroll_due_amount"),
        F.when(near, available - F.col("due_amount")).otherwise(available).cast(MONEY).alias("forecast_low"),
    )
