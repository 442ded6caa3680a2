"""Serving figures per company: totals, liquidity and the next payroll."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import RunContext
from ..functions.money import MONEY
from ..functions.times import next_batch_at
from .skew import union_all

SUPPLIER_DAYS, PAYROLL_DAYS = 7, 10


def account_totals(cash: DataFrame) -> DataFrame:
    """total_cash and non_reserve per company."""
    return cash.groupBy("company_id").agg(
        F.sum("balance").alias("total_cash"),
        F.sum(F.when(F.col("account_kind") != "reserve", F.col("balance")).otherwise(0)).alias("non_reserve"),
    )


def due_within(due: Column, as_of: Column, days: int) -> Column:
    """as_of <= due < as_of + days."""
    return (due >= as_of) & (due < F.date_add(as_of, days))


def schedule_totals(scheduled: DataFrame, as_of: Column) -> DataFrame:
    """Supplier payments of the next 7 days and the next payroll, per company.

    Folding to (company, kind, due date) first gives the sum on the first payroll date as a min_by.
    """
    days = scheduled.groupBy("company_id", "kind", "due_date").agg(F.sum("amount").alias("amount"))
    due, amount = F.col("due_date"), F.col("amount")
    payroll = (F.col("kind") == "payroll") & (due >= as_of)
    supplier = (F.col("kind") == "supplier") & due_within(due, as_of, SUPPLIER_DAYS)
    return days.groupBy("company_id").agg(
        F.sum(F.when(supplier, amount)).alias("scheduled_out_7d"),
        F.min(F.when(payroll, due)).alias("payroll_due_date"),
        F.min_by(amount, F.when(payroll, due)).alias("payroll_due_amount"),
    )


def liquidity(frame: DataFrame, day: Column) -> DataFrame:
    """Add available and forecast_low to (non_reserve, scheduled_out_7d, payroll_due_*)."""
    available = F.col("non_reserve") - F.col("scheduled_out_7d")
    near = F.datediff(F.col("payroll_due_date"), day) < PAYROLL_DAYS
    low = F.when(near, F.col("available") - F.col("payroll_due_amount")).otherwise(F.col("available"))
    return frame.withColumn("available", available).withColumn("forecast_low", low)


def company_position(cash: DataFrame, scheduled: DataFrame, companies: DataFrame | None, ctx: RunContext) -> DataFrame:
    """One serving row per company with accounts; `companies` restricts it to those that moved."""
    mine = cash.where(F.col("position_date") == ctx.as_of)
    if companies is not None:
        mine = mine.join(companies.select("company_id").distinct(), "company_id", "left_semi")
    joined = account_totals(mine).join(schedule_totals(scheduled, ctx.as_of), "company_id", "left")
    filled = joined.withColumn("scheduled_out_7d", F.coalesce("scheduled_out_7d", F.lit(0)))
    return liquidity(filled, ctx.as_of).select(
        "company_id",
        ctx.as_of.alias("as_of_date"),
        *[F.col(c).cast(MONEY).alias(c) for c in ("total_cash", "available", "scheduled_out_7d")],
        "payroll_due_date",
        F.col("payroll_due_amount").cast(MONEY).alias("payroll_due_amount"),
        F.col("forecast_low").cast(MONEY).alias("forecast_low"),
        ctx.now_col.alias("refreshed_at"),
    )


def run_row(spark, ctx: RunContext, finished_at: Column, ingested: DataFrame, moved: DataFrame, refreshed: DataFrame) -> DataFrame:
    """The run-log row of one batch, counted on the cluster; written even when nothing moved."""
    names = ("events_ingested", "events_new", "companies_refreshed")
    tagged = [f.select(F.lit(n).alias("_what")) for f, n in zip((ingested, moved, refreshed), names)]
    one = union_all(tagged).agg(*[F.count(F.when(F.col("_what") == n, 1)).alias(n) for n in names])
    return one.select(
        ctx.run_col.alias("run_id"),
        ctx.started_col.alias("started_at"),
        finished_at.alias("finished_at"),
        "events_ingested",
        "events_new",
        "companies_refreshed",
        F.lit("succeeded").alias("status"),
        next_batch_at(ctx.started_col, finished_at, ctx.cadence_seconds).alias("next_batch_at"),
    )
