"""30-day cash forecast: a weekday profile learned from daily flows, projected for all companies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..functions.times import weekday
from .gold_state import SQUARES, STREAMS, SUM, flow_moments
from .skew import union_all

MODEL_NAME = "cash_forecast"
HORIZON_DAYS, PAYROLL_CYCLE_DAYS, HOLDOUT_DAYS = 30, 28, 28
BAND = 0.80
Z_BAND = 1.2815515655446004  # fixed value: a tenth of a normal distribution lies above it, so BAND of it between -Z and Z
# Means keep eight decimals so that a month of them adds up exactly, in any order. Sums are cast
# back before they meet such a mean: next to a decimal(38, x), it would lose decimals.
FINE = "decimal(28,8)"


def fit_profile(history: DataFrame) -> DataFrame:
    """Per company and weekday: mean and sample SD of the other and supplier streams."""
    def mean(c: str) -> Column:
        return (F.sum(c) / F.count(c)).cast(FINE)

    def spread(c: str) -> Column:
        return F.coalesce(F.stddev_samp(F.col(c).cast("double")), F.lit(0.0))

    return history.groupBy("company_id", "weekday").agg(
        mean("other_net").alias("other_mean"),
        spread("other_net").alias("other_sd"),
        mean("supplier_net").alias("supplier_mean"),
        spread("supplier_net").alias("supplier_sd"),
        F.count(F.lit(1)).alias("days"),
    )


def fit_from_moments(moments: DataFrame, daily: DataFrame, until: Column) -> DataFrame:
    """fit_profile of the days before `until` without the days: whole months come from their moments, only the month of
    `until` from the daily flows.

    Days without a flow count as zeros from a company's first flow on, so their number follows from the calendar. Sums are
    exact for totals below 10^17 and sums of squares below 10^34 / days. Flows without a company are one of their own."""
    month = F.trunc(until, "MM")
    recent = flow_moments(daily.where((F.col("flow_date") >= month) & (F.col("flow_date") < until)))
    both = moments.where(F.col("month") < month).unionByName(recent)
    sums = [F.sum(f"{c}_{kind}").cast(t).alias(f"{c}_{kind}") for c in STREAMS for kind, t in (("sum", SUM), ("squares", SQUARES))]
    held = both.groupBy("company_id", "weekday").agg(F.min("first_day").alias("_first"), *sums)
    row = F.struct(*[f"{c}_{kind}" for c in STREAMS for kind in ("sum", "squares")])
    by_company = held.groupBy("company_id").agg(
        F.min("_first").alias("_start"), F.map_from_entries(F.collect_list(F.struct("weekday", row))).alias("_sums")
    )  # seven entries at most
    each = by_company.select("company_id", "_start", "_sums", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
    later = F.pmod(F.col("weekday") - weekday(F.col("_start")), F.lit(7))  # days from the start to the first such weekday
    counted = each.withColumn("days", F.floor((F.datediff(until, F.col("_start")) - later + 6) / F.lit(7)).cast("long")).where("days > 0")
    n = F.col("days")

    def total(c: str, kind: str, t: str) -> Column:
        return F.coalesce(F.try_element_at("_sums", F.col("weekday"))[f"{c}_{kind}"], F.lit(0)).cast(t)

    def mean(c: str) -> Column:
        return (total(c, "sum", SUM) / n).cast(FINE)

    def spread(c: str) -> Column:
        s = total(c, "sum", "decimal(19,2)")
        above = (n.cast("decimal(10,0)") * total(c, "squares", SQUARES) - s * s).cast("double")
        return F.when(n > 1, F.sqrt(above / (n * (n - 1)))).otherwise(0.0)

    return counted.select(
        "company_id",
        "weekday",
        mean("other_net").alias("other_mean"),
        spread("other_net").alias("other_sd"),
        mean("supplier_net").alias("supplier_mean"),
        spread("supplier_net").alias("supplier_sd"),
        "days",
    )


def predict(profile: DataFrame, days: DataFrame) -> DataFrame:
    """Attach the learned flow to (company, weekday) rows; an unknown pair gets zeros."""
    learned = profile.select("company_id", "weekday", "other_mean", "other_sd", "supplier_mean", "supplier_sd")
    zero = {"other_mean": F.lit(0).cast(FINE), "supplier_mean": F.lit(0).cast(FINE), "other_sd": F.lit(0.0), "supplier_sd": F.lit(0.0)}
    return days.join(learned, ["company_id", "weekday"], "left").withColumns({c: F.coalesce(F.col(c), z) for c, z in zero.items()})


def horizon_end(as_of: Column, horizon: int = HORIZON_DAYS) -> Column:
    return F.date_add(as_of, horizon - 1)


def within_horizon(scheduled: DataFrame, as_of: Column, horizon: int = HORIZON_DAYS) -> DataFrame:
    return scheduled.where(F.col("due_date").between(as_of, horizon_end(as_of, horizon)))


def known_outflows(scheduled: DataFrame, as_of: Column, horizon: int = HORIZON_DAYS) -> DataFrame:
    """(company, stream, day, amount) of the horizon; any kind but payroll counts as supplier."""
    stream = F.when(F.col("kind") == "payroll", "payroll").otherwise("supplier").alias("stream")
    return (
        within_horizon(scheduled, as_of, horizon)
        .groupBy("company_id", stream, F.col("due_date").alias("day"))
        .agg(F.sum("amount").cast(MONEY).alias("amount"))
    )


def payroll_days(known: DataFrame, as_of: Column, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Known payrolls and their 28-day repeats; a known date wins, then the earliest source."""
    end = horizon_end(as_of, horizon)
    pay = known.where(F.col("stream") == "payroll").select("company_id", F.col("day").alias("source"), "amount")
    repeat = F.date_add("source", PAYROLL_CYCLE_DAYS)
    later = F.when(repeat <= end, F.sequence(repeat, end, F.expr(f"INTERVAL {PAYROLL_CYCLE_DAYS} DAYS")))
    every = union_all(
        [
            pay.select("company_id", F.col("source").alias("day"), F.lit(0).alias("rank"), "source", "amount"),
            pay.select("company_id", F.explode(later).alias("day"), F.lit(1).alias("rank"), "source", "amount"),
        ]
    )
    return every.groupBy("company_id", "day").agg(F.min_by("amount", F.struct("rank", "source")).alias("amount"))


def forecast_days(companies: DataFrame, as_of: Column, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Every company on each of the horizon's days."""
    days = F.sequence(as_of, horizon_end(as_of, horizon), F.expr("INTERVAL 1 DAY"))
    return companies.select("*", F.explode(days).alias("day")).withColumn("weekday", weekday(F.col("day")))


def project(
    profile: DataFrame, balances: DataFrame, scheduled: DataFrame, as_of: Column, horizon: int = HORIZON_DAYS
) -> DataFrame:
    """End-of-day balances with an 80 % band for every company in `balances` (company_id, balance).

    Known payments are subtracted on their days; the learned supplier flow counts only after the last
    known supplier payment.
    """
    known = known_outflows(scheduled, as_of, horizon)
    supplier = known.where(F.col("stream") == "supplier")
    last_known = supplier.groupBy("company_id").agg(F.max("day").alias("supplier_until"))
    outflow = (
        union_all([supplier.select("company_id", "day", "amount"), payroll_days(known, as_of, horizon)])
        .groupBy("company_id", "day")
        .agg(F.sum("amount").cast(MONEY).alias("known_out"))
    )
    days = forecast_days(balances.join(last_known, "company_id", "left"), as_of, horizon)
    rows = predict(profile, days).join(outflow, ["company_id", "day"], "left")
    learned = F.col("supplier_until").isNull() | (F.col("day") > F.col("supplier_until"))
    flow = (
        F.col("other_mean")
        + F.when(learned, F.col("supplier_mean")).otherwise(0)
        - F.coalesce(F.col("known_out"), F.lit(0))
    )
    variance = F.pow("other_sd", F.lit(2.0)) + F.when(learned, F.pow("supplier_sd", F.lit(2.0))).otherwise(0.0)
    path = Window.partitionBy("company_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select(
        "company_id",
        F.col("day").alias("forecast_date"),
        (F.col("balance") + F.sum(flow.cast(FINE)).over(path).cast(FINE)).cast(FINE).alias("_balance"),
        (F.lit(Z_BAND) * F.sqrt(F.sum(variance).over(path))).cast(FINE).alias("_half"),
    )
    return summed.select(
        "company_id",
        "forecast_date",
        F.col("_balance").cast(MONEY).alias("predicted_balance"),
        (F.col("_balance") - F.col("_half")).cast(MONEY).alias("lower_bound"),
        (F.col("_balance") + F.col("_half")).cast(MONEY).alias("upper_bound"),
    )


def latest_non_reserve(cash: DataFrame) -> DataFrame:
    """Non-Reserve balance per company on the newest position date of the whole table."""
    per_day = (
        cash.where(F.col("account_kind") != "reserve")
        .groupBy("company_id", "position_date")
        .agg(F.sum("balance").cast(MONEY).alias("balance"))
    )
    newest = cash.agg(F.max("position_date")).scalar()
    return per_day.where(F.col("position_date") == newest).select("company_id", "balance")


def forecast_rows(projected: DataFrame, name: str, version: str, generated_at: Column) -> DataFrame:
    return projected.select(
        "*", F.lit(name).alias("model_name"), F.lit(version).alias("model_version"), generated_at.alias("generated_at")
    )


def split_holdout(history: DataFrame, holdout_days: int = HOLDOUT_DAYS) -> DataFrame:
    """The history with `held_out`: the last days by the newest date of all companies."""
    newest = history.agg(F.max("flow_date")).scalar()
    return history.withColumn("held_out", F.col("flow_date") >= F.date_sub(newest, holdout_days - 1))


def backtest(history: DataFrame, holdout_days: int = HOLDOUT_DAYS) -> DataFrame:
    """One row of metrics of the profile fitted without the last days; no row when either side is empty."""
    split = split_holdout(history, holdout_days)
    train, test = split.where(~F.col("held_out")), split.where("held_out")
    daily = (F.col("other_net") + F.col("supplier_net")).cast("double")
    plain = train.groupBy("company_id").agg(F.avg(daily).alias("naive"))
    scored = (
        predict(fit_profile(train), test.select("company_id", "weekday", daily.alias("actual")))
        .join(plain, "company_id", "left")
        .select(
            F.abs(F.col("actual") - (F.col("other_mean") + F.col("supplier_mean")).cast("double")).alias("miss"),
            F.abs(F.col("actual") - F.coalesce("naive", F.lit(0.0))).alias("naive_miss"),
            F.sqrt(F.pow("other_sd", F.lit(2.0)) + F.pow("supplier_sd", F.lit(2.0))).alias("sd"),
        )
    )
    blank = F.lit(None)
    held = scored.select(
        "miss",
        "naive_miss",
        (F.col("miss") <= F.lit(Z_BAND) * F.col("sd")).cast("double").alias("inside"),
        blank.cast("int").alias("company_id"),
        blank.cast("boolean").alias("held_out"),
    )
    days = split.select(
        *[blank.cast("double").alias(c) for c in ("miss", "naive_miss", "inside")], "company_id", "held_out"
    )
    sums = union_all([held, days]).agg(
        F.avg("miss").alias("mae"),
        F.avg("naive_miss").alias("naive_mae"),
        F.avg("inside").alias("inside"),
        F.countDistinct("company_id").alias("companies"),
        F.count("held_out").alias("training_days"),
        F.count(F.when(~F.col("held_out"), 1)).alias("_train"),
    )
    skill = F.when(F.col("naive_mae") != 0, F.round(1 - F.col("mae") / F.col("naive_mae"), 4)).otherwise(0.0)
    return sums.where(F.col("mae").isNotNull() & (F.col("_train") > 0)).select(
        F.lit(float(holdout_days)).alias("holdout_days"),
        F.round("mae", 2).alias("holdout_mae"),
        F.round("naive_mae", 2).alias("naive_mae"),
        skill.alias("mae_skill"),
        F.round("inside", 4).alias("band80_coverage"),
        F.col("companies").cast("double").alias("companies"),
        F.col("training_days").cast("double").alias("training_days"),
    )


def run_rates(postings: DataFrame, supplier_out: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Daily customer receipts and past supplier outflow per company, averaged over the history."""
    receipts = (
        postings.where(F.col("category") == "customer").groupBy("company_id").agg(F.sum("amount").alias("_in"))
    )
    paid = supplier_out.where(F.col("day") < as_of).groupBy("company_id").agg(F.sum("amount").alias("_out"))
    def rate(c: str) -> Column:
        return (F.coalesce(F.col(c), F.lit(0)).cast(FINE) / days).cast(FINE)

    return receipts.join(paid, "company_id", "full").select(
        "company_id", rate("_in").alias("daily_receipts"), rate("_out").alias("supplier_run_rate")
    )


def baseline_forecast(
    totals: DataFrame, rates: DataFrame, supplier_out: DataFrame, next_payroll: DataFrame, as_of: Column,
    horizon: int = HORIZON_DAYS,
) -> DataFrame:
    """The schedule-then-run-rate forecast shown before a model is trained.

    totals (company_id, total_cash, non_reserve); next_payroll (company_id, payroll_date, payroll_amount).
    """
    money = {c: F.col(c).cast(MONEY) for c in ("total_cash", "non_reserve")}
    base = totals.withColumns(money).join(rates, "company_id", "left").join(next_payroll, "company_id", "left")
    k = F.datediff(F.col("day"), as_of)
    days = forecast_days(base, as_of, horizon).join(
        supplier_out.select("company_id", "day", F.col("amount").alias("_scheduled")), ["company_id", "day"], "left"
    )
    since = F.datediff(F.col("day"), F.col("payroll_date"))
    zero = F.lit(0).cast(FINE)
    out = F.when(k < 14, F.coalesce(F.col("_scheduled"), zero)).otherwise(F.coalesce(F.col("supplier_run_rate"), zero))
    wages = F.when((since >= 0) & (since % PAYROLL_CYCLE_DAYS == 0), F.col("payroll_amount")).otherwise(zero)
    received = F.when((k >= 7) & (F.col("weekday") < 5), F.coalesce(F.col("daily_receipts"), zero) * 7 / 5).otherwise(zero)
    path = Window.partitionBy("company_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    flow = (received - out - wages).cast(FINE)
    balance = (F.col("non_reserve") + F.sum(flow).over(path).cast(FINE)).cast(FINE)
    run = days.select("company_id", "day", "total_cash", k.alias("_k"), balance.alias("_balance"))
    band = (
        F.abs(F.col("_balance")) * F.lit(0.03).cast("decimal(4,3)")
        + F.col("_k").cast("int") * F.lit(0.004).cast("decimal(4,3)") * F.col("total_cash")
    ).cast(FINE)
    return run.select(
        "company_id",
        F.col("day").alias("forecast_date"),
        F.col("_balance").cast(MONEY).alias("predicted_balance"),
        (F.col("_balance") - band).cast(MONEY).alias("lower_bound"),
        (F.col("_balance") + band).cast(MONEY).alias("upper_bound"),
    )
