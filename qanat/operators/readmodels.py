"""The queries a treasury portal asks, for one principal's company or for all companies at once.

A principal is a frame with one row (company_id, ...); `scope` keeps only the rows of that company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY, chart_label, to_fils, money_text
from ..functions.text import payment_reference, status_text
from ..functions.times import iso_ts
from .quality import scope
from .serving import SUPPLIER_DAYS, account_totals, due_within
from .skew import spread_join, union_all

# Fixed stage order of a payment's trace.
TRACE_STAGES = ("ledger", "event_hubs", "bronze", "silver", "gold", "serving")
AWAITING = "AWAITING_APPROVAL"


def _limit(n: int, most: int) -> int:
    if not 1 <= n <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return n


def accounts_of(accounts: DataFrame, company_id: int | None) -> DataFrame:
    return scope(accounts, company_id).orderBy("account_id")


def account_by_id(accounts: DataFrame, company_id: int, account_id: int) -> DataFrame:
    """The account, or no row when it is missing or belongs to another company."""
    return scope(accounts, company_id).where(F.col("account_id") == account_id)


def recent_transactions(transactions: DataFrame, company_id: int, account_id: int, limit: int = 100) -> DataFrame:
    """An account's newest postings; ties on the booking time go to the higher id."""
    mine = scope(transactions, company_id).where(F.col("account_id") == account_id)
    return mine.orderBy(F.desc("booked_at"), F.desc("transaction_id")).limit(_limit(limit, 500))


def top_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of every key. The window group limit keeps at most n rows per key and task
    before the shuffle, so a hot key does not travel whole."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def latest_position(positions: DataFrame) -> DataFrame:
    """The newest serving row per company."""
    rest = [c for c in positions.columns if c != "company_id"]
    newest = positions.groupBy("company_id").agg(F.max_by(F.struct(*rest), "as_of_date").alias("_p"))
    return newest.select("company_id", "_p.*")


def dashboard_kpis(positions: DataFrame) -> DataFrame:
    """The newest figures per company, with the payroll-cover flag."""
    covered = F.col("payroll_due_amount").isNotNull() & (F.col("available") < F.col("payroll_due_amount"))
    return latest_position(positions).withColumn("payroll_short", F.coalesce(covered, F.lit(False)))


def dashboard_trend(positions: DataFrame) -> DataFrame:
    """Every stored date; non_reserve is the basis the forecast projects."""
    return positions.select(
        "company_id",
        F.col("as_of_date").alias("date"),
        "total_cash",
        "available",
        (F.col("available") + F.col("scheduled_out_7d")).cast(MONEY).alias("non_reserve"),
    )


def recent_anomalies(anomalies: DataFrame, positions: DataFrame, days: int = 30) -> DataFrame:
    """Flags since midnight `days` days before the company's newest position date."""
    newest = positions.groupBy("company_id").agg(F.max("as_of_date").alias("_newest"))
    since = F.date_sub("_newest", days).cast("timestamp_ntz")
    dated = spread_join(anomalies, newest, ["company_id"], "id", how="inner")
    return dated.where(F.col("occurred_at") >= since).drop("_newest")


def newest_first(anomalies: DataFrame) -> DataFrame:
    return anomalies.orderBy(F.desc("occurred_at"), F.desc("id"))


def anomalies_since(anomalies: DataFrame, now: Column, days: int | None = None) -> DataFrame:
    """The flags of the last `days` days before `now` (1 to 366), or all of them."""
    if days is None:
        return anomalies
    return anomalies.where(F.col("occurred_at") >= now - F.expr(f"INTERVAL {_limit(days, 366)} DAYS"))


def live_totals(accounts: DataFrame, scheduled: DataFrame, as_of: Column) -> DataFrame:
    """Total cash and liquidity straight from the ledger's balances, per company."""
    soon = scheduled.where((F.col("kind") == "supplier") & due_within(F.col("due_date"), as_of, SUPPLIER_DAYS))
    due = soon.groupBy("company_id").agg(F.sum("amount").alias("_due"))
    totals = account_totals(accounts.withColumnRenamed("reference_balance", "balance"))
    return totals.join(due, "company_id", "left").select(
        "company_id",
        F.col("total_cash").cast(MONEY).alias("total_cash"),
        (F.col("non_reserve") - F.coalesce("_due", F.lit(0))).cast(MONEY).alias("available"),
    )


def pipeline_trace(payments: DataFrame, trace: DataFrame, runs: DataFrame) -> DataFrame:
    """Per payment: the stages reached, in order, and when the last batch ended and the next one starts."""
    order = F.array_position(F.array(*[F.lit(s) for s in TRACE_STAGES]), F.col("stage"))
    reached = union_all(
        [
            payments.where(F.col("executed_at").isNotNull()).select(
                "payment_id", F.lit("ledger").alias("stage"), F.col("executed_at").alias("at")
            ),
            trace.join(payments.select("payment_id"), "payment_id", "left_semi").select("payment_id", "stage", "at"),
        ]
    ).where(order > 0)
    listed = reached.groupBy("payment_id").agg(
        F.sort_array(F.collect_list(F.struct(order.alias("n"), "stage", "at"))).alias("_s")
    )  # at most one element per stage
    shown = F.transform("_s", lambda s: F.struct(s["stage"].alias("stage"), iso_ts(s["at"]).alias("at")))
    run = latest_run(runs)
    return payments.select("payment_id", "status").join(listed, "payment_id", "left").select(
        "payment_id",
        "status",
        F.coalesce(shown, F.array().cast("array<struct<stage:string,at:string>>")).alias("stages"),
        run.select("finished_at").scalar().alias("last_batch_at"),
        run.select("next_batch_at").scalar().alias("next_batch_at"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("finished_at"), F.desc("run_id")).limit(1)


def approvers(users: DataFrame) -> DataFrame:
    """Per company: its approvers (id, name), in id order. A company has a handful of users."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("user_id").alias("id"), F.col("display_name").alias("name"))))
    return users.where(F.col("role") == "approver").groupBy("company_id").agg(listed.alias("approvers"))


def awaiting_from(approver_list: Column, creator: Column) -> Column:
    """Names of the approvers other than the creator."""
    others = F.filter(approver_list, lambda a: a["id"] != creator)
    return F.transform(others, lambda a: a["name"])


def payments_view(
    payments: DataFrame, users: DataFrame, accounts: DataFrame, beneficiaries: DataFrame, anomalies: DataFrame
) -> DataFrame:
    """Payments with names, destination objects, flags and the approvers still asked.

    The creator and the from-account must exist; the other parties may be absent. Every look-up is by an id
    that one busy user, account or payee may repeat, so those joins are spread.
    """
    people = users.select(F.col("user_id"), F.col("display_name"))
    places = accounts.select("account_id", F.col("name"))

    def named(rows: DataFrame, table: DataFrame, key: str, name: str, column: str, as_name: str, how: str) -> DataFrame:
        look_up = table.select(F.col(key).alias(column), F.col(name).alias(as_name))
        return spread_join(rows, look_up, [column], "payment_id", how)

    p = named(payments, people, "user_id", "display_name", "created_by", "created_by_name", "inner")
    p = named(p, people, "user_id", "display_name", "decided_by", "decided_by_name", "left")
    p = named(p, places, "account_id", "name", "from_account_id", "from_account_name", "inner")
    p = named(p, places, "account_id", "name", "to_account_id", "to_account_name", "left")
    p = named(p, beneficiaries, "beneficiary_id", "name", "beneficiary_id", "beneficiary_name", "left")
    flags = anomalies.select("payment_id", "company_id", F.col("score").alias("_score"), F.col("reason").alias("_reason"))
    p = p.join(flags, ["payment_id", "company_id"], "left")
    p = spread_join(p, approvers(users), ["company_id"], "payment_id")

    def ref(id_: str, name: str) -> Column:
        return F.when(F.col(id_).isNotNull(), F.struct(F.col(id_).alias("id"), F.col(name).alias("name")))

    waiting = F.when(F.col("status") == AWAITING, awaiting_from(F.col("approvers"), F.col("created_by")))
    p = p.withColumn("_waiting", F.coalesce(waiting, F.array().cast("array<string>")))
    anomaly = F.struct(F.col("_score").cast("string").alias("score"), F.col("_reason").alias("reason"))
    return p.select(
        "payment_id",
        "company_id",
        "status",
        money_text(F.col("amount")).alias("amount"),
        "currency",
        "value_date",
        "reference",
        ref("from_account_id", "from_account_name").alias("from_account"),
        ref("to_account_id", "to_account_name").alias("to_account"),
        ref("beneficiary_id", "beneficiary_name").alias("beneficiary"),
        ref("created_by", "created_by_name").alias("created_by"),
        "created_at",
        ref("decided_by", "decided_by_name").alias("decided_by"),
        "decided_at",
        "executed_at",
        F.col("_waiting").alias("awaiting_approval_from"),
        F.when(F.col("_reason").isNotNull(), anomaly).alias("anomaly"),
    )


def payments_list(view: DataFrame, company_id: int | None, status: str | None = None, limit: int = 200) -> DataFrame:
    mine = scope(view, company_id)
    if status is not None:
        if status not in (AWAITING, "EXECUTED", "REJECTED"):
            raise ValueError(f"unknown status {status!r}")
        mine = mine.where(F.col("status") == status)
    return mine.orderBy(F.desc("created_at"), F.desc("payment_id")).limit(_limit(limit, 1000))


def payment_sections(view: DataFrame) -> DataFrame:
    """Payments split into those awaiting approval and the history, with their display texts."""
    return view.withColumns(
        {
            "section": F.when(F.col("status") == AWAITING, "awaiting").otherwise("history"),
            "shown_as": payment_reference(F.col("payment_id")),
            "status_text": status_text(F.col("status"), F.col("awaiting_approval_from")),
        }
    )


def beneficiaries_of(beneficiaries: DataFrame, company_id: int | None) -> DataFrame:
    return scope(beneficiaries, company_id).orderBy("name", "beneficiary_id")


def first_forecast_points(forecast: DataFrame, n: int = 30) -> DataFrame:
    """The first n forecast days of every company, with the model that made them."""
    return top_per_key(forecast, "company_id", [F.col("forecast_date")], n)


def payment_flagged(payments: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Per payment: whether its own company has a flag on it, and the flag."""
    flags = anomalies.select("payment_id", "company_id", "score", "reason")
    return payments.select("payment_id", "company_id").join(flags, ["payment_id", "company_id"], "left").withColumn(
        "flagged", F.col("reason").isNotNull()
    )


def models_view(models: DataFrame) -> DataFrame:
    """Registered models by name, metrics as a map."""
    return models.withColumn("metrics", F.from_json("metrics", "map<string,double>")).orderBy("model_name")


def lowest_forecast_day(forecast: DataFrame) -> DataFrame:
    """The first day of the lowest predicted balance per company."""
    low = F.struct(F.col("predicted_balance").alias("predicted_balance"), F.col("forecast_date").alias("forecast_date"))
    return forecast.groupBy("company_id").agg(F.min(low).alias("_low")).select(
        "company_id",
        F.col("_low.forecast_date").alias("forecast_date"),
        F.col("_low.predicted_balance").alias("predicted_balance"),
    )


def lowest_day_label(forecast: DataFrame, positions: DataFrame) -> DataFrame:
    """The lowest day's label; the shortfall against the next payroll follows in brackets when there is one."""
    payroll = latest_position(positions).select("company_id", "payroll_due_amount")
    low = lowest_forecast_day(forecast).join(payroll, "company_id", "left")
    predicted, wages = (to_fils(money_text(F.col(c))) for c in ("predicted_balance", "payroll_due_amount"))
    short = F.when(predicted < wages, predicted - wages)
    label = F.concat(F.date_format("forecast_date", "EEE"), F.lit(": "), chart_label(predicted))
    return low.select(
        "company_id",
        "forecast_date",
        "predicted_balance",
        (short / 100).cast(MONEY).alias("shortfall"),
        F.when(short.isNotNull(), F.concat(label, F.lit(" ("), chart_label(short), F.lit(")")))
        .otherwise(label)
        .alias("label"),
    )


def liquidity_chart(trend: DataFrame, forecast: DataFrame, past: int = 30, ahead: int = 14) -> DataFrame:
    """One series per company: the last actual days, then the first forecast days."""
    actual = top_per_key(trend, "company_id", [F.desc("date")], past)
    planned = top_per_key(forecast, "company_id", [F.col("forecast_date")], ahead)
    return union_all(
        [
            actual.select("company_id", F.lit("actual").alias("series"), "date", F.col("non_reserve").alias("value")),
            planned.select(
                "company_id",
                F.lit("forecast").alias("series"),
                F.col("forecast_date").alias("date"),
                F.col("predicted_balance").alias("value"),
            ),
        ]
    )


def user_profiles(users: DataFrame, companies: DataFrame) -> DataFrame:
    """Users with their company's name. Companies grow with the ledger: the hint keeps them off the driver."""
    named = companies.select("company_id", F.col("name").alias("company_name")).hint("merge")
    return users.join(named, "company_id").select(
        "user_id", "username", "display_name", "title", "role", "email", "company_id", "company_name"
    )


def ledger_lines(transactions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Ledger lines as shown: `counterparty: description`, marked when their payment is flagged.

    Postings without a payment are a common NULL key; they pass by the join.
    """
    flags = anomalies.select("payment_id", F.lit(True).alias("_flag")).distinct()
    text = F.concat_ws(": ", "counterparty", "description").alias("line")
    shown = transactions.select("transaction_id", "company_id", "account_id", "payment_id", "amount", text)
    paid = shown.where(F.col("payment_id").isNotNull()).join(flags, "payment_id", "left")
    rest = shown.where(F.col("payment_id").isNull()).withColumn("_flag", F.lit(None).cast("boolean"))
    return paid.unionByName(rest).withColumn("flagged", F.coalesce("_flag", F.lit(False))).drop("_flag")
