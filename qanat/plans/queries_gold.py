"""Queries: gold tables and the serving position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import gulf_date, gulf_day_of_week, gulf_hour, gulf_weekend, weekday
from ..operators import dedupe, gold, serving, upserts
from .registry import query
from .views import VIEWS, Ledger, context

CTX = context()
AS_OF = "DATE '2024-01-31'"


def cash(L: Ledger) -> DataFrame:
    return gold.cash_position_daily(L.accounts, L.transactions, CTX)


def features(L: Ledger) -> DataFrame:
    return gold.payment_features(L.silver_payments, L.silver_postings, CTX)


def flows(L: Ledger) -> DataFrame:
    return gold.daily_flows(L.silver_postings, L.accounts, CTX)


def position(L: Ledger) -> DataFrame:
    return serving.company_position(cash(L), L.scheduled, None, CTX)


VIEWS["cash"] = f"""
SELECT {AS_OF} AS position_date, a.company_id, a.account_id, a.account_kind,
  CAST(coalesce(l.balance_after, a.reference_balance) AS DECIMAL(18,2)) AS balance,
  CASE WHEN l.balance_after IS NOT NULL THEN 'lake' ELSE 'reference' END AS balance_source, l.booked_at AS last_booked_at
FROM accounts a LEFT JOIN (
  SELECT account_id, balance_after, booked_at,
    row_number() OVER (PARTITION BY account_id ORDER BY transaction_id DESC) AS n FROM transactions) l
  ON l.account_id = a.account_id AND l.n = 1"""

VIEWS["features"] = """
SELECT f.*, CASE WHEN beneficiary_prior_mean > 0 THEN CAST(amount AS DOUBLE) / CAST(beneficiary_prior_mean AS DOUBLE) END
  AS amount_to_prior_mean
FROM (
  SELECT p.payment_id, p.company_id, d.transaction_id, from_account_id, to_account_id, beneficiary_id,
    coalesce(beneficiary_name, 'Own account transfer') AS counterparty, amount, value_date, executed_at,
    ln(1 + CAST(amount AS DOUBLE)) AS log_amount,
    CAST(extract(hour FROM executed_at + INTERVAL 4 HOURS) AS INTEGER) AS hour_gst,
    CAST(dayofweek(executed_at + INTERVAL 4 HOURS) + 1 AS INTEGER) AS day_of_week_gst,
    dayofweek(executed_at + INTERVAL 4 HOURS) IN (0, 6) AS is_weekend,
    to_account_id IS NOT NULL AS is_internal,
    CASE WHEN beneficiary_id IS NOT NULL THEN COUNT(*) OVER prior END AS beneficiary_prior_count,
    CASE WHEN beneficiary_id IS NOT NULL AND COUNT(*) OVER prior > 0 THEN
      CAST(CAST(SUM(amount) OVER prior AS DOUBLE) / COUNT(*) OVER prior AS DECIMAL(18,2)) END AS beneficiary_prior_mean,
    beneficiary_id IS NOT NULL AND COUNT(*) OVER prior = 0
      AND executed_at >= MIN(executed_at) OVER (PARTITION BY p.company_id) + INTERVAL 28 DAYS AS is_first_time_beneficiary,
    COUNT(*) OVER twins AS same_day_duplicates
  FROM payments p LEFT JOIN (
    SELECT payment_id, MIN(transaction_id) AS transaction_id FROM postings
    WHERE payment_id IS NOT NULL AND amount < 0 GROUP BY payment_id) d ON d.payment_id = p.payment_id
  WHERE status = 'EXECUTED'
  WINDOW prior AS (PARTITION BY p.company_id, beneficiary_id ORDER BY executed_at, p.payment_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    twins AS (PARTITION BY p.company_id, beneficiary_id, to_account_id, amount, value_date
      ORDER BY executed_at, p.payment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) f"""

VIEWS["flows"] = """
SELECT p.company_id, value_date AS flow_date,
  CAST(SUM(CASE WHEN category NOT IN ('supplier', 'payroll', 'transfer') THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS other_net,
  CAST(SUM(CASE WHEN category = 'supplier' THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS supplier_net,
  CAST(SUM(CASE WHEN category = 'payroll' THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS payroll_net,
  CAST(SUM(CASE WHEN category = 'transfer' THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS transfer_net,
  CAST(SUM(amount) AS DECIMAL(18,2)) AS total_net
FROM postings p JOIN accounts a ON a.account_id = p.account_id
WHERE a.account_kind <> 'reserve' GROUP BY p.company_id, value_date"""

VIEWS["position"] = f"""
SELECT company_id, {AS_OF} AS as_of_date, CAST(total_cash AS DECIMAL(18,2)) AS total_cash,
  CAST(non_reserve - sched AS DECIMAL(18,2)) AS available, CAST(sched AS DECIMAL(18,2)) AS scheduled_out_7d,
  due AS payroll_due_date, CAST(due_amount AS DECIMAL(18,2)) AS payroll_due_amount,
  CAST(CASE WHEN due - {AS_OF} < 10 THEN non_reserve - sched - due_amount ELSE non_reserve - sched END AS DECIMAL(18,2))
    AS forecast_low
FROM (
  SELECT c.company_id, total_cash, non_reserve, coalesce(sched, 0) AS sched, due,
    (SELECT SUM(amount) FROM scheduled x WHERE x.company_id = c.company_id AND x.kind = 'payroll' AND x.due_date = s.due)
      AS due_amount
  FROM (SELECT company_id, SUM(balance) AS total_cash,
      SUM(CASE WHEN account_kind <> 'reserve' THEN balance ELSE 0 END) AS non_reserve FROM cash GROUP BY company_id) c
  LEFT JOIN (SELECT company_id,
      SUM(amount) FILTER (kind = 'supplier' AND due_date >= {AS_OF} AND due_date < {AS_OF} + 7) AS sched,
      MIN(due_date) FILTER (kind = 'payroll' AND due_date >= {AS_OF}) AS due
    FROM scheduled GROUP BY company_id) s ON s.company_id = c.company_id)"""

LINEAGE = "'run-1' AS run_id, TIMESTAMP '2024-01-31 06:00:00'"


@query(f"SELECT *, {LINEAGE} AS computed_at FROM flows")
def daily_flows(L: Ledger) -> DataFrame:
    return flows(L)


@query(f"SELECT *, {LINEAGE} AS computed_at FROM cash")
def cash_position_daily(L: Ledger) -> DataFrame:
    return cash(L)


@query(f"SELECT * EXCLUDE (log_amount), round(log_amount, 9) AS log_amount, {LINEAGE} AS computed_at FROM features")
def payment_features(L: Ledger) -> DataFrame:
    return features(L).withColumn("log_amount", F.round("log_amount", 9))


@query("SELECT *, TIMESTAMP '2024-01-31 06:00:00' AS refreshed_at FROM position")
def company_position(L: Ledger) -> DataFrame:
    return position(L)


@query("""SELECT *, TIMESTAMP '2024-01-31 06:00:00' AS refreshed_at FROM position
WHERE company_id IN (SELECT company_id FROM payments WHERE executed_at >= TIMESTAMP '2024-01-29 00:00:00')""")
def moved_company_position(L: Ledger) -> DataFrame:
    moved = L.payments.where(F.col("executed_at") >= F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))
    return serving.company_position(cash(L), L.scheduled, moved, CTX)


@query("""SELECT account_id, balance_after AS lake_balance, booked_at AS last_booked_at FROM (
  SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY transaction_id DESC) AS n FROM transactions) WHERE n = 1""")
def latest_balance(L: Ledger) -> DataFrame:
    return dedupe.latest_balance(L.transactions)


@query("""SELECT payment_id, company_id, amount, executed_at, payment_id AS event_id FROM payments WHERE status = 'EXECUTED'""")
def executed_payments(L: Ledger) -> DataFrame:
    """Each payment announced twice; the smaller event id stays."""
    events = L.payments.select("payment_id", "company_id", "amount", "executed_at", "status").withColumn("event_id", F.col("payment_id"))
    again = events.withColumns({"event_id": F.col("event_id") + 10_000_000_000, "amount": F.col("amount") + 1})
    return gold.executed_payments(events.unionByName(again.withColumn("amount", F.col("amount").cast("decimal(18,2)")))).drop("status")


@query("SELECT payment_id, MIN(transaction_id) AS transaction_id FROM postings WHERE payment_id IS NOT NULL AND amount < 0 GROUP BY payment_id")
def first_debits(L: Ledger) -> DataFrame:
    return gold.first_debit(L.postings)


@query("""SELECT p.payment_id, p.status, d.transaction_id FROM payments p LEFT JOIN (
  SELECT payment_id, MIN(transaction_id) AS transaction_id FROM postings WHERE amount < 0 GROUP BY payment_id) d
  ON d.payment_id = p.payment_id""")
def payment_debits(L: Ledger) -> DataFrame:
    return L.payments.select("payment_id", "status").join(gold.first_debit(L.postings), "payment_id", "left")


@query("""SELECT payment_id, COUNT(*) OVER w AS prior_n, CAST(SUM(amount) OVER w AS DECIMAL(18,2)) AS prior_sum
FROM payments WHERE status = 'EXECUTED' AND beneficiary_id IS NOT NULL
WINDOW w AS (PARTITION BY company_id, beneficiary_id ORDER BY executed_at, payment_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_payments(L: Ledger) -> DataFrame:
    pay = L.payments.where((F.col("status") == "EXECUTED") & F.col("beneficiary_id").isNotNull())
    done = gold.prior_payments(pay)
    return done.select(
        "payment_id", F.col("_prior_n").alias("prior_n"), F.col("_prior_sum").cast("decimal(18,2)").alias("prior_sum")
    )


@query("""SELECT payment_id, COUNT(*) OVER (PARTITION BY company_id, beneficiary_id, to_account_id, amount, value_date
  ORDER BY executed_at, payment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same_day_duplicates
FROM payments WHERE status = 'EXECUTED'""")
def same_day_duplicates(L: Ledger) -> DataFrame:
    pay = L.payments.where(F.col("status") == "EXECUTED")
    return gold.same_day_twins(pay)


@query("SELECT company_id, payment_id, beneficiary_id, executed_at FROM features WHERE is_first_time_beneficiary")
def first_time_payees(L: Ledger) -> DataFrame:
    return features(L).where("is_first_time_beneficiary").select("company_id", "payment_id", "beneficiary_id", "executed_at")


@query("""SELECT transaction_id, CAST(extract(hour FROM booked_at + INTERVAL 4 HOURS) AS INTEGER) AS hour_gst,
  CAST(dayofweek(booked_at + INTERVAL 4 HOURS) + 1 AS INTEGER) AS day_of_week_gst,
  dayofweek(booked_at + INTERVAL 4 HOURS) IN (0, 6) AS is_weekend,
  CAST(isodow(booked_at + INTERVAL 4 HOURS) - 1 AS INTEGER) AS weekday FROM postings""")
def gulf_clock(L: Ledger) -> DataFrame:
    at = F.col("booked_at")
    return L.postings.select(
        "transaction_id",
        gulf_hour(at).alias("hour_gst"),
        gulf_day_of_week(at).alias("day_of_week_gst"),
        gulf_weekend(at).alias("is_weekend"),
        weekday(gulf_date(at)).alias("weekday"),
    )


@query("""SELECT company_id, CAST(SUM(balance) AS DECIMAL(18,2)) AS total_cash,
  CAST(SUM(CASE WHEN account_kind <> 'reserve' THEN balance ELSE 0 END) AS DECIMAL(18,2)) AS non_reserve
FROM cash GROUP BY company_id""")
def company_cash(L: Ledger) -> DataFrame:
    totals = serving.account_totals(cash(L))
    return totals.select("company_id", *[F.col(c).cast("decimal(18,2)").alias(c) for c in ("total_cash", "non_reserve")])


@query(f"""SELECT company_id, CAST(SUM(amount) FILTER (kind = 'supplier' AND due_date >= {AS_OF} AND due_date < {AS_OF} + 7)
    AS DECIMAL(18,2)) AS scheduled_out_7d, MIN(due_date) FILTER (kind = 'payroll' AND due_date >= {AS_OF}) AS payroll_due_date
FROM scheduled GROUP BY company_id""")
def schedule_totals(L: Ledger) -> DataFrame:
    totals = serving.schedule_totals(L.scheduled, CTX.as_of)
    return totals.select("company_id", F.col("scheduled_out_7d").cast("decimal(18,2)").alias("scheduled_out_7d"), "payroll_due_date")


@query(f"""SELECT account_id, position_date, balance FROM (
  SELECT account_id, DATE '2024-01-30' AS position_date, reference_balance AS balance FROM accounts
  UNION ALL SELECT account_id, position_date, balance FROM cash)""")
def replaced_business_date(L: Ledger) -> DataFrame:
    """A table holding two dates; the business date's rows are replaced, the other date stays."""
    def day(d: str) -> DataFrame:
        return L.accounts.select("account_id", F.lit(d).cast("date").alias("position_date"), F.col("reference_balance").alias("balance"))

    stored = day("2024-01-30").unionByName(day("2024-01-31"))
    fresh = cash(L).select("account_id", "position_date", "balance")
    return upserts.replace_where(stored, fresh, F.col("position_date") == CTX.as_of)


@query(f"""SELECT company_id, as_of_date, available FROM position
UNION ALL SELECT company_id, {AS_OF} AS as_of_date, CAST(0 AS DECIMAL(18,2)) AS available FROM companies
WHERE company_id NOT IN (SELECT company_id FROM position)
UNION ALL SELECT company_id, DATE '2024-01-30' AS as_of_date, CAST(0 AS DECIMAL(18,2)) AS available FROM companies""")
def replaced_positions(L: Ledger) -> DataFrame:
    """Stored rows of two dates; the (company, date) keys that were recomputed are replaced."""
    stored = L.companies.select(
        "company_id",
        F.explode(F.array(*[F.lit(d).cast("date") for d in ("2024-01-30", "2024-01-31")])).alias("as_of_date"),
        F.lit(0).cast("decimal(18,2)").alias("available"),
    )
    return upserts.replace_keys(stored, position(L).select("company_id", "as_of_date", "available"), ["company_id", "as_of_date"])


@query("SELECT account_id, company_id, account_kind, reference_balance FROM accounts")
def reference_accounts(L: Ledger) -> DataFrame:
    from ..sources.ledger import reference_accounts as read

    return read(L)


@query("SELECT company_id, kind, amount, due_date FROM scheduled")
def scheduled_payments(L: Ledger) -> DataFrame:
    from ..sources.ledger import scheduled_payments as read

    return read(L)
