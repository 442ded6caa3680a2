"""Queries: ledger quality, postings, calendar, request rates and money texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import (
    to_fils,
    aed_text,
    chart_label,
    signed_aed_text,
    money,
    money_text,
    multiplier,
    typed_amount,
)
from ..functions.times import business_day, date_lit, next_payroll_thursday
from ..operators import ledger_calendar as cal
from ..operators import posting, quality, rates
from ..operators import readmodels as rm
from ..operators.skew import union_all
from .queries_gold import AS_OF, CTX, position
from .queries_readmodels import SHORT
from .registry import query
from .views import VIEWS, Ledger

START = "DATE '2023-11-02'"


def _start():
    return date_lit("2023-11-02")


# ---------------------------------------------------------------- quality and scoping

VIOLATIONS = """
SELECT payment_id, concat_ws(',', CASE WHEN NOT amount > 0 THEN 'amount_not_positive' END,
  CASE WHEN (to_account_id IS NULL) = (beneficiary_id IS NULL) THEN 'not_one_destination' END,
  CASE WHEN to_account_id = from_account_id THEN 'same_account' END,
  CASE WHEN status NOT IN ('AWAITING_APPROVAL', 'EXECUTED', 'REJECTED') THEN 'unknown_status' END,
  CASE WHEN length(reference) > 140 THEN 'reference_too_long' END) AS violations
FROM payments"""


@query(VIOLATIONS)
def payment_violations(L: Ledger) -> DataFrame:
    checked = quality.validate(L.payments, quality.payment_rules())
    return checked.select("payment_id", F.array_join("violations", ",").alias("violations"))


@query(f"SELECT violations <> '' AS quarantined, COUNT(*) AS n FROM ({VIOLATIONS}) GROUP BY 1")
def quarantine_counts(L: Ledger) -> DataFrame:
    valid, bad = quality.split_valid(quality.validate(L.payments, quality.payment_rules()))
    tagged = valid.select(F.lit(False).alias("quarantined")).unionByName(bad.select(F.lit(True).alias("quarantined")))
    return tagged.groupBy("quarantined").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'transactions' AS table_name, transaction_id AS row_id, 'account_id' AS column_name, CAST(account_id AS VARCHAR) AS value
FROM postings WHERE account_id NOT IN (SELECT account_id FROM accounts)
UNION ALL SELECT 'transactions', transaction_id, 'payment_id', CAST(payment_id AS VARCHAR) FROM postings
  WHERE payment_id IS NOT NULL AND payment_id NOT IN (SELECT payment_id FROM payments)
UNION ALL SELECT 'payments', payment_id, 'to_account_id', CAST(to_account_id AS VARCHAR) FROM payments
  WHERE to_account_id IS NOT NULL AND to_account_id NOT IN (SELECT account_id FROM accounts)
UNION ALL SELECT 'payments', payment_id, 'created_by', CAST(created_by AS VARCHAR) FROM payments
  WHERE created_by NOT IN (SELECT user_id FROM users WHERE role = 'approver')""")
def foreign_key_violations(L: Ledger) -> DataFrame:
    """Postings on unknown accounts or payments; payments to unknown accounts or created by non-approvers."""
    tx = [("account_id", L.accounts, "account_id"), ("payment_id", L.payments, "payment_id")]
    approving = L.users.where(F.col("role") == "approver")
    pay = [("to_account_id", L.accounts, "account_id"), ("created_by", approving, "user_id")]
    return union_all(
        [
            quality.foreign_key_violations(L.postings, "transaction_id", tx, "transactions"),
            quality.foreign_key_violations(L.payments, "payment_id", pay, "payments"),
        ]
    )


@query("""
SELECT 'accounts' AS table_name, 'name' AS column_name, name AS value, COUNT(*) AS copies FROM accounts GROUP BY name HAVING COUNT(*) > 1
UNION ALL SELECT 'accounts', 'iban', iban, COUNT(*) FROM accounts GROUP BY iban HAVING COUNT(*) > 1
UNION ALL SELECT 'payments', 'reference', reference, COUNT(*) FROM payments WHERE reference IS NOT NULL GROUP BY reference HAVING COUNT(*) > 1
UNION ALL SELECT 'payments', 'value_date', CAST(value_date AS VARCHAR), COUNT(*) FROM payments GROUP BY value_date HAVING COUNT(*) > 1""")
def uniqueness_violations(L: Ledger) -> DataFrame:
    return quality.uniqueness_violations(L.accounts, "accounts", ["name", "iban"]).unionByName(
        quality.uniqueness_violations(L.payments, "payments", ["reference", "value_date"])
    )


@query("""SELECT user_id, username, r.company_id, 'access_denied' AS action, 'payment' AS target_type,
  CAST(target_id AS VARCHAR) AS target_id, TIMESTAMP '2024-01-31 06:00:00' AS occurred_at
FROM requests r WHERE NOT EXISTS (SELECT 1 FROM payments p WHERE p.payment_id = r.target_id AND p.company_id = r.company_id)""")
def access_denied(L: Ledger) -> DataFrame:
    """Requests for payments that are missing or belong to another company."""
    return quality.denied(L.requests, L.payments, "payment_id", "payment", CTX.now_col)


@query("""SELECT user_id, company_id, target_id FROM requests r
WHERE EXISTS (SELECT 1 FROM payments p WHERE p.payment_id = r.target_id AND p.company_id = r.company_id)""")
def owned_requests(L: Ledger) -> DataFrame:
    return quality.owned(L.requests, L.payments, "payment_id").select("user_id", "company_id", "target_id")


@query("""SELECT d.decision_id, d.payment_id, d.user_id, d.verb, CASE
  WHEN p.created_by = d.user_id THEN 'You can''t ' || d.verb || ' a payment you created.'
  WHEN d.verb = 'approve' AND u.role <> 'approver' THEN 'Only an approver can approve payments.'
  WHEN p.status <> 'AWAITING_APPROVAL' THEN 'This payment is already ' || lower(p.status) || '.' END AS refusal
FROM decisions d JOIN payments p ON p.payment_id = d.payment_id JOIN users u ON u.user_id = d.user_id""")
def decision_outcomes(L: Ledger) -> DataFrame:
    return quality.decision_outcomes(L.decisions, L.payments, L.users)


@query("""SELECT payment_id, decision_id, user_id, verb, attempts FROM (
  SELECT *, row_number() OVER (PARTITION BY payment_id ORDER BY decided_at, decision_id) AS n,
    COUNT(*) OVER (PARTITION BY payment_id) AS attempts FROM decisions) WHERE n = 1""")
def winning_decisions(L: Ledger) -> DataFrame:
    return quality.winning_decisions(L.decisions)


@query("""SELECT a.account_id, a.company_id, a.reference_balance, l.balance_after AS lake_balance,
  CAST(l.balance_after - a.reference_balance AS DECIMAL(18,2)) AS difference,
  l.balance_after IS NOT DISTINCT FROM a.reference_balance AS reconciled
FROM accounts a LEFT JOIN (SELECT account_id, arg_max(balance_after, transaction_id) AS balance_after FROM transactions
  GROUP BY account_id) l ON l.account_id = a.account_id""")
def reconciliation(L: Ledger) -> DataFrame:
    return quality.reconcile(L.accounts, L.transactions)


@query("""SELECT transaction_id, account_id, amount, balance_after, CAST(before + amount AS DECIMAL(18,2)) AS expected_balance FROM (
  SELECT *, lag(balance_after) OVER (PARTITION BY account_id ORDER BY transaction_id) AS before FROM (
    SELECT transaction_id, account_id, amount,
      CAST(CASE WHEN category = 'fee' THEN balance_after + 1 ELSE balance_after END AS DECIMAL(18,2)) AS balance_after
    FROM transactions)) WHERE balance_after <> before + amount""")
def broken_balances(L: Ledger) -> DataFrame:
    """A ledger whose fee postings are off by one shows a break at and after each of them."""
    off = F.when(F.col("category") == "fee", F.col("balance_after") + 1).otherwise(F.col("balance_after"))
    return quality.broken_balances(L.transactions.withColumn("balance_after", off.cast("decimal(18,2)")))


@query("SELECT account_id, MIN(balance_after) AS lowest_balance FROM transactions GROUP BY account_id HAVING MIN(balance_after) < 0")
def negative_balances(L: Ledger) -> DataFrame:
    return quality.negative_balances(L.transactions)


@query("""SELECT p.payment_id, p.company_id, p.from_account_id, p.amount, a.reference_balance FROM payments p
JOIN accounts a ON a.account_id = p.from_account_id AND a.company_id = p.company_id
WHERE p.status = 'AWAITING_APPROVAL' AND p.amount > a.reference_balance""")
def insufficient_funds(L: Ledger) -> DataFrame:
    return quality.insufficient_funds(L.payments, L.accounts)


@query("""SELECT payment_id, score, CASE WHEN model_version = '1' THEN 'payment-anomaly-baseline' ELSE model_name END AS model_name,
  CASE WHEN model_version = '1' THEN 'seed-0' ELSE model_version END AS model_version FROM anomalies""")
def evolved_anomalies(L: Ledger) -> DataFrame:
    """Rows from before the model columns existed take the default model."""
    first = F.col("model_version") == "1"
    rows = L.anomalies.select("payment_id", "score", "model_name", "model_version")
    defaults = {"model_name": F.lit("payment-anomaly-baseline"), "model_version": F.lit("seed-0")}
    return quality.evolve(rows.where(first).select("payment_id", "score"), rows.where(~first), defaults)


@query(f"""SELECT coalesce(s.company_id, r.company_id) AS company_id, s.available AS stored_available, r.available AS recomputed_available
FROM (SELECT a.company_id, CAST(SUM(reference_balance) AS DECIMAL(18,2)) AS total_cash,
    CAST(SUM(CASE WHEN account_kind <> 'reserve' THEN reference_balance ELSE 0 END) - coalesce(MAX(due), 0) AS DECIMAL(18,2)) AS available
  FROM accounts a LEFT JOIN (SELECT company_id, SUM(amount) AS due FROM scheduled
    WHERE kind = 'supplier' AND due_date >= {AS_OF} AND due_date < {AS_OF} + 7 GROUP BY company_id) d ON d.company_id = a.company_id
  GROUP BY a.company_id) s
FULL JOIN position r ON r.company_id = s.company_id
WHERE s.total_cash IS DISTINCT FROM r.total_cash OR s.available IS DISTINCT FROM r.available""")
def serving_parity(L: Ledger) -> DataFrame:
    """Companies whose live figures differ from the recomputed serving row."""
    live = rm.live_totals(L.accounts, L.scheduled, CTX.as_of)
    found = quality.parity(live, position(L), ["company_id"], ["total_cash", "available"])
    return found.select(
        "company_id", F.col("stored.available").alias("stored_available"), F.col("recomputed.available").alias("recomputed_available")
    )


NAMED = ("companies", "users", "accounts", "beneficiaries", "payments", "postings", "scheduled", "outbox")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in NAMED))
def table_counts(L: Ledger) -> DataFrame:
    return quality.table_counts({t: getattr(L, t) for t in NAMED})


def _digested(L: Ledger) -> dict[str, DataFrame]:
    return {"accounts": L.accounts, "beneficiaries": L.beneficiaries, "companies": L.companies, "payments": L.payments,
            "postings": L.postings, "scheduled": L.scheduled, "users": L.users}


@query()
def ledger_digest(L: Ledger) -> DataFrame:
    """One digest of every ledger table, the same in any order and partitioning."""
    return union_all([quality.digest(t).select(F.lit(n).alias("table_name"), "n_rows", "digest") for n, t in _digested(L).items()])


# ---------------------------------------------------------------- postings

VIEWS["legs"] = """
SELECT p.payment_id, p.company_id, p.executed_at AS booked_at, coalesce(reference, 'Payment ' || CAST(payment_id AS VARCHAR)) AS description,
  1 AS leg, from_account_id AS account_id, CAST(-amount AS DECIMAL(18,2)) AS amount,
  CASE WHEN to_account_id IS NULL THEN 'supplier' ELSE 'transfer' END AS category,
  CASE WHEN to_account_id IS NULL THEN b.name ELSE t.name || ' ' || t.iban END AS counterparty
FROM payments p LEFT JOIN beneficiaries b ON b.beneficiary_id = p.beneficiary_id LEFT JOIN accounts t ON t.account_id = p.to_account_id
WHERE p.status = 'EXECUTED'
UNION ALL SELECT p.payment_id, p.company_id, p.executed_at, coalesce(reference, 'Payment ' || CAST(payment_id AS VARCHAR)),
  2, to_account_id, amount, 'transfer', f.name || ' ' || f.iban
FROM payments p JOIN accounts f ON f.account_id = p.from_account_id WHERE p.status = 'EXECUTED' AND to_account_id IS NOT NULL"""


@query("SELECT * FROM legs")
def posting_legs(L: Ledger) -> DataFrame:
    return posting.posting_legs(L.payments, L.accounts, L.beneficiaries)


# ---------------------------------------------------------------- calendar


@query(f"""SELECT * FROM (
  SELECT beneficiary_id, company_id, CAST(CASE WHEN isodow(d) > 5 THEN d + CAST(8 - isodow(d) AS INTEGER) ELSE d END AS DATE) AS due_date FROM (
    SELECT beneficiary_id, company_id, {START} + off + CAST(k AS INTEGER) * cadence AS d FROM (
      SELECT beneficiary_id, company_id, CASE WHEN beneficiary_id % 2 = 1 THEN 7 ELSE 14 END AS cadence,
        CAST(beneficiary_id % CASE WHEN beneficiary_id % 2 = 1 THEN 7 ELSE 14 END AS INTEGER) AS off FROM beneficiaries),
      range(13) AS r(k)))
WHERE due_date < {AS_OF}""")
def recurring_schedule(L: Ledger) -> DataFrame:
    """Every payee's weekly or fortnightly due dates of the last 90 days, on business days."""
    cadence = F.when(F.col("beneficiary_id") % 2 == 1, 7).otherwise(14)
    payees = L.beneficiaries.select(
        "beneficiary_id", "company_id", cadence.alias("cadence_days"), (F.col("beneficiary_id") % cadence).alias("offset_days")
    )
    return cal.recurring_schedule(payees, _start(), CTX.as_of).drop("cadence_days", "offset_days")


@query(f"""SELECT company_id, payday, l.kind AS account_kind, CAST(payday - l.before AS DATE) AS value_date,
  CAST(l.sign * reference_balance AS DECIMAL(18,2)) AS amount, l.category AS category, l.party AS counterparty
FROM (SELECT a.company_id, a.reference_balance, CAST(DATE '2024-02-08' - 28 * CAST(k AS INTEGER) AS DATE) AS payday
  FROM accounts a, range(1, 10) AS r(k) WHERE account_kind = 'payroll'),
  (VALUES ('operating', 1, -1, 'transfer', 'Payroll account'), ('payroll', 1, 1, 'transfer', 'Operating account'),
    ('payroll', 0, -1, 'payroll', 'WPS salary transfer')) AS l(kind, before, sign, category, party)
WHERE payday - 1 >= {START} AND payday < {AS_OF}""")
def payroll_cycle(L: Ledger) -> DataFrame:
    payrolls = L.accounts.where(F.col("account_kind") == "payroll").select("company_id", F.col("reference_balance").alias("amount"))
    return cal.payroll_cycle(payrolls, _start(), CTX.as_of)


@query("""SELECT account_id, company_id, CAST(m AS DATE) AS value_date,
  CASE WHEN account_kind = 'operating' THEN CAST(-525 AS DECIMAL(18,2)) ELSE
    CAST(sign(c) * ((abs(c) * 35 + 6000) // 12000) * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(18,2)) END AS amount,
  CASE WHEN account_kind = 'operating' THEN 'fee' ELSE 'interest' END AS category
FROM (SELECT *, CAST(reference_balance * 100 AS BIGINT) AS c FROM accounts WHERE account_kind IN ('operating', 'reserve')),
  (VALUES (DATE '2023-12-01'), (DATE '2024-01-01')) AS t(m)""")
def month_start_items(L: Ledger) -> DataFrame:
    return cal.month_start_items(L.accounts, _start(), CTX.as_of)


@query("""SELECT company_id, value_date, l.kind AS account_kind, CAST(l.sign * total AS DECIMAL(18,2)) AS amount FROM (
  SELECT a.company_id, p.value_date, SUM(p.amount) AS total FROM postings p JOIN accounts a ON a.account_id = p.account_id
  WHERE a.account_kind = 'collections' AND p.category = 'customer' GROUP BY 1, 2),
  (VALUES ('collections', -1), ('operating', 1)) AS l(kind, sign) WHERE total > 0""")
def daily_sweep(L: Ledger) -> DataFrame:
    return cal.daily_sweep(L.postings, L.accounts)


@query("SELECT account_id, company_id, account_kind, name, iban, CAST((account_id - 1) % 4 + 1 AS INTEGER) AS account_no, true AS iban_ok FROM accounts")
def account_roster(L: Ledger) -> DataFrame:
    roster = cal.account_roster(L.companies.select("company_id"))
    ok = F.col("iban").rlike(r"^AE07 0331 0000 \d{4,} \d{4,} 00\d$")
    return roster.withColumns({"account_no": F.substring("iban", -1, 1).try_cast("int"), "iban_ok": ok})


@query("""SELECT company_id, due_date, CAST(CASE WHEN isodow(due_date) > 5 THEN due_date + CAST(8 - isodow(due_date) AS INTEGER) ELSE due_date END AS DATE)
  AS business_day, CAST(due_date + 3 + CAST((11 - isodow(due_date + 3)) % 7 AS INTEGER) AS DATE) AS payroll_thursday FROM scheduled""")
def business_days(L: Ledger) -> DataFrame:
    due = F.col("due_date")
    return L.scheduled.select(
        "company_id", "due_date", business_day(due).alias("business_day"), next_payroll_thursday(due).alias("payroll_thursday")
    )


# ---------------------------------------------------------------- request rates

VIEWS["increases"] = """
SELECT ts, region, workload, CASE WHEN value < before THEN value ELSE value - before END AS increase FROM (
  SELECT *, lag(value) OVER (PARTITION BY region, workload ORDER BY ts, value) AS before FROM counters) WHERE before IS NOT NULL"""

VIEWS["region_rates"] = """SELECT date_trunc('minute', ts) AS window_start, region, SUM(increase) / 60.0 AS rate
FROM increases GROUP BY 1, 2"""


@query("SELECT * FROM increases")
def counter_increases(L: Ledger) -> DataFrame:
    return rates.counter_increases(L.counters)


@query("SELECT * FROM region_rates")
def request_rate_by_region(L: Ledger) -> DataFrame:
    return rates.request_rate(L.counters)


@query("SELECT date_trunc('minute', ts) AS window_start, region, workload, SUM(increase) / 60.0 AS rate FROM increases GROUP BY 1, 2, 3")
def request_rate_by_workload(L: Ledger) -> DataFrame:
    return rates.request_rate(L.counters, by=("region", "workload"))


@query("""SELECT region, MAX(window_start) AS window_start, arg_max(rate, window_start) AS rate FROM region_rates GROUP BY region""")
def latest_request_rate(L: Ledger) -> DataFrame:
    return rates.latest_rate(rates.request_rate(L.counters))


# ---------------------------------------------------------------- money

BODY = """'AED ' || format('{:,}', abs(f) // 100) || CASE WHEN f % 100 = 0 THEN '' ELSE '.' || lpad(CAST(abs(f) % 100 AS VARCHAR), 2, '0') END"""


@query(f"""SELECT transaction_id, f AS fils, CASE WHEN f < 0 THEN '−' ELSE '' END || {BODY} AS shown,
  CASE WHEN f < 0 THEN '−' ELSE '+' END || {BODY} AS signed, {SHORT.format(f='(f * 1000)')} AS short
FROM (SELECT transaction_id, CAST(amount * 100 AS BIGINT) AS f FROM postings)""")
def money_texts(L: Ledger) -> DataFrame:
    """Display texts of every posting's amount; the short form is shown for a thousand times as much."""
    text = money_text(F.col("amount"))
    return L.postings.select(
        "transaction_id",
        to_fils(text).cast("long").alias("fils"),
        aed_text(text).alias("shown"),
        signed_aed_text(text).alias("signed"),
        chart_label(to_fils(text) * 1000).alias("short"),
    )


VIEWS["typed"] = """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'AED ' || CAST(CAST(value * 1000 AS DECIMAL(18,2)) AS VARCHAR)
  WHEN 1 THEN '-' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) WHEN 2 THEN CAST(CAST(value AS DECIMAL(18,3)) AS VARCHAR)
  WHEN 3 THEN '1,' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') ELSE CAST(event_id % 3 AS VARCHAR) END AS raw FROM events"""


@query("""SELECT event_id, CASE WHEN regexp_full_match(clean, '\\d+(\\.\\d{1,2})?') AND CAST(clean AS DECIMAL(18,2)) > 0
  THEN CAST(CAST(clean AS DECIMAL(18,2)) AS VARCHAR) END AS amount
FROM (SELECT event_id, regexp_replace(regexp_replace(raw, '[,\\s]', '', 'g'), '^AED', '') AS clean FROM typed)""")
def amount_inputs(L: Ledger) -> DataFrame:
    """Amounts as a user might type them, right and wrong, made from every event."""
    e, value = F.col("event_id"), F.col("value")
    raw = (
        F.when(e % 5 == 0, F.concat(F.lit("AED "), (value * 1000).cast("decimal(18,2)").cast("string")))
        .when(e % 5 == 1, F.concat(F.lit("-"), value.cast("decimal(18,2)").cast("string")))
        .when(e % 5 == 2, value.cast("decimal(18,3)").cast("string"))
        .when(e % 5 == 3, F.concat(F.lit("1,"), F.lpad((e % 1000).cast("string"), 3, "0")))
        .otherwise((e % 3).cast("string"))
    )
    return L.raw("events").select("event_id", typed_amount(raw).alias("amount"))


@query("""SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.125 AS DECIMAL(4,3)) AS DECIMAL(18,2)) AS rounded,
  CASE WHEN x >= 10 THEN printf('%.0f', x) ELSE regexp_replace(printf('%.1f', x), '\\.0$', '') END AS times
FROM (SELECT *, round(o_totalprice / 30000.0, 9) AS x FROM orders)""")
def rounded_money(L: Ledger) -> DataFrame:
    """Half-up money rounding, and multipliers as text."""
    eighth = F.col("o_totalprice").cast("decimal(18,2)") * F.lit("0.125").cast("decimal(4,3)")
    times = multiplier(F.round(F.col("o_totalprice") / 30000.0, 9))
    return L.raw("orders").select("o_orderkey", money(eighth).alias("rounded"), times.alias("times"))


@query("""SELECT payment_id, coalesce(CASE WHEN reference IS NOT NULL THEN value_date END, CAST(created_at AS DATE)) AS value_date FROM payments""")
def default_value_dates(L: Ledger) -> DataFrame:
    """A payment without a value date takes the day it was created."""
    given = F.when(F.col("reference").isNotNull(), F.col("value_date"))
    return L.payments.select("payment_id", F.coalesce(given, F.to_date("created_at")).alias("value_date"))
