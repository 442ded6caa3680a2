"""Queries: what the portal's screens and APIs ask, answered for every company."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import same_email
from ..functions.times import ts_lit
from ..operators import quality
from ..operators import readmodels as rm
from ..operators.upserts import replace_keys
from .queries_forecast import day_positions, forecast_table
from .queries_gold import AS_OF, CTX, position
from .registry import query
from .views import NOW, VIEWS, Ledger

VIEWS["models"] = """
SELECT 'cash_forecast_' || CAST(company_id AS VARCHAR) AS model_name, CAST(COUNT(*) % 7 + 1 AS VARCHAR) AS model_version,
  COUNT(*) AS postings, COUNT(DISTINCT value_date) AS days FROM postings GROUP BY company_id"""


def models(L: Ledger) -> DataFrame:
    """A registered model per company with its metrics as JSON."""
    per_day = L.postings.groupBy("company_id", "value_date").agg(F.count(F.lit(1)).alias("n"))
    per_company = per_day.groupBy("company_id").agg(F.sum("n").alias("postings"), F.count(F.lit(1)).alias("days"))
    return per_company.select(
        F.concat(F.lit("cash_forecast_"), F.col("company_id").cast("string")).alias("model_name"),
        (F.col("postings") % 7 + 1).cast("string").alias("model_version"),
        F.to_json(F.struct("days", "postings")).alias("metrics"),
    )


@query("SELECT account_id, company_id, account_kind, name, iban, reference_balance FROM accounts")
def accounts_list(L: Ledger) -> DataFrame:
    return rm.accounts_of(L.accounts, None)


@query("SELECT account_id, company_id, account_kind, name, iban, reference_balance FROM accounts WHERE company_id = 1 AND account_id = 1")
def account_by_id(L: Ledger) -> DataFrame:
    """One account, as its own company sees it."""
    return rm.account_by_id(L.accounts, 1, 1)


@query("""SELECT transaction_id, account_id, booked_at, amount, line FROM (
  SELECT transaction_id, account_id, booked_at, amount, counterparty || ': ' || description AS line,
    row_number() OVER (PARTITION BY account_id ORDER BY booked_at DESC, transaction_id DESC) AS n FROM postings) WHERE n <= 100""")
def recent_transactions(L: Ledger) -> DataFrame:
    """The newest 100 postings of every account, the read model's page."""
    lines = L.postings.select(
        "transaction_id", "account_id", "booked_at", "amount", F.concat_ws(": ", "counterparty", "description").alias("line")
    )
    return rm.top_per_key(lines, "account_id", [F.desc("booked_at"), F.desc("transaction_id")], 100)


@query("""SELECT p.*, coalesce(available < payroll_due_amount, false) AS payroll_short FROM day_positions p
WHERE as_of_date = (SELECT MAX(as_of_date) FROM day_positions x WHERE x.company_id = p.company_id)""")
def dashboard_kpis(L: Ledger) -> DataFrame:
    return rm.dashboard_kpis(day_positions(L))


@query("""SELECT company_id, as_of_date AS date, total_cash, available,
  CAST(available + scheduled_out_7d AS DECIMAL(18,2)) AS non_reserve FROM day_positions""")
def dashboard_trend(L: Ledger) -> DataFrame:
    return rm.dashboard_trend(day_positions(L))


@query("""SELECT a.id, a.company_id, a.occurred_at, a.score FROM anomalies a JOIN (
  SELECT company_id, MAX(as_of_date) AS newest FROM position GROUP BY company_id) p ON p.company_id = a.company_id
WHERE a.occurred_at >= CAST(p.newest - 30 AS TIMESTAMP)""")
def recent_anomalies(L: Ledger) -> DataFrame:
    found = rm.recent_anomalies(L.anomalies, position(L), days=30)
    return found.select("id", "company_id", "occurred_at", "score")


@query("SELECT id, company_id, occurred_at, reason FROM anomalies ORDER BY occurred_at DESC, id DESC")
def newest_anomalies(L: Ledger) -> DataFrame:
    """All flags, newest first."""
    return rm.newest_first(L.anomalies).select("id", "company_id", "occurred_at", "reason")


@query("SELECT id, company_id, score, reason FROM anomalies WHERE occurred_at >= TIMESTAMP '2024-01-31 06:00:00' - INTERVAL 14 DAYS")
def anomalies_since(L: Ledger) -> DataFrame:
    return rm.anomalies_since(L.anomalies, ts_lit(NOW), 14).select("id", "company_id", "score", "reason")


@query(f"""SELECT a.company_id, CAST(SUM(reference_balance) AS DECIMAL(18,2)) AS total_cash,
  CAST(SUM(CASE WHEN account_kind <> 'reserve' THEN reference_balance ELSE 0 END) - coalesce(MAX(due), 0) AS DECIMAL(18,2)) AS available
FROM accounts a LEFT JOIN (SELECT company_id, SUM(amount) AS due FROM scheduled
  WHERE kind = 'supplier' AND due_date >= {AS_OF} AND due_date < {AS_OF} + 7 GROUP BY company_id) s ON s.company_id = a.company_id
GROUP BY a.company_id""")
def live_totals(L: Ledger) -> DataFrame:
    return rm.live_totals(L.accounts, L.scheduled, CTX.as_of)


@query("""SELECT p.payment_id, p.status, s.stages, r.finished_at AS last_batch_at, r.next_batch_at FROM payments p
LEFT JOIN (SELECT payment_id, string_agg(stage, ',' ORDER BY list_position(
    ['ledger', 'event_hubs', 'bronze', 'silver', 'gold', 'serving'], stage)) AS stages FROM (
  SELECT payment_id, 'ledger' AS stage FROM payments WHERE executed_at IS NOT NULL
  UNION ALL SELECT payment_id, stage FROM trace) GROUP BY payment_id) s ON s.payment_id = p.payment_id
CROSS JOIN (SELECT * FROM runs ORDER BY finished_at DESC, run_id DESC LIMIT 1) r""")
def pipeline_trace(L: Ledger) -> DataFrame:
    """Stages reached by every payment, in order, as text."""
    found = rm.pipeline_trace(L.payments, L.trace, L.runs)
    names = F.array_join(F.transform("stages", lambda s: s["stage"]), ",")
    return found.withColumn("stages", F.when(F.size("stages") > 0, names))


@query("SELECT finished_at, next_batch_at, run_id FROM runs ORDER BY finished_at DESC, run_id DESC LIMIT 1")
def latest_run(L: Ledger) -> DataFrame:
    return rm.latest_run(L.runs)


VIEWS["payment_view"] = """
SELECT p.payment_id, p.company_id, p.status, CAST(p.amount AS VARCHAR) AS amount, c.display_name AS created_by_name,
  d.display_name AS decided_by_name, f.name AS from_name, t.name AS to_name, b.name AS beneficiary_name,
  CAST(a.score AS VARCHAR) AS anomaly_score, a.reason AS anomaly_reason, p.created_at,
  CASE WHEN p.status = 'AWAITING_APPROVAL' THEN (SELECT string_agg(u.display_name, ' or ' ORDER BY u.user_id) FROM users u
    WHERE u.company_id = p.company_id AND u.role = 'approver' AND u.user_id <> p.created_by) END AS approvers
FROM payments p JOIN users c ON c.user_id = p.created_by LEFT JOIN users d ON d.user_id = p.decided_by
JOIN accounts f ON f.account_id = p.from_account_id LEFT JOIN accounts t ON t.account_id = p.to_account_id
LEFT JOIN beneficiaries b ON b.beneficiary_id = p.beneficiary_id
LEFT JOIN anomalies a ON a.payment_id = p.payment_id AND a.company_id = p.company_id"""


def payment_rows(L: Ledger) -> DataFrame:
    return rm.payments_view(L.payments, L.users, L.accounts, L.beneficiaries, L.anomalies)


@query("""SELECT *, CASE status WHEN 'AWAITING_APPROVAL' THEN 'awaiting' ELSE 'history' END AS section,
  'PAY-' || CAST(payment_id AS VARCHAR) AS shown_as,
  CASE status WHEN 'EXECUTED' THEN 'Executed' WHEN 'REJECTED' THEN 'Rejected'
    ELSE CASE WHEN approvers IS NULL THEN 'Awaiting approval' ELSE 'Awaiting approval from ' || approvers END END AS status_text
FROM payment_view""")
def payments_view(L: Ledger) -> DataFrame:
    """All payments with names, flags, approvers still asked and display texts, objects flattened."""
    return rm.payment_sections(payment_rows(L)).select(
        "payment_id", "company_id", "status", "amount", "created_at", "section", "shown_as", "status_text",
        F.col("created_by.name").alias("created_by_name"), F.col("decided_by.name").alias("decided_by_name"),
        F.col("from_account.name").alias("from_name"), F.col("to_account.name").alias("to_name"),
        F.col("beneficiary.name").alias("beneficiary_name"), F.col("anomaly.score").alias("anomaly_score"),
        F.col("anomaly.reason").alias("anomaly_reason"),
        F.when(F.size("awaiting_approval_from") > 0, F.array_join("awaiting_approval_from", " or ")).alias("approvers"),
    )


@query("""SELECT payment_id, company_id, created_at, status, amount FROM payment_view WHERE status = 'AWAITING_APPROVAL'
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, payment_id DESC) <= 200""")
def payments_awaiting(L: Ledger) -> DataFrame:
    """Of every company, the 200 newest payments still awaiting approval: the read model's page."""
    waiting = payment_rows(L).where(F.col("status") == rm.AWAITING)
    found = rm.top_per_key(waiting, "company_id", [F.desc("created_at"), F.desc("payment_id")], 200)
    return found.select("payment_id", "company_id", "created_at", "status", "amount")


@query("""SELECT company_id, string_agg(display_name, ' or ' ORDER BY user_id) AS approvers FROM users
WHERE role = 'approver' GROUP BY company_id""")
def approver_lists(L: Ledger) -> DataFrame:
    names = F.transform("approvers", lambda a: a["name"])
    return rm.approvers(L.users).select("company_id", F.array_join(names, " or ").alias("approvers"))


@query("SELECT beneficiary_id, company_id, name, iban, category FROM beneficiaries")
def beneficiaries_list(L: Ledger) -> DataFrame:
    return rm.beneficiaries_of(L.beneficiaries, None)


@query("""SELECT company_id, forecast_date, predicted_balance, lower_bound, upper_bound, model_name FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY forecast_date) AS n FROM forecast) WHERE n <= 30""")
def forecast_points(L: Ledger) -> DataFrame:
    return rm.first_forecast_points(forecast_table(L)).select(
        "company_id", "forecast_date", "predicted_balance", "lower_bound", "upper_bound", "model_name"
    )


@query("""SELECT p.payment_id, p.company_id, a.score, a.reason, a.reason IS NOT NULL AS flagged FROM payments p
LEFT JOIN anomalies a ON a.payment_id = p.payment_id AND a.company_id = p.company_id""")
def payment_flagged(L: Ledger) -> DataFrame:
    return rm.payment_flagged(L.payments, L.anomalies)


@query("""SELECT model_name, model_version, CAST(days AS DOUBLE) AS days, CAST(postings AS DOUBLE) AS postings FROM models""")
def registered_models(L: Ledger) -> DataFrame:
    """Metrics are parsed from their JSON text."""
    shown = rm.models_view(models(L))
    return shown.select("model_name", "model_version", *[F.col("metrics")[m].alias(m) for m in ("days", "postings")])


@query("""SELECT model_name, CASE WHEN days >= 30 THEN 'retrained' ELSE model_version END AS model_version FROM models""")
def replaced_models(L: Ledger) -> DataFrame:
    """Models with a full month were retrained: their rows are replaced, the others stay."""
    stored = models(L)
    full = F.get_json_object("metrics", "$.days").cast("long") >= 30
    retrained = stored.where(full).withColumn("model_version", F.lit("retrained"))
    return replace_keys(stored, retrained, ["model_name"]).select("model_name", "model_version")


@query("""SELECT company_id, forecast_date, predicted_balance FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY predicted_balance, forecast_date) AS n FROM forecast) WHERE n = 1""")
def lowest_forecast_day(L: Ledger) -> DataFrame:
    return rm.lowest_forecast_day(forecast_table(L))


SHORT = """CASE WHEN {f} < 0 THEN '−' ELSE '' END || 'AED ' || CASE WHEN abs({f}) // 100 >= 1000000
  THEN regexp_replace(CAST(CAST((abs({f}) // 100 + 50000) // 100000 AS DECIMAL(18,1)) / 10 AS VARCHAR), '\\.0$', '') || 'm'
  WHEN abs({f}) // 100 >= 1000 THEN CAST((abs({f}) // 100 + 500) // 1000 AS VARCHAR) || 'k'
  ELSE CAST(abs({f}) // 100 AS VARCHAR) END"""


@query(f"""
SELECT company_id, forecast_date, predicted_balance, CAST(CASE WHEN p < w THEN predicted_balance - payroll_due_amount END AS DECIMAL(18,2))
    AS shortfall,
  strftime(forecast_date, '%a') || ': ' || {SHORT.format(f='p')}
    || CASE WHEN p < w THEN ' (' || {SHORT.format(f='(p - w)')} || ')' ELSE '' END AS label
FROM (SELECT f.company_id, f.forecast_date, f.predicted_balance, x.payroll_due_amount,
    CAST(f.predicted_balance * 100 AS BIGINT) AS p, CAST(x.payroll_due_amount * 100 AS BIGINT) AS w
  FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY predicted_balance, forecast_date) AS n FROM forecast) f
  LEFT JOIN position x ON x.company_id = f.company_id WHERE f.n = 1)""")
def lowest_day_labels(L: Ledger) -> DataFrame:
    return rm.lowest_day_label(forecast_table(L), position(L))


@query("""SELECT company_id, 'actual' AS series, as_of_date AS date, CAST(available + scheduled_out_7d AS DECIMAL(18,2)) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY as_of_date DESC) AS n FROM day_positions) WHERE n <= 10
UNION ALL SELECT company_id, 'forecast', forecast_date, predicted_balance FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY forecast_date) AS n FROM forecast) WHERE n <= 14""")
def liquidity_chart(L: Ledger) -> DataFrame:
    """Per company: the last 10 actual days and the first 14 forecast days."""
    return rm.liquidity_chart(rm.dashboard_trend(day_positions(L)), forecast_table(L), past=10, ahead=14)


@query("""SELECT u.user_id, u.username, u.display_name, u.title, u.role, u.email, u.company_id, c.name AS company_name
FROM users u JOIN companies c ON c.company_id = u.company_id""")
def user_profiles(L: Ledger) -> DataFrame:
    return rm.user_profiles(L.users, L.companies)


@query("SELECT user_id, lower(email) = lower(username || '@BANK.EXAMPLE') AS same FROM users")
def email_matches(L: Ledger) -> DataFrame:
    other = F.concat(F.col("username"), F.lit("@BANK.EXAMPLE"))
    return L.users.select("user_id", same_email(F.col("email"), other).alias("same"))


@query("""SELECT t.transaction_id, t.company_id, t.account_id, t.payment_id, t.amount,
  counterparty || ': ' || description AS line,
  coalesce(payment_id IN (SELECT payment_id FROM anomalies), false) AS flagged FROM postings t""")
def ledger_lines(L: Ledger) -> DataFrame:
    return rm.ledger_lines(L.postings, L.anomalies)


@query("SELECT company_id, account_id, reference_balance FROM accounts WHERE company_id IN (SELECT company_id FROM companies WHERE industry = 'MACHINERY')")
def scoped_accounts(L: Ledger) -> DataFrame:
    """Accounts visible to the principals of one industry's companies."""
    principals = L.users.join(L.companies.where(F.col("industry") == "MACHINERY"), "company_id", "left_semi")
    return quality.scope_by(L.accounts, principals).select("company_id", "account_id", "reference_balance")
