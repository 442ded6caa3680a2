"""Queries: flow history, forecast, back-test and historical positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import date_lit
from ..operators import forecast, gold_state, history
from ..operators.serving import account_totals
from .queries_gold import AS_OF, CTX, cash, flows
from .registry import query
from .views import HISTORY_DAYS, VIEWS, Ledger

FIRST = "DATE '2024-01-02'"

VIEWS["history"] = f"""
SELECT s.company_id, s.flow_date, CAST(isodow(s.flow_date) - 1 AS INTEGER) AS weekday,
  CAST(coalesce(other_net, 0) AS DECIMAL(18,2)) AS other_net, CAST(coalesce(supplier_net, 0) AS DECIMAL(18,2)) AS supplier_net,
  CAST(coalesce(payroll_net, 0) AS DECIMAL(18,2)) AS payroll_net, CAST(coalesce(transfer_net, 0) AS DECIMAL(18,2)) AS transfer_net
FROM (SELECT company_id, CAST(unnest(generate_series(CAST(MIN(flow_date) AS TIMESTAMP), TIMESTAMP '2024-01-30 00:00:00',
    INTERVAL 1 DAY)) AS DATE) AS flow_date
  FROM flows WHERE flow_date < {AS_OF} GROUP BY company_id) s
LEFT JOIN flows f ON f.company_id = s.company_id AND f.flow_date = s.flow_date"""

PROFILE = """
SELECT company_id, weekday, CAST(CAST(SUM(other_net) AS DOUBLE) / COUNT(*) AS DECIMAL(28,8)) AS other_mean,
  coalesce(stddev_samp(CAST(other_net AS DOUBLE)), 0) AS other_sd,
  CAST(CAST(SUM(supplier_net) AS DOUBLE) / COUNT(*) AS DECIMAL(28,8)) AS supplier_mean,
  coalesce(stddev_samp(CAST(supplier_net AS DOUBLE)), 0) AS supplier_sd, COUNT(*) AS days
FROM {source} GROUP BY company_id, weekday"""

VIEWS["profile"] = PROFILE.format(source="history")

VIEWS["balances"] = "SELECT company_id, CAST(SUM(balance) AS DECIMAL(18,2)) AS balance FROM cash WHERE account_kind <> 'reserve' GROUP BY company_id"

VIEWS["known_out"] = f"""
SELECT company_id, CASE WHEN kind = 'payroll' THEN 'payroll' ELSE 'supplier' END AS stream, due_date AS day,
  SUM(amount) AS amount
FROM scheduled WHERE due_date BETWEEN {AS_OF} AND {AS_OF} + 29 GROUP BY ALL"""

VIEWS["payroll_due"] = f"""
SELECT company_id, day, amount FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id, day ORDER BY rank, source) AS n FROM (
    SELECT company_id, day, 0 AS rank, day AS source, amount FROM known_out WHERE stream = 'payroll'
    UNION ALL SELECT company_id, day + 28 AS day, 1 AS rank, day AS source, amount FROM known_out
      WHERE stream = 'payroll' AND day + 28 <= {AS_OF} + 29)) WHERE n = 1"""

VIEWS["projected"] = f"""
SELECT company_id, day AS forecast_date, CAST(bal AS DECIMAL(18,2)) AS predicted_balance,
  CAST(bal - half AS DECIMAL(18,2)) AS lower_bound, CAST(bal + half AS DECIMAL(18,2)) AS upper_bound
FROM (
  SELECT company_id, day, CAST(balance + CAST(SUM(flow) OVER w AS DECIMAL(28,8)) AS DECIMAL(28,8)) AS bal,
    CAST(1.2815515655446004::DOUBLE * sqrt(SUM(variance) OVER w) AS DECIMAL(28,8)) AS half
  FROM (
    SELECT d.company_id, d.day, d.balance,
      CAST(coalesce(other_mean, 0) + CASE WHEN learned THEN coalesce(supplier_mean, 0) ELSE 0 END - coalesce(o.amount, 0)
        AS DECIMAL(28,8)) AS flow,
      coalesce(other_sd, 0) ** 2 + CASE WHEN learned THEN coalesce(supplier_sd, 0) ** 2 ELSE 0 END AS variance
    FROM (
      SELECT b.company_id, b.balance, CAST({AS_OF} + k AS DATE) AS day, u.until IS NULL OR {AS_OF} + k > u.until AS learned
      FROM balances b CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(30)) LEFT JOIN (
        SELECT company_id, MAX(day) AS until FROM known_out WHERE stream = 'supplier' GROUP BY company_id) u
        ON u.company_id = b.company_id) d
    LEFT JOIN profile p ON p.company_id = d.company_id AND p.weekday = isodow(d.day) - 1
    LEFT JOIN (SELECT company_id, day, SUM(amount) AS amount FROM (
        SELECT company_id, day, amount FROM known_out WHERE stream = 'supplier'
        UNION ALL SELECT company_id, day, amount FROM payroll_due) GROUP BY company_id, day) o
      ON o.company_id = d.company_id AND o.day = d.day)
  WINDOW w AS (PARTITION BY company_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

VIEWS["forecast"] = """SELECT *, 'cash_forecast' AS model_name, '1' AS model_version,
  TIMESTAMP '2024-01-31 06:00:00' AS generated_at FROM projected"""

VIEWS["opened"] = """
SELECT a.*, CAST(reference_balance - coalesce(net, 0) AS DECIMAL(18,2)) AS opening_balance
FROM accounts a LEFT JOIN (SELECT account_id, SUM(amount) AS net FROM postings GROUP BY account_id) p
  ON p.account_id = a.account_id"""

VIEWS["supplier_out"] = """
SELECT company_id, day, SUM(amount) AS amount FROM (
  SELECT company_id, value_date AS day, -amount AS amount FROM postings WHERE category = 'supplier'
  UNION ALL SELECT company_id, due_date AS day, amount FROM scheduled WHERE kind = 'supplier') GROUP BY company_id, day"""

VIEWS["payroll_out"] = """
SELECT company_id, day, SUM(amount) AS amount FROM (
  SELECT company_id, value_date AS day, -amount AS amount FROM postings WHERE category = 'payroll'
  UNION ALL SELECT company_id, due_date AS day, amount FROM scheduled WHERE kind = 'payroll') GROUP BY company_id, day"""

VIEWS["day_balances"] = f"""
SELECT company_id, as_of_date, open + coalesce(SUM(net) OVER w, 0) AS total_cash,
  open_res + coalesce(SUM(net_res) OVER w, 0) AS reserve_cash
FROM (
  SELECT o.company_id, o.open, o.open_res, d.day AS as_of_date, m.net, m.net_res
  FROM (SELECT company_id, SUM(opening_balance) AS open,
      SUM(CASE WHEN account_kind = 'reserve' THEN opening_balance ELSE 0 END) AS open_res FROM opened GROUP BY company_id) o
  CROSS JOIN (SELECT CAST({FIRST} + CAST(range AS INTEGER) AS DATE) AS day FROM range({HISTORY_DAYS})) d
  LEFT JOIN (SELECT p.company_id, greatest(value_date + 1, {FIRST}) AS day, SUM(amount) AS net,
      SUM(CASE WHEN account_kind = 'reserve' THEN amount ELSE 0 END) AS net_res
    FROM postings p JOIN accounts a ON a.account_id = p.account_id GROUP BY 1, 2) m
    ON m.company_id = o.company_id AND m.day = d.day)
WINDOW w AS (PARTITION BY company_id ORDER BY as_of_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

VIEWS["day_positions"] = """
SELECT b2.company_id, as_of_date, CAST(total_cash AS DECIMAL(18,2)) AS total_cash,
  CAST(total_cash - reserve_cash - sched AS DECIMAL(18,2)) AS available, CAST(sched AS DECIMAL(18,2)) AS scheduled_out_7d,
  p.day AS payroll_due_date, CAST(p.amount AS DECIMAL(18,2)) AS payroll_due_amount,
  CAST(total_cash - reserve_cash - sched - CASE WHEN p.day - as_of_date < 10 THEN p.amount ELSE 0 END AS DECIMAL(18,2))
    AS forecast_low
FROM (SELECT b.*, coalesce(s.sched, 0) AS sched FROM day_balances b LEFT JOIN (
    SELECT x.company_id, x.as_of_date, SUM(o.amount) AS sched FROM day_balances x JOIN supplier_out o
      ON o.company_id = x.company_id AND o.day BETWEEN x.as_of_date AND x.as_of_date + 6 GROUP BY 1, 2) s
    ON s.company_id = b.company_id AND s.as_of_date = b.as_of_date) b2
ASOF LEFT JOIN payroll_out p ON p.company_id = b2.company_id AND p.day >= b2.as_of_date"""


def flow_history(L: Ledger) -> DataFrame:
    return history.daily_flow_history(flows(L), CTX.as_of)


def profile(L: Ledger) -> DataFrame:
    return forecast.fit_profile(flow_history(L))


def balances(L: Ledger) -> DataFrame:
    return forecast.latest_non_reserve(cash(L))


def projected(L: Ledger) -> DataFrame:
    return forecast.project(profile(L), balances(L), L.scheduled, CTX.as_of)


def forecast_table(L: Ledger) -> DataFrame:
    return forecast.forecast_rows(projected(L), forecast.MODEL_NAME, "1", CTX.now_col)


def opened(L: Ledger) -> DataFrame:
    opening = history.opening_balances(L.accounts, L.postings)
    return L.accounts.join(opening, "account_id")


def day_positions(L: Ledger) -> DataFrame:
    return history.daily_positions(opened(L), L.postings, L.scheduled, date_lit("2024-01-02"), CTX.as_of)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


@query("SELECT * FROM history")
def daily_flow_history(L: Ledger) -> DataFrame:
    return flow_history(L)


@query("SELECT * EXCLUDE (other_sd, supplier_sd), round(other_sd, 4) AS other_sd, round(supplier_sd, 4) AS supplier_sd FROM profile")
def weekday_profile(L: Ledger) -> DataFrame:
    return _rounded(profile(L), "other_sd", "supplier_sd")


FEBRUARY = "DATE '2024-02-01'"
VIEWS["history_of_months"] = VIEWS["history"].replace("TIMESTAMP '2024-01-30 00:00:00'", "TIMESTAMP '2024-01-31 00:00:00'").replace(AS_OF, FEBRUARY)


@query(f"""SELECT * EXCLUDE (other_sd, supplier_sd), round(other_sd, 4) AS other_sd, round(supplier_sd, 4) AS supplier_sd
FROM ({PROFILE.format(source="history_of_months")})""")
def weekday_profile_of_months(L: Ledger) -> DataFrame:
    """The profile at the begin of a month, from the moments of whole months alone."""
    daily = flows(L)
    fitted = forecast.fit_from_moments(gold_state.flow_moments(daily), daily, date_lit("2024-02-01"))
    return _rounded(fitted, "other_sd", "supplier_sd")


@query(f"""SELECT company_id, CAST({AS_OF} + CAST(range AS INTEGER) AS DATE) AS day,
  CAST(isodow({AS_OF} + CAST(range AS INTEGER)) - 1 AS INTEGER) AS weekday FROM companies CROSS JOIN range(30)""")
def forecast_days(L: Ledger) -> DataFrame:
    return forecast.forecast_days(L.companies.select("company_id"), CTX.as_of)


@query(f"""SELECT d.company_id, d.day, d.weekday, coalesce(other_mean, 0) AS other_mean, coalesce(supplier_mean, 0) AS supplier_mean
FROM (SELECT company_id, CAST({AS_OF} + CAST(range AS INTEGER) AS DATE) AS day,
    CAST(isodow({AS_OF} + CAST(range AS INTEGER)) - 1 AS INTEGER) AS weekday FROM companies CROSS JOIN range(30)) d
LEFT JOIN profile p ON p.company_id = d.company_id AND p.weekday = d.weekday""")
def learned_flows(L: Ledger) -> DataFrame:
    """Weekday means looked up for every company and horizon day; companies without history get zeros."""
    days = forecast.forecast_days(L.companies.select("company_id"), CTX.as_of)
    return forecast.predict(profile(L), days).select("company_id", "day", "weekday", "other_mean", "supplier_mean")


@query("SELECT company_id, stream, day, CAST(amount AS DECIMAL(18,2)) AS amount FROM known_out")
def known_outflows(L: Ledger) -> DataFrame:
    return forecast.known_outflows(L.scheduled, CTX.as_of).withColumn("amount", F.col("amount").cast("decimal(18,2)"))


@query("SELECT company_id, day, CAST(amount AS DECIMAL(18,2)) AS amount FROM payroll_due")
def payroll_days(L: Ledger) -> DataFrame:
    found = forecast.payroll_days(forecast.known_outflows(L.scheduled, CTX.as_of), CTX.as_of)
    return found.withColumn("amount", F.col("amount").cast("decimal(18,2)"))


@query("SELECT * FROM balances")
def start_balances(L: Ledger) -> DataFrame:
    return balances(L)


@query("SELECT * FROM forecast")
def cash_forecast(L: Ledger) -> DataFrame:
    return forecast_table(L)


@query("SELECT company_id, round(avg(CAST(other_net + supplier_net AS DOUBLE)), 4) AS daily_mean FROM history GROUP BY company_id")
def company_daily_mean(L: Ledger) -> DataFrame:
    daily = (F.col("other_net") + F.col("supplier_net")).cast("double")
    return flow_history(L).groupBy("company_id").agg(F.round(F.avg(daily), 4).alias("daily_mean"))


def _backtest_sql(holdout: int) -> str:
    fit = PROFILE.format(source=f"(SELECT * FROM history WHERE flow_date < (SELECT MAX(flow_date) FROM history) - {holdout - 1})")
    return f"""
SELECT CAST({holdout} AS DOUBLE) AS holdout_days, round(avg(miss), 2) AS holdout_mae, round(avg(naive_miss), 2) AS naive_mae,
  round(1 - avg(miss) / avg(naive_miss), 4) AS mae_skill,
  round(avg(CASE WHEN miss <= 1.2815515655446004::DOUBLE * sd THEN 1.0 ELSE 0.0 END::DOUBLE), 4) AS band80_coverage,
  CAST((SELECT COUNT(DISTINCT company_id) FROM history) AS DOUBLE) AS companies,
  CAST((SELECT COUNT(*) FROM history) AS DOUBLE) AS training_days
FROM (
  SELECT abs(actual - CAST(coalesce(other_mean, 0) + coalesce(supplier_mean, 0) AS DOUBLE)) AS miss,
    abs(actual - coalesce(plain, 0)) AS naive_miss, sqrt(coalesce(other_sd, 0) ** 2 + coalesce(supplier_sd, 0) ** 2) AS sd
  FROM (SELECT company_id, weekday, CAST(other_net + supplier_net AS DOUBLE) AS actual FROM history
    WHERE flow_date >= (SELECT MAX(flow_date) FROM history) - {holdout - 1}) t
  LEFT JOIN ({fit}) p ON p.company_id = t.company_id AND p.weekday = t.weekday
  LEFT JOIN (SELECT company_id, avg(CAST(other_net + supplier_net AS DOUBLE)) AS plain FROM history
    WHERE flow_date < (SELECT MAX(flow_date) FROM history) - {holdout - 1} GROUP BY company_id) n ON n.company_id = t.company_id)"""


@query(_backtest_sql(7))
def forecast_backtest(L: Ledger) -> DataFrame:
    """The tables hold 30 days, so seven are held out here."""
    return forecast.backtest(flow_history(L), holdout_days=7)


@query(f"""SELECT coalesce(i.company_id, o.company_id) AS company_id, round(CAST(coalesce(received, 0) AS DOUBLE) / {HISTORY_DAYS}, 4)
    AS daily_receipts, round(CAST(coalesce(paid, 0) AS DOUBLE) / {HISTORY_DAYS}, 4) AS supplier_run_rate
FROM (SELECT company_id, SUM(amount) AS received FROM postings WHERE category = 'customer' GROUP BY company_id) i
FULL JOIN (SELECT company_id, SUM(amount) AS paid FROM supplier_out WHERE day < {AS_OF} GROUP BY company_id) o
  ON o.company_id = i.company_id""")
def run_rates(L: Ledger) -> DataFrame:
    out = history.outflow_days(L.postings, L.scheduled, "supplier")
    rates = forecast.run_rates(L.postings, out, CTX.as_of, HISTORY_DAYS)
    return rates.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("daily_receipts", "supplier_run_rate")})


VIEWS["next_pay"] = f"""SELECT company_id, min(day) AS payroll_date, arg_min(amount, day) AS payroll_amount
FROM payroll_out WHERE day >= {AS_OF} GROUP BY company_id"""


@query(f"""
SELECT company_id, day AS forecast_date, CAST(bal AS DECIMAL(18,2)) AS predicted_balance,
  CAST(bal - band AS DECIMAL(18,2)) AS lower_bound, CAST(bal + band AS DECIMAL(18,2)) AS upper_bound
FROM (
  SELECT *, CAST(abs(bal) * CAST(0.03 AS DECIMAL(4,3)) + k * CAST(0.004 AS DECIMAL(4,3)) * total_cash AS DECIMAL(28,8)) AS band
  FROM (
    SELECT company_id, day, k, total_cash, CAST(CAST(non_reserve AS DECIMAL(18,2)) + CAST(SUM(CAST(received - out - wages AS DECIMAL(28,8)))
      OVER (PARTITION BY company_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(28,8))
      AS DECIMAL(28,8)) AS bal
    FROM (
      SELECT b.company_id, d.k, d.day, CAST(b.total_cash AS DECIMAL(18,2)) AS total_cash, b.non_reserve,
        CASE WHEN d.k < 14 THEN CAST(coalesce(s.amount, 0) AS DECIMAL(28,8)) ELSE coalesce(r.run_rate, 0) END AS out,
        CAST(CASE WHEN d.day >= p.payroll_date AND (d.day - p.payroll_date) % 28 = 0 THEN p.payroll_amount ELSE 0 END
          AS DECIMAL(28,8)) AS wages,
        CAST(CASE WHEN d.k >= 7 AND isodow(d.day) <= 5 THEN coalesce(r.daily_in, 0) * 7 / 5 ELSE 0 END AS DECIMAL(28,8)) AS received
      FROM (SELECT company_id, SUM(balance) AS total_cash,
          SUM(CASE WHEN account_kind <> 'reserve' THEN balance ELSE 0 END) AS non_reserve FROM cash GROUP BY company_id) b
      CROSS JOIN (SELECT CAST(range AS INTEGER) AS k, CAST({AS_OF} + CAST(range AS INTEGER) AS DATE) AS day FROM range(30)) d
      LEFT JOIN next_pay p ON p.company_id = b.company_id
      LEFT JOIN supplier_out s ON s.company_id = b.company_id AND s.day = d.day
      LEFT JOIN (SELECT c.company_id, CAST(CAST(coalesce(received, 0) AS DOUBLE) / {HISTORY_DAYS} AS DECIMAL(28,8)) AS daily_in,
          CAST(CAST(coalesce(paid, 0) AS DOUBLE) / {HISTORY_DAYS} AS DECIMAL(28,8)) AS run_rate
        FROM companies c
        LEFT JOIN (SELECT company_id, SUM(amount) AS received FROM postings WHERE category = 'customer' GROUP BY company_id) i
          ON i.company_id = c.company_id
        LEFT JOIN (SELECT company_id, SUM(amount) AS paid FROM supplier_out WHERE day < {AS_OF} GROUP BY company_id) o
          ON o.company_id = c.company_id) r ON r.company_id = b.company_id)))""")
def baseline_forecast(L: Ledger) -> DataFrame:
    out = history.outflow_days(L.postings, L.scheduled, "supplier")
    pay = history.outflow_days(L.postings, L.scheduled, "payroll").where(F.col("day") >= CTX.as_of)
    next_pay = pay.groupBy("company_id").agg(F.min("day").alias("payroll_date"), F.min_by("amount", "day").alias("payroll_amount"))
    rates = forecast.run_rates(L.postings, out, CTX.as_of, HISTORY_DAYS)
    return forecast.baseline_forecast(account_totals(cash(L)), rates, out, next_pay, CTX.as_of)


@query("""SELECT company_id, as_of_date, CAST(total_cash AS DECIMAL(18,2)) AS total_cash,
  CAST(reserve_cash AS DECIMAL(18,2)) AS reserve_cash FROM day_balances""")
def start_of_day_balances(L: Ledger) -> DataFrame:
    found = history.start_of_day_balances(opened(L), L.postings, date_lit("2024-01-02"), CTX.as_of)
    return found.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("total_cash", "reserve_cash")})


@query("SELECT * FROM day_positions")
def daily_positions(L: Ledger) -> DataFrame:
    return day_positions(L)


@query(f"""SELECT d.company_id, d.day, CAST(coalesce(SUM(o.amount), 0) AS DECIMAL(18,2)) AS next_7_days
FROM (SELECT DISTINCT company_id, day FROM supplier_out) d JOIN supplier_out o
  ON o.company_id = d.company_id AND o.day BETWEEN d.day AND d.day + 6 GROUP BY 1, 2""")
def supplier_week_ahead(L: Ledger) -> DataFrame:
    """The forward 7-day range sum at every supplier outflow day."""
    out = history.outflow_days(L.postings, L.scheduled, "supplier")
    summed = history.forward_sum(out, "amount", 7, "next_7_days", "day")
    return summed.select("company_id", "day", F.col("next_7_days").cast("decimal(18,2)").alias("next_7_days"))


@query(f"""SELECT d.company_id, d.day AS as_of_date, p.day AS due_date, CAST(p.amount AS DECIMAL(18,2)) AS due_amount
FROM (SELECT company_id, CAST({AS_OF} + CAST(range AS INTEGER) AS DATE) AS day FROM companies CROSS JOIN range(30)) d
ASOF LEFT JOIN payroll_out p ON p.company_id = d.company_id AND p.day >= d.day""")
def next_payroll(L: Ledger) -> DataFrame:
    """For every company and horizon day, the first payroll on or after it."""
    days = forecast.forecast_days(L.companies.select("company_id"), CTX.as_of).select("company_id", F.col("day").alias("as_of_date"))
    found = history.next_event(days, history.outflow_days(L.postings, L.scheduled, "payroll"))
    return found.withColumn("due_amount", F.col("due_amount").cast("decimal(18,2)"))


@query(f"""SELECT DISTINCT company_id, day FROM (
  SELECT company_id, value_date AS day FROM postings WHERE category = 'payroll'
  UNION ALL SELECT company_id, payroll_date AS day FROM next_pay)""")
def payroll_dates(L: Ledger) -> DataFrame:
    """Past payroll dates and the next one, as a set."""
    past = L.postings.where(F.col("category") == "payroll").select("company_id", F.col("value_date").alias("day"))
    pay = history.outflow_days(L.postings, L.scheduled, "payroll").where(F.col("day") >= CTX.as_of)
    return past.unionByName(pay.groupBy("company_id").agg(F.min("day").alias("day"))).distinct()


@query("SELECT transaction_id, account_id, amount, balance_after FROM transactions")
def running_balance(L: Ledger) -> DataFrame:
    return L.transactions.select("transaction_id", "account_id", "amount", "balance_after")


@query("SELECT account_id, opening_balance FROM opened")
def opening_balances(L: Ledger) -> DataFrame:
    return history.opening_balances(L.accounts, L.postings)


@query("""SELECT p.transaction_id, CAST(coalesce(o.opening_balance, 0) + SUM(p.amount) OVER (PARTITION BY p.account_id
  ORDER BY p.transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance_after
FROM postings p LEFT JOIN opened o ON o.account_id = p.account_id""")
def ledger_balances(L: Ledger) -> DataFrame:
    """Running balances from the opening balance that ends at the account's present one."""
    opening = history.opening_balances(L.accounts, L.postings)
    return history.running_balance(L.postings, opening).select("transaction_id", "balance_after")


@query("SELECT account_id, MIN(balance_after) AS lowest_balance FROM transactions GROUP BY account_id")
def lowest_balances(L: Ledger) -> DataFrame:
    return history.lowest_running_balance(L.transactions)
