"""Queries: event text to bronze and silver, the outbox, tracing and backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_at, seed_event_id, sorted_json
from ..functions.times import iso_ts, next_batch_at
from ..operators import posting, silver, upserts
from ..operators.skew import numbered
from ..sources.ledger import scoring_state as state_of
from .queries_forecast import forecast_table
from .queries_gold import CTX, LINEAGE
from .registry import query
from .views import Ledger

RUN_2 = "TIMESTAMP '2024-01-29 00:00:00'"


def bronze(L: Ledger) -> DataFrame:
    return silver.to_bronze(L.raw_events, CTX)


def events(L: Ledger) -> DataFrame:
    return silver.latest_bronze(bronze(L))


def since(column: str, text: str):
    return F.col(column) >= F.lit(text).cast("timestamp_ntz")


@query(f"""
SELECT id AS event_id, company_id, event_type, aggregate_type, aggregate_id, source, {LINEAGE} AS ingested_at
FROM outbox, (VALUES ('file-0'), ('file-1')) AS f(source)
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'file-2', {LINEAGE} FROM conversations WHERE length(trim(text)) > 0""")
def bronze_events(L: Ledger) -> DataFrame:
    """Blank lines are dropped, lines that are no events stay with NULL fields."""
    return bronze(L).drop("body")


@query("SELECT id AS event_id, company_id, event_type, aggregate_type, aggregate_id, 'file-0' AS source, created_at AS event_created_at FROM outbox")
def latest_bronze(L: Ledger) -> DataFrame:
    """Of two deliveries ingested together, the smaller source name wins."""
    return events(L).drop("payload")


@query(f"""
SELECT o.id AS event_id, t.transaction_id, t.company_id, t.account_id, t.payment_id, t.amount, t.balance_after, t.category,
  t.counterparty, t.booked_at, t.value_date, o.created_at AS event_created_at, {LINEAGE} AS processed_at
FROM outbox o JOIN transactions t ON o.event_type = 'transaction.posted' AND t.transaction_id = CAST(o.aggregate_id AS BIGINT)""")
def silver_transactions(L: Ledger) -> DataFrame:
    return silver.transactions(events(L), CTX)


@query(f"""
SELECT o.id AS event_id, p.payment_id, p.company_id, o.event_type, p.status, p.amount, p.currency, p.value_date, p.reference,
  p.from_account_id, p.to_account_id, p.beneficiary_id, p.beneficiary_name, p.created_by, p.decided_by, p.created_at,
  p.decided_at, p.executed_at, o.created_at AS event_created_at, {LINEAGE} AS processed_at
FROM outbox o JOIN payments p ON o.aggregate_type = 'payment' AND p.payment_id = o.payment_id""")
def silver_payments(L: Ledger) -> DataFrame:
    return silver.payments(events(L), CTX)


@query(f"""SELECT payment_id, company_id FROM postings WHERE booked_at >= {RUN_2}
UNION ALL SELECT payment_id, company_id FROM payments WHERE created_at >= {RUN_2}""")
def moved_rows(L: Ledger) -> DataFrame:
    """Rows two silver tables gained in one run."""
    def tagged(df: DataFrame, at: str) -> DataFrame:
        return df.withColumn("run_id", F.when(since(at, "2024-01-29 00:00:00"), "run-2").otherwise("run-1"))

    return silver.rows_of_run([tagged(L.postings, "booked_at"), tagged(L.payments, "created_at")], "run-2")


@query(f"SELECT DISTINCT company_id FROM postings WHERE booked_at >= {RUN_2}")
def moved_companies(L: Ledger) -> DataFrame:
    return L.postings.where(since("booked_at", "2024-01-29 00:00:00")).select("company_id").distinct()


@query("SELECT id, payment_id FROM outbox WHERE payment_id IS NOT NULL")
def event_payment_ids(L: Ledger) -> DataFrame:
    return posting.event_payment_ids(L.outbox)


@query("""SELECT DISTINCT payment_id, 'bronze' AS stage, TIMESTAMP '2024-01-31 06:00:00' AS at FROM outbox
WHERE payment_id IS NOT NULL""")
def bronze_trace(L: Ledger) -> DataFrame:
    return silver.trace_rows(silver.traced_payments(bronze(L)), "bronze", CTX)


@query("""SELECT event_type, CAST(SUM(k) AS BIGINT) AS k_sum, COUNT(*) AS n FROM (
  SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""")
def props_by_type(L: Ledger) -> DataFrame:
    k = json_at(F.col("props"), "$.k").try_cast("long")
    return L.raw("events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count(F.lit(1)).alias("n"))


@query("""SELECT transaction_id, '{"account_id":' || CAST(account_id AS VARCHAR) || ',"amount":"' || CAST(amount AS VARCHAR)
  || '","category":"' || category || '","payment_id":' || coalesce(CAST(payment_id AS VARCHAR), 'null') || '}' AS body FROM postings""")
def posting_json(L: Ledger) -> DataFrame:
    """JSON with sorted keys, money as fixed-point text and explicit nulls."""
    body = sorted_json(
        payment_id=F.col("payment_id"), amount=F.col("amount").cast("string"), account_id=F.col("account_id"), category=F.col("category")
    )
    return L.postings.select("transaction_id", body.alias("body"))


@query("""SELECT id, CAST(company_id AS BIGINT) AS company_id, aggregate_type, aggregate_id, event_type, created_at FROM outbox""")
def decided_events(L: Ledger) -> DataFrame:
    """One event per executed or rejected payment and per posting of an executed one."""
    return L.outbox.select("id", "company_id", "aggregate_type", "aggregate_id", "event_type", "created_at")


@query("SELECT id, event_type FROM outbox WHERE created_at >= TIMESTAMP '2024-01-25 00:00:00' ORDER BY id LIMIT 100")
def outbox_batch(L: Ledger) -> DataFrame:
    """The relay's next batch: the first 100 unpublished rows."""
    return posting.unpublished(L.outbox, 100).select("id", "event_type")


@query("""SELECT payment_id, company_id, amount, beneficiary_name FROM payments WHERE status = 'EXECUTED'
AND CAST(payment_id AS VARCHAR) NOT IN (SELECT aggregate_id FROM live_outbox WHERE aggregate_type = 'payment')""")
def backfill_payments(L: Ledger) -> DataFrame:
    found = posting.backfill_payments(L.payments, L.beneficiaries, L.live_outbox)
    return found.select("payment_id", "company_id", "amount", "beneficiary_name")


@query("""SELECT transaction_id, company_id, amount FROM postings
WHERE CAST(transaction_id AS VARCHAR) NOT IN (SELECT aggregate_id FROM live_outbox WHERE aggregate_type = 'transaction')""")
def backfill_transactions(L: Ledger) -> DataFrame:
    rest = posting.not_in_outbox(L.postings, L.live_outbox, "transaction", "transaction_id")
    return rest.select("transaction_id", "company_id", "amount")


def seeds(L: Ledger) -> DataFrame:
    pays = posting.backfill_payments(L.payments, L.beneficiaries, L.live_outbox)
    posts = posting.not_in_outbox(L.transactions, L.live_outbox, "transaction", "transaction_id")
    return posting.seed_events(pays, posts)


SEEDS_SQL = """
SELECT -(1000000000000 + payment_id) AS event_id, 'seed-payments-' || CAST(payment_id AS VARCHAR) AS source, company_id,
  'payment.executed' AS event_type, CAST(amount AS VARCHAR) AS amount, executed_at AS created_at
FROM payments WHERE status = 'EXECUTED'
  AND CAST(payment_id AS VARCHAR) NOT IN (SELECT aggregate_id FROM live_outbox WHERE aggregate_type = 'payment')
UNION ALL SELECT -(2000000000000 + transaction_id), 'seed-transactions-' || CAST(transaction_id AS VARCHAR), company_id,
  'transaction.posted', CAST(amount AS VARCHAR), booked_at
FROM postings WHERE CAST(transaction_id AS VARCHAR) NOT IN
  (SELECT aggregate_id FROM live_outbox WHERE aggregate_type = 'transaction')"""


def _seed_fields(seed_bronze: DataFrame) -> DataFrame:
    payload = json_at(F.col("body"), "$.payload")
    amount = F.coalesce(json_at(payload, "$.payment.amount"), json_at(payload, "$.amount"))
    created = json_at(F.col("body"), "$.created_at").try_cast("timestamp").cast("timestamp_ntz")
    return seed_bronze.select("event_id", "source", "company_id", "event_type", amount.alias("amount"), created.alias("created_at"))


@query(SEEDS_SQL)
def seed_events(L: Ledger) -> DataFrame:
    """Ledger history as events with negative ids, read back from their text."""
    return _seed_fields(silver.to_bronze(seeds(L), CTX))


@query(f"SELECT * FROM ({SEEDS_SQL}) WHERE created_at >= TIMESTAMP '2024-01-08 00:00:00'")
def seed_events_missing(L: Ledger) -> DataFrame:
    """Seeds bronze does not hold, when an earlier run stored those of the first week."""
    all_seeds = silver.to_bronze(seeds(L), CTX)
    early = F.col("created_at") < F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")
    stored = _seed_fields(all_seeds).where(early)
    return _seed_fields(posting.not_in_bronze(all_seeds, stored))


@query("""SELECT id AS event_id, payment_id FROM outbox WHERE aggregate_type = 'transaction'
AND id NOT IN (SELECT id FROM live_outbox)""")
def merge_insert(L: Ledger) -> DataFrame:
    """Rows to insert into a table that already holds the newer half; redelivered copies count once."""
    rows = posting.event_payment_ids(L.outbox.where(F.col("aggregate_type") == "transaction")).withColumnRenamed("id", "event_id")
    held = L.live_outbox.select(F.col("id").alias("event_id"))
    return upserts.insert_new(held, rows.unionByName(rows), ["event_id"])


@query("""SELECT payment_id, 'silver' AS stage, TIMESTAMP '2024-01-31 06:00:00' AS at FROM payments
UNION ALL SELECT payment_id, 'bronze', TIMESTAMP '2024-01-31 06:00:00' FROM payments WHERE status <> 'EXECUTED'""")
def trace_inserts(L: Ledger) -> DataFrame:
    """Trace rows to add: executed payments have a bronze row already, and the first one stays."""
    new = silver.trace_rows(L.payments, "silver", CTX).unionByName(silver.trace_rows(L.payments, "bronze", CTX))
    return posting.first_trace(L.trace, new.unionByName(new))


@query("""SELECT model_name, model_version, MIN(forecast_date) AS first_date FROM forecast GROUP BY 1, 2
UNION ALL SELECT DISTINCT model_name, model_version, CAST(NULL AS DATE) FROM anomalies""")
def scoring_state(L: Ledger) -> DataFrame:
    return state_of(forecast_table(L), L.anomalies)


@query(f"""SELECT run_id, COUNT(*) AS events_new, COUNT(DISTINCT company_id) AS companies FROM (
  SELECT CASE WHEN booked_at >= {RUN_2} THEN 'run-2' ELSE 'run-1' END AS run_id, company_id FROM postings) GROUP BY run_id""")
def run_counts(L: Ledger) -> DataFrame:
    tagged = L.postings.select(F.when(since("booked_at", "2024-01-29 00:00:00"), "run-2").otherwise("run-1").alias("run_id"), "company_id")
    per_company = tagged.groupBy("run_id", "company_id").agg(F.count(F.lit(1)).alias("n"))
    return per_company.groupBy("run_id").agg(F.sum("n").alias("events_new"), F.count(F.lit(1)).alias("companies"))


@query("""SELECT run_id, finished_at, greatest(finished_at - INTERVAL 400 SECONDS + INTERVAL 300 SECONDS, finished_at) AS next_batch_at,
  greatest(finished_at - INTERVAL 100 SECONDS + INTERVAL 300 SECONDS, finished_at) AS next_after_short FROM runs""")
def next_batches(L: Ledger) -> DataFrame:
    end = F.col("finished_at")
    return L.runs.select(
        "run_id",
        "finished_at",
        next_batch_at(end - F.expr("INTERVAL 400 SECONDS"), end, 300).alias("next_batch_at"),
        next_batch_at(end - F.expr("INTERVAL 100 SECONDS"), end, 300).alias("next_after_short"),
    )


@query("""SELECT payment_id, row_number() OVER (ORDER BY created_at, company_id, payment_id) AS id FROM payments""")
def payment_numbers(L: Ledger) -> DataFrame:
    """Sequential ids in creation order, numbered without one global sort task."""
    return numbered(L.payments, ["created_at", "company_id", "payment_id"]).select("payment_id", "id")


@query("""SELECT -(2000000000000 + transaction_id) AS event_id, strftime(booked_at, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN microsecond(booked_at) % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST(microsecond(booked_at) % 1000000 AS VARCHAR), 6, '0') END
  AS booked_text FROM postings""")
def seed_ids(L: Ledger) -> DataFrame:
    return L.postings.select(
        seed_event_id("transactions", F.col("transaction_id")).alias("event_id"), iso_ts(F.col("booked_at")).alias("booked_text")
    )


