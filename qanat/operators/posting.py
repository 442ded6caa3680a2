"""Double-entry postings of executed payments, and the events that announce them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY, money_text
from ..functions.text import payment_id, seed_event_id, seed_key, sorted_json
from ..functions.times import iso_date, iso_ts
from .skew import spread_join, union_all

ENVELOPE_FIELDS = ("id", "company_id", "aggregate_type", "aggregate_id", "event_type", "payload", "created_at")


def posting_legs(payments: DataFrame, accounts: DataFrame, beneficiaries: DataFrame) -> DataFrame:
    """Ledger legs of executed payments: debit and credit of a transfer, one debit to a supplier.

    leg 1 is the debit of the from-account, leg 2 the credit of the to-account.
    """
    places = accounts.select("account_id", F.concat_ws(" ", "name", "iban").alias("_place"))
    done = payments.where(F.col("status") == "EXECUTED")
    done = spread_join(done, places.toDF("from_account_id", "_from"), ["from_account_id"], "payment_id")
    done = spread_join(done, places.toDF("to_account_id", "_to"), ["to_account_id"], "payment_id")
    payees = beneficiaries.select("beneficiary_id", F.col("name").alias("_payee"))
    done = spread_join(done, payees, ["beneficiary_id"], "payment_id")
    internal = F.col("to_account_id").isNotNull()
    category = F.when(internal, "transfer").otherwise("supplier")

    def leg(n: int, account: str, amount: Column, counterparty: Column) -> Column:
        return F.struct(
            F.lit(n).alias("leg"),
            F.col(account).alias("account_id"),
            amount.cast(MONEY).alias("amount"),
            category.alias("category"),
            counterparty.alias("counterparty"),
        )

    debit = leg(1, "from_account_id", -F.col("amount"), F.when(internal, F.col("_to")).otherwise(F.col("_payee")))
    credit = leg(2, "to_account_id", F.col("amount"), F.col("_from"))
    legs = F.array_compact(F.array(debit, F.when(internal, credit)))
    text = F.coalesce("reference", F.concat(F.lit("Payment "), F.col("payment_id").cast("string")))
    return done.select(
        "payment_id", "company_id", F.col("executed_at").alias("booked_at"), text.alias("description"), F.inline(legs)
    )


def _payment_payload(extra: dict[str, Column], with_names: bool) -> Column:
    """The payment object of an event, fields in alphabetical order."""
    def party(column: str, name: str, named: bool = with_names) -> Column:
        known = F.struct(F.col(column).alias("id"), *([F.col(name).alias("name")] if named else []))
        return F.when(F.col(column).isNotNull(), known)

    fields = {
        "amount": money_text(F.col("amount")),
        "beneficiary": party("beneficiary_id", "beneficiary_name", True),
        "created_at": iso_ts(F.col("created_at")),
        "created_by": party("created_by", "created_by_name"),
        "currency": F.col("currency"),
        "decided_at": iso_ts(F.col("decided_at")),
        "decided_by": party("decided_by", "decided_by_name"),
        "executed_at": iso_ts(F.col("executed_at")),
        "from_account": party("from_account_id", "from_account_name"),
        "id": F.col("payment_id"),
        "reference": F.col("reference"),
        "status": F.col("status"),
        "to_account": party("to_account_id", "to_account_name"),
        "value_date": iso_date(F.col("value_date")),
    }
    payment = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return sorted_json(payment=payment, **extra)


def _posting_payload(extra: dict[str, Column]) -> Column:
    return sorted_json(
        id=F.col("transaction_id"),
        company_id=F.col("company_id"),
        account_id=F.col("account_id"),
        payment_id=F.col("payment_id"),
        amount=money_text(F.col("amount")),
        balance_after=money_text(F.col("balance_after")),
        category=F.col("category"),
        counterparty=F.col("counterparty"),
        booked_at=iso_ts(F.col("booked_at")),
        **extra,
    )


def _envelope(df: DataFrame, id_: Column, kind: str, row_id: str, event_type: Column, payload: Column, at: str) -> DataFrame:
    return df.select(
        id_.cast("long").alias("id"),
        F.col("company_id").cast("long").alias("company_id"),
        F.lit(kind).alias("aggregate_type"),
        F.col(row_id).cast("string").alias("aggregate_id"),
        event_type.alias("event_type"),
        payload.alias("payload"),
        F.col(at).alias("created_at"),
    )


def decided_events(payments: DataFrame, transactions: DataFrame, event_id: Column, posting_event_id: Column) -> DataFrame:
    """Outbox rows: payment.executed and one transaction.posted per posting of an executed payment,
    payment.rejected for a refused one, nothing for one still waiting."""
    legs = transactions.where(F.col("payment_id").isNotNull()).groupBy("payment_id").agg(
        F.sort_array(F.collect_list("transaction_id")).alias("_ids")
    )  # a payment has two legs at most
    done = payments.where(F.col("status") == "EXECUTED").join(legs, "payment_id", "left")
    refused = payments.where(F.col("status") == "REJECTED")
    ids = {"transaction_ids": F.coalesce("_ids", F.array().cast("array<bigint>"))}
    # as many rows as payments: never a table of the driver's, however small Spark's estimate
    posted = transactions.join(done.select("payment_id").hint("merge"), "payment_id", "left_semi")
    return union_all(
        [
            _envelope(done, event_id, "payment", "payment_id", F.lit("payment.executed"),
                      _payment_payload(ids, False), "executed_at"),
            _envelope(refused, event_id, "payment", "payment_id", F.lit("payment.rejected"),
                      _payment_payload({}, False), "decided_at"),
            _envelope(posted, posting_event_id, "transaction", "transaction_id", F.lit("transaction.posted"),
                      _posting_payload({}), "booked_at"),
        ]
    )


def raw_lines(outbox: DataFrame, source: Column) -> DataFrame:
    """Outbox rows as the text lines a relay writes: (body, source)."""
    fields = {c: (iso_ts(F.col(c)) if c == "created_at" else F.col(c)) for c in ENVELOPE_FIELDS}
    return outbox.select(sorted_json(**fields).alias("body"), source.alias("source"))


def not_in_outbox(rows: DataFrame, outbox: DataFrame, kind: str, id_column: str) -> DataFrame:
    """Ledger rows no outbox event covers."""
    covered = outbox.where(F.col("aggregate_type") == kind).select(F.col("aggregate_id").alias("_id"))
    return rows.join(covered, F.col(id_column).cast("string") == F.col("_id"), "left_anti")


def backfill_payments(payments: DataFrame, beneficiaries: DataFrame, outbox: DataFrame) -> DataFrame:
    """Executed payments without an event, with the payee's name."""
    rest = not_in_outbox(payments.where(F.col("status") == "EXECUTED"), outbox, "payment", "payment_id")
    payees = beneficiaries.select("beneficiary_id", F.col("name").alias("beneficiary_name"))
    return spread_join(rest, payees, ["beneficiary_id"], "payment_id")


def seed_events(payments: DataFrame, transactions: DataFrame) -> DataFrame:
    """The same events for ledger history that predates the outbox, with negative ids: (body, source)."""
    mark = {"backfill": F.lit(True)}
    pays = _envelope(payments, seed_event_id("payments", F.col("payment_id")), "payment", "payment_id",
                     F.lit("payment.executed"), _payment_payload(mark, False), "executed_at")
    posts = _envelope(transactions, seed_event_id("transactions", F.col("transaction_id")), "transaction",
                      "transaction_id", F.lit("transaction.posted"), _posting_payload(mark), "booked_at")
    return raw_lines(pays, seed_key("payments", F.col("aggregate_id"))).unionByName(
        raw_lines(posts, seed_key("transactions", F.col("aggregate_id")))
    )


def not_in_bronze(seed_bronze: DataFrame, bronze: DataFrame | None) -> DataFrame:
    """Seed events bronze does not hold; only its negative ids are read."""
    if bronze is None:
        return seed_bronze
    return seed_bronze.join(bronze.where(F.col("event_id") < 0).select("event_id"), "event_id", "left_anti")


def unpublished(outbox: DataFrame, limit: int | None = 100) -> DataFrame:
    """The next outbox rows in id order (a relay's batch), or all of them."""
    waiting = outbox.where(F.col("published_at").isNull()).orderBy("id")
    return waiting if limit is None else waiting.limit(limit)


def event_payment_ids(outbox: DataFrame) -> DataFrame:
    """(id, payment_id) of every event that belongs to a payment."""
    pid = payment_id(F.col("aggregate_type"), F.col("aggregate_id"), F.col("payload"))
    return outbox.select("id", pid.alias("payment_id")).where(F.col("payment_id").isNotNull())


def first_trace(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Trace rows to add: one per (payment, stage), none that exist already."""
    once = new.groupBy("payment_id", "stage").agg(F.min("at").alias("at"))
    if existing is None:
        return once
    return once.join(existing.select("payment_id", "stage"), ["payment_id", "stage"], "left_anti")

