"""A small literal ledger: company 1 on Monday 2026-10-05, and helpers to write its events."""

from __future__ import annotations

import json
import os
from datetime import date, datetime, timedelta
from decimal import Decimal

from qanat.context import Settings
from qanat.plans.batch import Job
from qanat.sources.lake import Lake
from qanat.sources.ledger import FrameLedger

AS_OF = date(2026, 10, 5)
NOW = datetime(2026, 10, 5, 6, 0)
BALANCES = {"operating": "2860000", "reserve": "2240000", "payroll": "150000", "collections": "550000"}
PAYMENT = (
    "payment_id long, company_id int, from_account_id int, to_account_id int, beneficiary_id int, amount decimal(18,2), "
    "currency string, value_date date, reference string, status string, created_by int, created_at timestamp_ntz, "
    "decided_by int, decided_at timestamp_ntz, executed_at timestamp_ntz"
)
POSTING = (
    "transaction_id long, company_id int, account_id int, payment_id long, amount decimal(18,2), balance_after decimal(18,2), "
    "category string, counterparty string, booked_at timestamp_ntz"
)
OUTBOX = "id long, aggregate_type string, aggregate_id string"


def money(text) -> Decimal:
    return Decimal(str(text)).quantize(Decimal("0.01"))


def history(days: int = 60):
    """Payments and postings of company 1: a supplier payment each weekday, customer receipts each day, and
    three planted oddities (a spike, a duplicate, a night-time first payment on a Saturday)."""
    pays, posts = [], []
    balance = {1: money(9_000_000), 2: money(2_240_000), 3: money(150_000), 4: money(550_000)}
    pid = tid = 0

    def post(account, amount, category, party, at, payment=None):
        nonlocal tid
        tid += 1
        balance[account] += money(amount)
        posts.append((tid, 1, account, payment, money(amount), balance[account], category, party, at))

    def pay(beneficiary, amount, at):
        nonlocal pid
        pid += 1
        day = (at + timedelta(hours=4)).date()
        pays.append((pid, 1, 1, None, beneficiary, money(amount), "AED", day, f"INV-{pid}", "EXECUTED", 1, at - timedelta(hours=2),
                     2, at - timedelta(minutes=5), at))
        post(1, -amount, "supplier", f"Supplier {beneficiary}", at, pid)

    start = AS_OF - timedelta(days=days)
    for i in range(days):
        day = datetime.combine(start + timedelta(days=i), datetime.min.time())
        post(4, 40_000 + 500 * (i % 7), "customer", "Customer", day + timedelta(hours=6))
        if day.weekday() < 5:
            for k in range(6):
                pay(1 + (i + k) % 8, 20_000 + 250 * ((3 * i + 5 * k) % 9), day + timedelta(hours=5 + k, minutes=(7 * i + k) % 60))
    saturday = datetime(2026, 10, 2, 22, 0)  # 02:00 on Saturday in the Gulf
    pay(1, 85_000, datetime(2026, 9, 30, 7, 0))
    pay(2, 21_750, datetime(2026, 10, 1, 7, 0))
    pay(2, 21_750, datetime(2026, 10, 1, 9, 30))
    pay(99, 22_000, saturday)
    # The ledger's balances are what the history ends at; the golden figures are set by the caller.
    return pays, posts, balance


def ledger(spark, balances=None, payments=(), postings=(), outbox=()):
    balances = balances or {n: money(v) for n, v in enumerate(BALANCES.values(), start=1)}
    kinds = list(BALANCES)
    return FrameLedger(
        accounts=spark.createDataFrame(
            [(n, 1, kinds[n - 1], v) for n, v in balances.items()],
            "account_id int, company_id int, account_kind string, reference_balance decimal(18,2)",
        ),
        scheduled_payments=spark.createDataFrame(
            [
                (1, "supplier", money("980000"), AS_OF),
                (1, "supplier", money("800000"), AS_OF + timedelta(days=6)),
                (1, "supplier", money("55000"), AS_OF + timedelta(days=7)),
                (1, "payroll", money("1900000"), date(2026, 10, 8)),
            ],
            "company_id int, kind string, amount decimal(18,2), due_date date",
        ),
        beneficiaries=spark.createDataFrame([(b, 1, f"Supplier {b}") for b in (*range(1, 9), 99)], "beneficiary_id int, company_id int, name string"),
        payments=spark.createDataFrame(list(payments), PAYMENT),
        transactions=spark.createDataFrame(list(postings), POSTING),
        outbox=spark.createDataFrame(list(outbox), OUTBOX),
    )


def job(spark, root, ledger_, **settings) -> Job:
    s = Settings(lake_root=f"{root}/lake", landing_dir=f"{root}/landing", as_of=AS_OF, **settings)
    return Job(Lake(spark, s.lake_root), ledger_, s)


def transfer_lines(payment_id=9001, amount="450000.00", first_id=1, first_tx=5001) -> list[str]:
    """An executed transfer from Reserve to Operating: one payment event, two postings."""
    at = "2026-10-05T05:30:00"

    def line(id_, kind, aggregate, event_type, payload):
        return json.dumps({"id": id_, "company_id": 1, "aggregate_type": kind, "aggregate_id": str(aggregate), "event_type": event_type,
                           "payload": json.dumps(payload), "created_at": at}, sort_keys=True)

    def leg(id_, account, signed, after):
        return {"id": id_, "company_id": 1, "account_id": account, "payment_id": payment_id, "amount": signed, "balance_after": after,
                "category": "transfer", "counterparty": "Own account", "booked_at": at}

    payment = {"id": payment_id, "status": "EXECUTED", "amount": amount, "currency": "AED", "value_date": "2026-10-05", "reference": None,
               "from_account": {"id": 2}, "to_account": {"id": 1}, "beneficiary": None, "created_by": {"id": 1}, "created_at": at,
               "decided_by": {"id": 2}, "decided_at": at, "executed_at": at}
    operating = f"{Decimal(BALANCES['operating']) + Decimal(amount):.2f}"
    reserve = f"{Decimal(BALANCES['reserve']) - Decimal(amount):.2f}"
    return [
        line(first_id, "payment", payment_id, "payment.executed", {"payment": payment, "transaction_ids": [first_tx, first_tx + 1]}),
        line(first_id + 1, "transaction", first_tx, "transaction.posted", leg(first_tx, 2, f"-{amount}", reserve)),
        line(first_id + 2, "transaction", first_tx + 1, "transaction.posted", leg(first_tx + 1, 1, amount, operating)),
    ]


def land(job_: Job, name: str, lines: list[str]) -> None:
    os.makedirs(job_.settings.landing_dir, exist_ok=True)
    tmp = f"{job_.settings.landing_dir}/.{name}.tmp"
    with open(tmp, "w") as f:
        f.write("\n".join(lines) + "\n")
    os.replace(tmp, f"{job_.settings.landing_dir}/{name}.jsonl")
