"""What gold keeps between batches, and how a batch's new silver rows are merged into it.

Five state tables, each in fixed buckets by a hash of its company (of its account for balances), so that a batch reads and
writes the buckets that it touches and no history beside them:

- balances   the latest balance of every account
- day_sums   per company, account and value date the sums of postings by flow bucket, and their number
- payments   one row per executed payment: the event with the smallest id
- debits     the first debit posting of every payment
- flow_moments  sums and sums of squares of the daily flows by company, month and weekday, for training

Balances, payments and debits merge by taking the better of two rows; moments of touched buckets are summed anew from
their daily flows. Day sums are additive: a posting that several events
carry counts once, by its smallest event, so the new rows' postings are looked up among the older ones and a posting that
was counted by a later event is taken out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..functions.times import weekday
from .dedupe import earliest_per_key
from .gold import BUCKETS, bucket_code

SUM = "decimal(28,2)"
SQUARES = "decimal(38,4)"
STREAMS = ("other_net", "supplier_net")  # the flows that the forecast learns
NETS = tuple(f"{b}_net" for b in BUCKETS)
PAYMENT_COLUMNS = (
    "event_id", "payment_id", "company_id", "from_account_id", "to_account_id", "beneficiary_id", "beneficiary_name",
    "amount", "value_date", "executed_at",
)
SCHEMAS = {
    "balances": "account_id int, transaction_id long, balance_after decimal(18,2), booked_at timestamp_ntz",
    "day_sums": "company_id int, account_id int, flow_date date, " + ", ".join(f"{n} {SUM}" for n in NETS) + ", postings long",
    "payments": "event_id long, payment_id long, company_id int, from_account_id int, to_account_id int, beneficiary_id int, "
    "beneficiary_name string, amount decimal(18,2), value_date date, executed_at timestamp_ntz",
    "debits": "payment_id long, company_id int, transaction_id long",
    "flow_moments": "company_id int, month date, weekday int, first_day date, "
    + ", ".join(f"{c}_sum {SUM}, {c}_squares {SQUARES}" for c in STREAMS),
}
KEYS = {"balances": "account_id", "day_sums": "company_id", "payments": "company_id", "debits": "company_id", "flow_moments": "company_id"}


def bucket(key: str, buckets: int) -> Column:
    """The bucket of a row; rows without a key share one."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def balances(old: DataFrame, transactions: DataFrame) -> DataFrame:
    rest = ("transaction_id", "balance_after", "booked_at")
    both = old.unionByName(transactions.select("account_id", *rest))
    newest = both.groupBy("account_id").agg(F.max_by(F.struct(*rest), "transaction_id").alias("_row"))
    return newest.select("account_id", *[F.col("_row")[c].alias(c) for c in rest])


def payments(old: DataFrame, events: DataFrame) -> DataFrame:
    executed = events.where(F.col("status") == "EXECUTED").select(*PAYMENT_COLUMNS)
    return earliest_per_key(old.unionByName(executed), "payment_id", ["event_id"]).select(*PAYMENT_COLUMNS)


def debits(old: DataFrame, transactions: DataFrame) -> DataFrame:
    legs = transactions.where(F.col("payment_id").isNotNull() & (F.col("amount") < 0)).select("payment_id", "company_id", "transaction_id")
    return old.unionByName(legs).groupBy("payment_id", "company_id").agg(F.min("transaction_id").alias("transaction_id"))


def posting_changes(new: DataFrame, older: DataFrame) -> DataFrame:
    """(company_id, account_id, flow_date, amount, bucket, sign): what the new rows change in the sums.

    older: at least the older rows of the new rows' postings."""
    row = F.struct(
        "event_id", "company_id", "account_id", F.col("value_date").alias("flow_date"), "amount", bucket_code(F.col("category")).alias("bucket")
    )
    ids = new.select("transaction_id").distinct()
    known = older.join(ids, "transaction_id", "left_semi").select("transaction_id", row.alias("_r"), F.lit(True).alias("_old"))
    both = known.unionByName(new.select("transaction_id", row.alias("_r"), F.lit(False).alias("_old")))
    event = F.col("_r.event_id")
    winners = both.groupBy("transaction_id").agg(
        F.min_by("_r", event).alias("now"), F.min_by("_r", F.when(F.col("_old"), event)).alias("before")
    )
    moved = winners.where(F.col("before").isNull() | (F.col("now.event_id") != F.col("before.event_id")))
    signed = F.array(F.struct(F.lit(1).alias("sign"), F.col("now").alias("r")), F.struct(F.lit(-1).alias("sign"), F.col("before").alias("r")))
    rows = moved.select(F.inline(signed)).where(F.col("r").isNotNull())
    return rows.select("sign", *[F.col("r")[c].alias(c) for c in ("company_id", "account_id", "flow_date", "amount", "bucket")])


def day_sums(old: DataFrame, changes: DataFrame) -> DataFrame:
    value = F.col("amount") * F.col("sign")
    nets = [F.when(F.col("bucket") == i, value).otherwise(0).cast(SUM).alias(n) for i, n in enumerate(NETS)]
    added = changes.select("company_id", "account_id", "flow_date", *nets, F.col("sign").cast("long").alias("postings"))
    totals = [F.sum(n).cast(SUM).alias(n) for n in NETS]
    summed = old.unionByName(added).groupBy("company_id", "account_id", "flow_date").agg(*totals, F.sum("postings").alias("postings"))
    return summed.where(F.col("postings") != 0)


def flows(sums: DataFrame, accounts: DataFrame, run_id: Column, at: Column) -> DataFrame:
    """Net flow per company and day of the non-Reserve accounts, from the day sums."""
    kinds = accounts.where(F.col("account_kind") != "reserve").select("account_id")
    total = sum((F.col(n) for n in NETS[1:]), F.col(NETS[0]))
    return (
        sums.join(kinds, "account_id")
        .groupBy("company_id", "flow_date")
        .agg(*[F.sum(n).cast(MONEY).alias(n) for n in NETS], F.sum(total).cast(MONEY).alias("total_net"))
        .withColumn("run_id", run_id)
        .withColumn("computed_at", at)
    )


def flow_moments(daily: DataFrame) -> DataFrame:
    """Exact sums of the learned flows and of their squares per company, month and weekday, and the first day with a flow."""
    sums = [
        total
        for c in STREAMS
        for total in (F.sum(c).cast(SUM).alias(f"{c}_sum"), F.sum(F.col(c) * F.col(c)).cast(SQUARES).alias(f"{c}_squares"))
    ]
    dated = daily.where(F.col("flow_date").isNotNull())
    by = ("company_id", F.trunc("flow_date", "MM").alias("month"), weekday(F.col("flow_date")).alias("weekday"))
    return dated.groupBy(*by).agg(F.min("flow_date").alias("first_day"), *sums)
