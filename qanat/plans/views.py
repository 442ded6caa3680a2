"""The ledger as deterministic views over the driver's tables.

customer -> companies (with three users, four accounts and nine payees each), events -> postings and
payments, orders -> scheduled payments. Every view covers its whole table. `VIEWS` holds the same
definitions in SQL, for the checks.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import RunContext
from ..functions.money import MONEY, score4
from ..functions.text import iban
from ..functions.times import gulf_date
from ..operators.history import running_balance
from ..operators.ledger_calendar import account_roster
from ..operators.posting import decided_events, raw_lines
from ..operators.skew import running, union_all

AS_OF = date(2024, 1, 31)
NOW = datetime(2024, 1, 31, 6, 0)
RUN = "run-1"
HISTORY_DAYS = 30
LIVE_FROM, UNSENT_FROM = "2024-01-15 00:00:00", "2024-01-25 00:00:00"


def context(run_id: str = RUN) -> RunContext:
    return RunContext(run_id, NOW, AS_OF)


class Ledger:
    """The ledger of one data folder; the frames are lazy and built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    @cached_property
    def companies(self) -> DataFrame:
        nation = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("emirate"))
        return self.raw("customer").join(nation, "c_nationkey").select(
            (F.col("c_custkey") + 1).cast("int").alias("company_id"),
            F.col("c_name").alias("name"),
            "emirate",
            F.col("c_mktsegment").alias("industry"),
        )

    @cached_property
    def users(self) -> DataFrame:
        roles = F.array(
            *[
                F.struct(F.lit(n).alias("no"), F.lit(role).alias("role"), F.lit(title).alias("title"))
                for n, role, title in ((1, "initiator", "Treasury analyst"), (2, "approver", "CFO"), (3, "approver", "Treasurer"))
            ]
        )
        each = self.raw("customer").select((F.col("c_custkey") + 1).cast("int").alias("company_id"), F.inline(roles))
        user_id = ((F.col("company_id") - 1) * 3 + F.col("no")).cast("int")
        username = F.concat(F.lit("user"), user_id.cast("string"))
        return each.select(
            user_id.alias("user_id"),
            "company_id",
            username.alias("username"),
            F.concat(F.lit("User "), user_id.cast("string")).alias("display_name"),
            "title",
            "role",
            F.concat(F.lit("User"), user_id.cast("string"), F.lit("@Bank.example")).alias("email"),
        )

    @cached_property
    def accounts(self) -> DataFrame:
        """The roster with reference balances; company wealth times 100, 40, 10 and 5."""
        weight = F.when(F.col("account_kind") == "operating", 100).when(F.col("account_kind") == "reserve", 40)
        weight = weight.when(F.col("account_kind") == "payroll", 10).otherwise(5)
        company = (F.col("c_custkey") + 1).cast("int").alias("company_id")
        owners = self.raw("customer").select(company, F.col("c_acctbal").cast(MONEY).alias("_wealth"))
        return account_roster(owners, "_wealth").select(
            "account_id", "company_id", "account_kind", "name", "iban",
            (F.col("_wealth") * weight).cast(MONEY).alias("reference_balance"),
        )

    @cached_property
    def beneficiaries(self) -> DataFrame:
        each = self.raw("customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("k"))
        number = F.col("c_custkey") * 10 + F.col("k")
        return each.select(
            number.cast("int").alias("beneficiary_id"),
            (F.col("c_custkey") + 1).cast("int").alias("company_id"),
            F.concat(F.lit("Supplier "), F.reverse(number.cast("string"))).alias("name"),
            iban((F.col("c_custkey") + 1).cast("int"), F.col("k") + 2000, F.col("k")).alias("iban"),
            F.lit("supplier").alias("category"),
        )

    @cached_property
    def postings(self) -> DataFrame:
        """Ledger postings without balances."""
        e, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id")
        sign = F.when(kind == "click", 3).when((kind == "view") & (e % 2 == 0), 1).otherwise(-1)
        category = (
            F.when(kind == "click", "customer").when(kind == "view", "transfer").when(kind == "purchase", "supplier")
            .when(kind == "signup", "payroll").otherwise("fee")
        )
        # Every tenth fee sits on a suspense account the roster does not know.
        account = F.when((kind == "error") & (e % 10 == 0), -(user + 1)).otherwise(user * 4 + e % 4 + 1)
        payment = F.when(kind.isin("purchase", "signup"), e).when(kind == "error", e - 1)
        return self.raw("events").select(
            e.alias("transaction_id"),
            (user + 1).cast("int").alias("company_id"),
            account.cast("int").alias("account_id"),
            payment.alias("payment_id"),
            (sign * F.col("value").cast(MONEY)).cast(MONEY).alias("amount"),
            category.alias("category"),
            F.concat(F.lit("Party "), (user * 10 + e % 10).cast("string")).alias("counterparty"),
            F.concat(kind, F.lit(" "), e.cast("string")).alias("description"),
            F.col("ts").alias("booked_at"),
            gulf_date(F.col("ts")).alias("value_date"),
        )

    @cached_property
    def transactions(self) -> DataFrame:
        """Postings with their running balances."""
        return running_balance(self.postings)

    @cached_property
    def silver_transactions(self) -> DataFrame:
        return self.transactions.withColumn("event_id", F.col("transaction_id"))

    @cached_property
    def silver_postings(self) -> DataFrame:
        return self.postings.withColumn("event_id", F.col("transaction_id"))

    @cached_property
    def payments(self) -> DataFrame:
        e, user, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
        own = e % 10 == 0
        status = F.when(e % 11 == 3, "AWAITING_APPROVAL").when(e % 11 == 5, "REJECTED").otherwise("EXECUTED")

        def person(step: int) -> Column:
            return (user * 3 + (e + step) % 3 + 1).cast("int")

        decided, executed = status != "AWAITING_APPROVAL", status == "EXECUTED"
        return self.raw("events").where(F.col("event_type").isin("purchase", "signup")).select(
            e.alias("payment_id"),
            (user + 1).cast("int").alias("company_id"),
            (user * 4 + 1).cast("int").alias("from_account_id"),
            F.when(own, user * 4 + F.floor(e / 10) % 4 + 1).cast("int").alias("to_account_id"),
            F.when(~own, user * 10 + e % 10).cast("int").alias("beneficiary_id"),
            (F.ceil(F.col("value") / 25) * 25).cast(MONEY).alias("amount"),
            F.lit("AED").alias("currency"),
            gulf_date(ts).alias("value_date"),
            F.when(e % 7 != 0, F.concat(F.lit("INV-"), e.cast("string"))).alias("reference"),
            status.alias("status"),
            person(0).alias("created_by"),
            ts.alias("created_at"),
            F.when(decided, person(1)).alias("decided_by"),
            F.when(decided, ts + F.expr("INTERVAL 30 MINUTES")).alias("decided_at"),
            F.when(executed, ts + F.expr("INTERVAL 35 MINUTES")).alias("executed_at"),
        )

    @cached_property
    def silver_payments(self) -> DataFrame:
        """Payments as silver holds them: with their payee's name and an event id."""
        payee = F.concat(F.lit("Supplier "), F.reverse(F.col("beneficiary_id").cast("string")))
        return self.payments.withColumn("beneficiary_name", payee).withColumn("event_id", F.col("payment_id"))

    @cached_property
    def scheduled(self) -> DataFrame:
        key = F.col("o_orderkey")
        kind = F.when(F.col("o_orderpriority") == "1-URGENT", "payroll").when(F.col("o_orderpriority") == "5-LOW", "tax")
        return self.raw("orders").select(
            (F.col("o_custkey") + 1).cast("int").alias("company_id"),
            kind.otherwise("supplier").alias("kind"),
            (F.col("o_totalprice").cast(MONEY) / 100).cast(MONEY).alias("amount"),
            F.date_add(F.lit(AS_OF), (key % 40).cast("int") - 3).alias("due_date"),
        )

    @cached_property
    def outbox(self) -> DataFrame:
        """Events of all decided payments and of their postings; those of the last days are not published yet."""
        rows = decided_events(
            self.silver_payments.drop("event_id"), self.transactions,
            F.col("payment_id") * 10 + 1, F.col("transaction_id") * 10 + 2,
        )
        sent = F.col("created_at") < F.lit(UNSENT_FROM).cast("timestamp_ntz")
        return rows.withColumn("published_at", F.when(sent, F.col("created_at") + F.expr("INTERVAL 2 SECONDS")))

    @cached_property
    def live_outbox(self) -> DataFrame:
        """The outbox as if it had been switched on in mid-month; older history has no events."""
        return self.outbox.where(F.col("created_at") >= F.lit(LIVE_FROM).cast("timestamp_ntz"))

    @cached_property
    def raw_events(self) -> DataFrame:
        """Every event delivered twice, blank lines, and chat texts as lines that are no events."""
        turns = self.raw("conversations")
        copies = [F.struct("body", F.lit(name).alias("source")) for name in ("file-1", "file-0")]
        lines = raw_lines(self.outbox, F.lit("")).select(F.inline(F.array(*copies)))
        blank = turns.select(F.lit("   ").alias("body"), F.lit("file-2").alias("source"))
        noise = turns.select(F.col("text").alias("body"), F.lit("file-2").alias("source"))
        return union_all([lines, blank, noise])

    @cached_property
    def anomalies(self) -> DataFrame:
        """Flags on large executed payments, as the scoring job would have published them."""
        amount, at = F.col("amount"), F.col("executed_at")
        return self.silver_payments.where((F.col("status") == "EXECUTED") & (amount >= 125)).select(
            (F.col("payment_id") + 1).alias("id"),
            "company_id",
            "payment_id",
            F.col("payment_id").alias("transaction_id"),
            at.alias("occurred_at"),
            F.coalesce("beneficiary_name", F.lit("Own account transfer")).alias("counterparty"),
            "amount",
            score4(amount.cast("double") / 400.0).alias("score"),
            F.concat(F.lit("Unusual: payment of "), amount.cast("string")).alias("reason"),
            (at + F.expr("INTERVAL 15 MINUTES")).alias("detected_at"),
            F.lit("payment_anomaly").alias("model_name"),
            F.when(at < F.lit(LIVE_FROM).cast("timestamp_ntz"), "1").otherwise("2").alias("model_version"),
        )

    @cached_property
    def trace(self) -> DataFrame:
        """Stages reached by executed payments; the last days have not reached serving."""
        done = self.payments.where(F.col("status") == "EXECUTED")
        at, late = F.col("executed_at"), F.col("executed_at") >= F.lit(UNSENT_FROM).cast("timestamp_ntz")

        def stage(name: str, delay: str, when: Column | None = None) -> Column:
            mark = F.struct(F.lit(name).alias("stage"), (at + F.expr(f"INTERVAL {delay}")).alias("at"))
            return mark if when is None else F.when(when, mark)

        stages = F.array(stage("serving", "7 MINUTES", ~late), stage("event_hubs", "2 SECONDS"), stage("bronze", "5 MINUTES"))
        return done.select("payment_id", F.inline(F.array_compact(stages)))

    @cached_property
    def runs(self) -> DataFrame:
        """One pipeline run per business day."""
        finished = F.max("booked_at") + F.expr("INTERVAL 1 MINUTES")
        return self.postings.groupBy(F.col("value_date").cast("string").alias("run_id")).agg(
            finished.alias("finished_at"), (finished + F.expr("INTERVAL 5 MINUTES")).alias("next_batch_at")
        )

    @cached_property
    def requests(self) -> DataFrame:
        """Each payment's creator asks for that payment and for the one with the next id."""
        who = F.col("created_by")
        return self.payments.select(
            who.alias("user_id"),
            F.concat(F.lit("user"), who.cast("string")).alias("username"),
            "company_id",
            F.explode(F.array("payment_id", F.col("payment_id") + 1)).alias("target_id"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        """Two decisions on each payment, in close succession, by two of the company's users."""
        p, base = F.col("payment_id"), (F.col("company_id") - 1) * 3
        asked = F.col("created_at")

        def decision(n: int, user: Column, verb: Column, minutes: Column) -> Column:
            at = asked + F.make_dt_interval(mins=minutes.cast("int"))
            return F.struct(
                (p * 2 + n).alias("decision_id"), user.cast("int").alias("user_id"), verb.alias("verb"), at.alias("decided_at")
            )

        verb = F.when(p % 2 == 0, "reject").otherwise("approve")
        both = F.array(
            decision(0, base + 2, F.lit("approve"), F.lit(10)), decision(1, base + p % 3 + 1, verb, p % 3 + 9)
        )
        return self.payments.select("payment_id", F.inline(both))

    @cached_property
    def counters(self) -> DataFrame:
        """A request counter per (region, workload) that starts over every 5,000 events."""
        e = F.col("event_id")
        base = self.raw("events").select(
            "event_id", "ts", (F.col("user_id") % 2).cast("string").alias("region"), F.col("event_type").alias("workload"),
            F.floor(e / 5_000).alias("_epoch"),
        )
        done = running(base, ["region", "workload", "_epoch"], ["event_id"], {"value": F.lit(1)}, inclusive=True)
        return done.select("ts", "region", "workload", F.col("value").cast("double").alias("value"))

    def table(self, name: str) -> DataFrame:
        """The ledger protocol of the batch plans."""
        return {"scheduled_payments": lambda: self.scheduled}.get(name, lambda: getattr(self, name))()


# The same views in SQL. Each entry may use the driver's tables and the entries before it.
VIEWS = {
    "companies": """
SELECT CAST(c_custkey + 1 AS INTEGER) AS company_id, c_name AS name, n_name AS emirate, c_mktsegment AS industry
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "users": """
SELECT CAST(c_custkey * 3 + r.no AS INTEGER) AS user_id, CAST(c_custkey + 1 AS INTEGER) AS company_id,
  'user' || CAST(c_custkey * 3 + r.no AS VARCHAR) AS username,
  'User ' || CAST(c_custkey * 3 + r.no AS VARCHAR) AS display_name, r.title AS title, r.role AS role,
  'User' || CAST(c_custkey * 3 + r.no AS VARCHAR) || '@Bank.example' AS email
FROM customer, (VALUES (1, 'initiator', 'Treasury analyst'), (2, 'approver', 'CFO'), (3, 'approver', 'Treasurer'))
  AS r(no, role, title)""",
    "accounts": """
SELECT CAST(c_custkey * 4 + k.no AS INTEGER) AS account_id, CAST(c_custkey + 1 AS INTEGER) AS company_id, k.kind AS account_kind, k.label AS name,
  printf('AE07 0331 0000 %04d %04d 00%d', c_custkey + 1, 1000 + (c_custkey + 1) * 10 + k.no, k.no) AS iban,
  CAST(CAST(c_acctbal AS DECIMAL(18,2)) * k.weight AS DECIMAL(18,2)) AS reference_balance
FROM customer, (VALUES (1, 'operating', 'Operating', 100), (2, 'reserve', 'Reserve', 40), (3, 'payroll', 'Payroll', 10),
  (4, 'collections', 'Collections', 5)) AS k(no, kind, label, weight)""",
    "beneficiaries": """
SELECT CAST(c_custkey * 10 + k AS INTEGER) AS beneficiary_id, CAST(c_custkey + 1 AS INTEGER) AS company_id,
  'Supplier ' || reverse(CAST(c_custkey * 10 + k AS VARCHAR)) AS name,
  printf('AE07 0331 0000 %04d %04d 00%d', c_custkey + 1, k + 2000, k) AS iban, 'supplier' AS category
FROM customer, range(1, 10) AS t(k)""",
    "postings": """
SELECT event_id AS transaction_id, CAST(user_id + 1 AS INTEGER) AS company_id,
  CAST(CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN -(user_id + 1) ELSE user_id * 4 + event_id % 4 + 1 END
    AS INTEGER) AS account_id,
  CASE WHEN event_type IN ('purchase', 'signup') THEN event_id WHEN event_type = 'error' THEN event_id - 1 END AS payment_id,
  CAST(CASE WHEN event_type = 'click' THEN 3 WHEN event_type = 'view' AND event_id % 2 = 0 THEN 1 ELSE -1 END
    * CAST(value AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS amount,
  CASE event_type WHEN 'click' THEN 'customer' WHEN 'view' THEN 'transfer' WHEN 'purchase' THEN 'supplier'
    WHEN 'signup' THEN 'payroll' ELSE 'fee' END AS category,
  'Party ' || CAST(user_id * 10 + event_id % 10 AS VARCHAR) AS counterparty,
  event_type || ' ' || CAST(event_id AS VARCHAR) AS description,
  ts AS booked_at, CAST(ts + INTERVAL 4 HOURS AS DATE) AS value_date
FROM events""",
    "transactions": """
SELECT *, CAST(SUM(amount) OVER (PARTITION BY account_id ORDER BY transaction_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance_after
FROM postings""",
    "payments": """
SELECT event_id AS payment_id, CAST(user_id + 1 AS INTEGER) AS company_id, CAST(user_id * 4 + 1 AS INTEGER) AS from_account_id,
  CASE WHEN event_id % 10 = 0 THEN CAST(user_id * 4 + (event_id // 10) % 4 + 1 AS INTEGER) END AS to_account_id,
  CASE WHEN event_id % 10 <> 0 THEN CAST(user_id * 10 + event_id % 10 AS INTEGER) END AS beneficiary_id,
  CAST(ceil(value / 25) * 25 AS DECIMAL(18,2)) AS amount, 'AED' AS currency,
  CAST(ts + INTERVAL 4 HOURS AS DATE) AS value_date,
  CASE WHEN event_id % 7 <> 0 THEN 'INV-' || CAST(event_id AS VARCHAR) END AS reference,
  CASE event_id % 11 WHEN 3 THEN 'AWAITING_APPROVAL' WHEN 5 THEN 'REJECTED' ELSE 'EXECUTED' END AS status,
  CAST(user_id * 3 + event_id % 3 + 1 AS INTEGER) AS created_by, ts AS created_at,
  CASE WHEN event_id % 11 <> 3 THEN CAST(user_id * 3 + (event_id + 1) % 3 + 1 AS INTEGER) END AS decided_by,
  CASE WHEN event_id % 11 <> 3 THEN ts + INTERVAL 30 MINUTES END AS decided_at,
  CASE WHEN event_id % 11 NOT IN (3, 5) THEN ts + INTERVAL 35 MINUTES END AS executed_at,
  CASE WHEN event_id % 10 <> 0 THEN 'Supplier ' || reverse(CAST(user_id * 10 + event_id % 10 AS VARCHAR)) END
    AS beneficiary_name
FROM events WHERE event_type IN ('purchase', 'signup')""",
    "scheduled": """
SELECT CAST(o_custkey + 1 AS INTEGER) AS company_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'payroll' WHEN '5-LOW' THEN 'tax' ELSE 'supplier' END AS kind,
  CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(22,4)) * 0.01 AS DECIMAL(18,2)) AS amount,
  CAST(DATE '2024-01-31' + CAST(o_orderkey % 40 - 3 AS INTEGER) AS DATE) AS due_date
FROM orders""",
    "counters": """
SELECT ts, CAST(user_id % 2 AS VARCHAR) AS region, event_type AS workload,
  CAST(COUNT(*) OVER (PARTITION BY user_id % 2, event_type, event_id // 5000 ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value
FROM events""",
    "outbox": """
SELECT payment_id * 10 + 1 AS id, company_id, 'payment' AS aggregate_type, CAST(payment_id AS VARCHAR) AS aggregate_id,
  'payment.executed' AS event_type, executed_at AS created_at, payment_id FROM payments WHERE status = 'EXECUTED'
UNION ALL SELECT payment_id * 10 + 1, company_id, 'payment', CAST(payment_id AS VARCHAR), 'payment.rejected', decided_at,
  payment_id FROM payments WHERE status = 'REJECTED'
UNION ALL SELECT transaction_id * 10 + 2, company_id, 'transaction', CAST(transaction_id AS VARCHAR), 'transaction.posted',
  booked_at, payment_id FROM postings
  WHERE payment_id IN (SELECT payment_id FROM payments WHERE status = 'EXECUTED')""",
    "live_outbox": "SELECT * FROM outbox WHERE created_at >= TIMESTAMP '2024-01-15 00:00:00'",
    "anomalies": """
SELECT payment_id + 1 AS id, company_id, payment_id, payment_id AS transaction_id, executed_at AS occurred_at,
  coalesce(beneficiary_name, 'Own account transfer') AS counterparty, amount,
  CAST(least(CAST(amount AS DOUBLE) / 400.0, 1.0) AS DECIMAL(6,4)) AS score,
  'Unusual: payment of ' || CAST(amount AS VARCHAR) AS reason, executed_at + INTERVAL 15 MINUTES AS detected_at,
  'payment_anomaly' AS model_name, CASE WHEN executed_at < TIMESTAMP '2024-01-15 00:00:00' THEN '1' ELSE '2' END AS model_version
FROM payments WHERE status = 'EXECUTED' AND amount >= 125""",
    "trace": """
SELECT payment_id, 'event_hubs' AS stage, executed_at + INTERVAL 2 SECONDS AS at FROM payments WHERE status = 'EXECUTED'
UNION ALL SELECT payment_id, 'bronze', executed_at + INTERVAL 5 MINUTES FROM payments WHERE status = 'EXECUTED'
UNION ALL SELECT payment_id, 'serving', executed_at + INTERVAL 7 MINUTES FROM payments
  WHERE status = 'EXECUTED' AND executed_at < TIMESTAMP '2024-01-25 00:00:00'""",
    "runs": """
SELECT CAST(value_date AS VARCHAR) AS run_id, MAX(booked_at) + INTERVAL 1 MINUTE AS finished_at,
  MAX(booked_at) + INTERVAL 6 MINUTES AS next_batch_at FROM postings GROUP BY value_date""",
    "requests": """
SELECT created_by AS user_id, 'user' || CAST(created_by AS VARCHAR) AS username, company_id, payment_id + k AS target_id
FROM payments, (VALUES (0), (1)) AS t(k)""",
    "decisions": """
SELECT payment_id, payment_id * 2 AS decision_id, CAST((company_id - 1) * 3 + 2 AS INTEGER) AS user_id, 'approve' AS verb,
  created_at + INTERVAL 10 MINUTES AS decided_at FROM payments
UNION ALL SELECT payment_id, payment_id * 2 + 1, CAST((company_id - 1) * 3 + payment_id % 3 + 1 AS INTEGER),
  CASE WHEN payment_id % 2 = 0 THEN 'reject' ELSE 'approve' END,
  created_at + to_minutes(CAST(payment_id % 3 + 9 AS INTEGER)) FROM payments""",
}
