"""One batch: bronze -> silver -> gold -> scores -> serving.

Each stage remembers the last ingest batch it finished. What a stage has to do is every silver row of a
later batch, so a run that dies half-way is picked up by the next one, whichever stage it died in.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..context import RunContext, Settings, clock
from ..functions.times import ts_lit
from ..operators import gold as g
from ..operators import gold_state as state
from ..operators import posting, serving, silver
from ..sources.commits import Conflict
from ..sources.events import read_stream
from ..sources.lake import BATCH, BUCKET, Lake
from ..sources.ledger import reference_accounts, scheduled_payments
from ..sources.settle import settle
from ..streaming.ingest import drain, new_events
from . import scoring

log = logging.getLogger("qanat")

SEED_BATCH = -10  # ingest batches of ledger history lie below every stream batch
TABLES = ("transactions", "payments")
ATTEMPTS = 5  # of a gold merge that another writer overtakes


@dataclass
class Job:
    """A lake, a ledger and the settings they run under."""

    lake: Lake
    ledger: object
    settings: Settings

    @property
    def spark(self):
        return self.lake.spark


def _trace(job: Job, ids: DataFrame, stage: str, ctx: RunContext) -> None:
    job.lake.insert_absent(silver.trace_rows(ids, stage, ctx), "ops", "pipeline_trace", ["payment_id", "stage"])


def moved(job: Job, stage: str) -> DataFrame:
    """(payment_id, company_id) of the silver rows a stage has not handled; only their partitions are read."""
    after = job.lake.progress(stage)
    frames = [job.lake.read_or_empty("silver", t).where(F.col(BATCH) > after) for t in TABLES]
    return frames[0].select("payment_id", "company_id").unionByName(frames[1].select("payment_id", "company_id"))


def run_bronze(job: Job, ctx: RunContext) -> int:
    """Drain the source; trace `bronze`. Returns the last batch in bronze."""
    before = job.lake.progress("bronze")
    if job.settings.source == "files":
        job.lake.files.make_dir(job.settings.landing_dir)
    last = drain(job.lake, read_stream(job.spark, job.settings), ctx)
    if last > before:
        _trace(job, silver.traced_payments(new_events(job.lake, before)), "bronze", ctx)
    return last


def _merge_silver(job: Job, bronze: DataFrame, ctx: RunContext, batch: int) -> None:
    events = settle(silver.latest_bronze(bronze))
    for table, build in zip(TABLES, (silver.transactions, silver.payments)):
        job.lake.merge_insert(build(events, ctx), "silver", table, "event_id", batch, keys_in=events)


def run_silver(job: Job, ctx: RunContext) -> bool:
    """Merge the bronze batches silver has not seen; trace `silver`. True when there were any."""
    done, last = job.lake.progress("silver"), job.lake.progress("bronze")
    if last <= done:
        return False
    _merge_silver(job, new_events(job.lake, done), ctx, last)
    _trace(job, moved(job, "silver"), "silver", ctx)
    job.lake.advance("silver", last)
    return True


def _distinct(keys: DataFrame, number) -> list[int]:
    """Bucket numbers of keys: as many as a table has buckets at most."""
    return sorted(r[0] for r in keys.select(number.alias("n")).distinct().collect())


def run_gold(job: Job, ctx: RunContext, force: bool = False) -> bool:
    """Merge new silver rows into gold's state and recompute the companies that moved; trace `gold`.

    Only buckets of the state with a company or account that moved are read and written. The first run, a forced one and
    one after the loss of a table build the state anew from silver. A merge that another writer overtakes is done again
    on that writer's state."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return _run_gold(job, ctx, force)
        except Conflict:
            if attempt == ATTEMPTS:
                raise
            log.info("gold was published by another writer; merging again")


def _run_gold(job: Job, ctx: RunContext, force: bool) -> bool:
    lake, target = job.lake, job.lake.progress("silver")
    ids = moved(job, "gold")
    fresh = not ids.isEmpty()
    state_before = lake.manifest()
    through = state_before["through"]
    built = {"transactions": (("gold", "daily_flows"), ("state", "flow_moments")), "payments": (("gold", "payment_features"),)}
    missing = through is None or not lake.exists("gold", "cash_position_daily") or any(
        lake.exists("silver", source) and not lake.exists(*table) for source, tables in built.items() for table in tables
    )
    if not (fresh or missing or force):
        lake.advance("gold", target)
        return False
    rebuild = missing or force
    if rebuild or through < target:
        _merge_gold(job, ctx, None if rebuild else through, target, state_before["generation"])
    if fresh:
        _trace(job, ids, "gold", ctx)
    lake.advance("gold", target)
    return True


def _merge_gold(job: Job, ctx: RunContext, through: int | None, target: int, since: int) -> None:
    """State and gold of generation `since` with the silver rows of batches after `through`, or of all (None)."""
    lake, generation = job.lake, job.lake.next_generation()
    accounts = reference_accounts(job.ledger)
    tx, pay = (lake.read_or_empty("silver", t) for t in TABLES)
    if through is None:
        new_tx, new_pay, older = tx, pay, tx.limit(0)
    else:
        new_tx, new_pay = (t.where(F.col(BATCH) > through) for t in (tx, pay))
        older = tx.limit(0)
        if lake.exists("silver", "transactions"):
            older = lake.holding("silver", "transactions", "transaction_id", new_tx).where(F.col(BATCH) <= through)
    changes = settle(state.posting_changes(new_tx, older))
    companies = settle(
        new_tx.select("company_id").union(new_pay.select("company_id")).union(changes.select("company_id")).distinct()
    )

    def touched(layer: str, table: str, keys: DataFrame) -> list[int] | None:
        return None if through is None else _distinct(keys, lake.bucket_of(layer, table))

    by_company = touched("state", "payments", companies)
    by_account = touched("state", "balances", new_tx)
    only = {"balances": by_account, "day_sums": by_company, "payments": by_company, "debits": by_company, "flow_moments": by_company}

    def old(table: str) -> DataFrame:
        return lake.read_buckets("state", table, [] if through is None else only[table])

    merged = {
        "balances": state.balances(old("balances"), new_tx),
        "day_sums": state.day_sums(old("day_sums"), changes),
        "payments": state.payments(old("payments"), new_pay),
        "debits": state.debits(old("debits"), new_tx),
    }
    now = {t: lake.stage(df, "state", t, generation) for t, df in merged.items()}

    def with_others(table: str, rows: DataFrame) -> DataFrame:
        """Of the touched buckets also the rows of companies that did not move."""
        if through is None:
            return rows
        return rows.unionByName(lake.read_buckets("gold", table, by_company).join(companies, "company_id", "left_anti"))

    mine = {t: now[t].join(companies, "company_id", "left_semi") for t in ("day_sums", "payments", "debits")}
    gold = {}
    if lake.exists("silver", "payments"):
        done = g.features(mine["payments"].drop("event_id"), mine["debits"].drop("company_id"), ctx)
        gold["payment_features"] = with_others("payment_features", done)
    if lake.exists("silver", "transactions"):
        gold["daily_flows"] = with_others("daily_flows", state.flows(mine["day_sums"], accounts, ctx.run_col, ctx.now_col))
    for table, df in gold.items():
        staged = lake.stage(df, "gold", table, generation)
        if table == "daily_flows":
            merged["flow_moments"] = state.flow_moments(staged)
            lake.stage(merged["flow_moments"], "state", "flow_moments", generation)
    _put_positions(job, ctx, accounts, now["balances"], by_account)
    published = {("state", t): only[t] for t in merged} | {("gold", t): by_company for t in gold}
    try:
        lake.publish_buckets(generation, published, target, since)
    except Conflict:  # the positions above may lack the other writer's postings
        _put_positions(job, ctx, accounts, lake.read_buckets("state", "balances", by_account), by_account)
        raise


def _put_positions(job: Job, ctx: RunContext, accounts: DataFrame, balances: DataFrame, only: list[int] | None) -> None:
    """Today's cash positions: all of them at the first batch of a date, later those of touched buckets and new accounts."""
    lake = job.lake
    number = lake.bucket_of("state", "balances")
    if only is not None and lake.exists("gold", "cash_position_daily"):
        today = lake.read("gold", "cash_position_daily").where(F.col("position_date") == ctx.as_of).select("account_id")
        if not today.isEmpty():
            fresh = _distinct(accounts.join(today, "account_id", "left_anti"), number)
            balances = balances.unionByName(lake.read_buckets("state", "balances", sorted(set(fresh) - set(only))))
            only = sorted({*only, *fresh})
            accounts = accounts.where(number.isin(only))
        else:
            rest = sorted({int(b) for b in lake.manifest()["tables"].get("state.balances", {})} - set(only))
            balances = balances.unionByName(lake.read_buckets("state", "balances", rest))
    latest = balances.select("account_id", F.col("balance_after").alias("lake_balance"), F.col("booked_at").alias("last_booked_at"))
    rows = g.cash_position(accounts, latest, ctx)
    lake.put_partitions(rows.withColumn(BUCKET, number), "gold", "cash_position_daily")


def run_serving(job: Job, ctx: RunContext) -> dict:
    """Refresh the positions of the companies that moved, trace `serving`, and log the run in any case."""
    lake = job.lake
    done, target = lake.progress("serving"), lake.progress("gold")
    ids = moved(job, "serving").persist()
    refreshed = job.spark.createDataFrame([], "company_id int")
    try:
        if lake.exists("gold", "cash_position_daily") and not ids.isEmpty():
            positions = serving.company_position(
                lake.read("gold", "cash_position_daily"), scheduled_payments(job.ledger), ids, ctx
            )
            lake.replace_keyed(positions, "serving", "cash_position", ["company_id", "as_of_date"])
            today = lake.read("serving", "cash_position").where(F.col("as_of_date") == ctx.as_of)
            refreshed = today.join(ids.select("company_id").distinct(), "company_id", "left_semi")
            _trace(job, ids, "serving", ctx)
        finished = clock()
        row = serving.run_row(job.spark, ctx, ts_lit(finished), new_events(lake, done), ids, refreshed)
        result = row.first()  # the one row of the run log
        lake.append(job.spark.createDataFrame([result], schemas.RUNS), "ops", "pipeline_runs")
    finally:
        ids.unpersist()
    lake.advance("serving", target)
    return result.asDict()


def run_batch(job: Job, run_id: str, now=None) -> dict:
    """Every stage in order; returns the run-log row."""
    ctx = job.settings.context(run_id, now)
    run_bronze(job, ctx)
    run_silver(job, ctx)
    run_gold(job, ctx)
    try:
        scoring.score(job.lake, job.ledger, job.settings, ctx, moved=not moved(job, "serving").isEmpty())
    except Exception:  # positions are published even if no scores are
        log.exception("scoring failed; the published scores stay as they were")
    return run_serving(job, ctx)


def run_backfill(job: Job, ctx: RunContext) -> dict:
    """Ledger history that no event covers into bronze, then silver and gold; a second run adds nothing."""
    lake, table = job.lake, job.ledger.table
    outbox = table("outbox")
    pays = posting.backfill_payments(table("payments"), table("beneficiaries"), outbox)
    posts = posting.not_in_outbox(table("transactions"), outbox, "transaction", "transaction_id")
    seeds = silver.to_bronze(posting.seed_events(pays, posts), ctx)
    held = lake.read_or_none("bronze", "events")
    missing = posting.not_in_bronze(seeds, held).persist()
    try:
        appended = missing.count()
        batch = SEED_BATCH
        if appended:
            if held is not None:
                lowest = held.where(F.col(BATCH) <= SEED_BATCH).agg(F.min(BATCH)).first()[0]
                batch = SEED_BATCH if lowest is None else lowest - 1
            lake.put_batch(missing, "bronze", "events", batch)
    finally:
        missing.unpersist()
    inserted = 0
    if lake.exists("bronze", "events"):
        seeded = lake.read("bronze", "events").where(F.col(BATCH) <= SEED_BATCH)
        have = [lake.read_or_empty("silver", t).where(F.col("event_id") < 0).select("event_id") for t in TABLES]
        waiting = seeded.join(have[0].unionByName(have[1]), "event_id", "left_anti")
        if not waiting.isEmpty():
            _merge_silver(job, waiting, ctx, batch)
            mine = [lake.read("silver", t).where((F.col(BATCH) == batch) & (F.col("run_id") == ctx.run_id)) for t in TABLES]
            ids = mine[0].select("payment_id", "company_id").unionByName(mine[1].select("payment_id", "company_id"))
            inserted = ids.count()
            _trace(job, ids, "silver", ctx)
            _trace(job, ids, "gold", ctx)
        run_gold(job, ctx, force=inserted > 0)
    return {"bronze_appended": appended, "silver_inserted": inserted}


def start_up(job: Job, run_id: str, now=None) -> dict:
    """Once: ledger history into the lake, and a first model when there is none."""
    ctx = job.settings.context(run_id, now)
    result = run_backfill(job, ctx)
    if scoring.champions(job.lake) is None:
        result["train"] = scoring.train(job.lake, job.settings, ctx)
    return result
