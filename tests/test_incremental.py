"""A batch's cost follows what it touches: gold's buckets, silver's key ranges, the trace's ranges."""

import random
import re
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from qanat import schemas
from qanat.operators import gold as g
from qanat.operators import gold_state as state
from qanat.plans import batch
from qanat.sources.lake import BUCKETED, Lake, key_ranges
from tests.ledgers import NOW, job, land, ledger, transfer_lines

GOLD = ("payment_features", "daily_flows")
DROP = ["run_id", "computed_at"]


def of_company(number, lines):
    return [line.replace('"company_id": 1', f'"company_id": {number}').replace('\\"company_id\\": 1', f'\\"company_id\\": {number}') for line in lines]


def rows(j, table):
    return sorted(map(repr, j.lake.read("gold", table).drop(*DROP).collect()))


@pytest.fixture(scope="module")
def lived(spark, tmp_path_factory):
    """A lake after two batches: many companies, then three events of company 7."""
    root = tmp_path_factory.mktemp("lived")
    j = job(spark, root, ledger(spark))
    for c in range(1, 13):
        land(j, f"c{c}", of_company(c, transfer_lines(payment_id=9_000 + c, first_id=10 * c, first_tx=5_000 + 10 * c)))
    batch.run_batch(j, "run-a", NOW)
    before = j.lake.manifest()
    listed = {}
    read = Lake.read_buckets

    def watched(self, layer, table, only=None):
        found = read(self, layer, table, only)
        listed.setdefault((layer, table), []).extend(found.inputFiles())
        return found

    land(j, "late", of_company(7, transfer_lines(payment_id=9_900, first_id=900, first_tx=9_000)))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Lake, "read_buckets", watched)
        ctx = j.settings.context("run-b", NOW)
        batch.run_bronze(j, ctx)
        batch.run_silver(j, ctx)
        assert batch.run_gold(j, ctx)
    return j, before, listed


def test_a_batch_of_three_events_reads_and_writes_its_buckets_only(lived):
    j, before, listed = lived
    after = j.lake.manifest()
    assert (after["generation"], after["through"]) == (before["generation"] + 1, j.lake.progress("silver"))
    for name, held in after["tables"].items():
        moved = {b for b, generation in held.items() if generation == after["generation"]}
        assert 1 <= len(moved) <= 2, name  # one company; two accounts
        assert {b: n for b, n in held.items() if b not in moved} == {b: n for b, n in before["tables"][name].items() if b not in moved}
    for (layer, table), files in listed.items():
        moved = {b for b, n in after["tables"][f"{layer}.{table}"].items() if n == after["generation"]}
        assert files and all(any(f"/_bucket={b}/" in f for b in moved) for f in files)
        assert len(before["tables"][f"{layer}.{table}"]) > len(moved) or BUCKETED[layer, table] == "account_id"


def test_the_state_equals_a_rebuild_from_silver(lived):
    j, _, _ = lived
    kept = {t: rows(j, t) for t in GOLD}
    held = {t: sorted(map(repr, j.lake.read("state", t).collect())) for t in state.SCHEMAS}
    assert len(kept["payment_features"]) == 13
    batch.run_gold(j, j.settings.context("full", NOW), force=True)
    assert {t: rows(j, t) for t in GOLD} == kept
    assert {t: sorted(map(repr, j.lake.read("state", t).collect())) for t in state.SCHEMAS} == held


def test_a_merge_that_dies_before_it_is_published_counts_nothing_twice(spark, tmp_path, monkeypatch):
    j = job(spark, tmp_path, ledger(spark))
    land(j, "a", transfer_lines())
    batch.run_batch(j, "run-a", NOW)
    land(j, "b", transfer_lines(payment_id=9_002, first_id=20, first_tx=6_000))
    ctx = j.settings.context("run-b", NOW)
    batch.run_bronze(j, ctx)
    batch.run_silver(j, ctx)
    for place in ("publish_buckets", "advance"):  # before the state counts, and after it counts but before the stage is done
        with monkeypatch.context() as m:
            m.setattr(Lake, place, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                batch.run_gold(j, ctx)
    assert batch.run_gold(j, ctx)
    flows = {r["flow_date"]: (r["transfer_net"], r["total_net"]) for r in j.lake.read("gold", "daily_flows").collect()}
    assert flows == {date(2026, 10, 5): (Decimal("900000.00"), Decimal("900000.00"))}  # twice the non-Reserve leg
    old = [f for f in j.lake.manifest()["superseded"] if j.lake.files.exists(f)]
    assert old and batch.run_gold(j, j.settings.context("full", NOW), force=True)
    assert not any(j.lake.files.exists(f) for f in old)  # the call after next deletes what was replaced


def postings(spark, rng, events, known):
    """Postings that several events carry, in any order of event ids."""
    out = []
    for e in events:
        tx = rng.randrange(40)
        company = known.setdefault(tx, rng.randrange(3))
        day = date(2026, 1, 1) + timedelta(days=rng.randrange(4))
        out.append((e, tx, company, company * 10 + rng.randrange(2), rng.choice([None, tx]), Decimal(rng.randrange(-900, 900)), Decimal(e),
                    rng.choice(["supplier", "payroll", "fees", None]), "x", datetime(2026, 1, 1, 9), day, datetime(2026, 1, 1, 9), "r", datetime(2026, 1, 1)))
    return spark.createDataFrame(out, schemas.SILVER_TRANSACTIONS)


def test_day_sums_are_exact_whatever_comes_late(spark):
    """Batches in which a posting comes again with a smaller or larger event id: the sums are those of all rows at once."""
    rng, known = random.Random(5), {}
    ids = list(range(1, 241))
    rng.shuffle(ids)
    accounts = spark.createDataFrame([(c * 10 + k, c, "reserve" if k else "operating", Decimal(0)) for c in range(3) for k in range(2)], schemas.ACCOUNTS)
    sums, seen = spark.createDataFrame([], state.SCHEMAS["day_sums"]), spark.createDataFrame([], schemas.SILVER_TRANSACTIONS)
    for k in range(0, 240, 60):
        new = postings(spark, rng, ids[k : k + 60], known)
        sums = spark.createDataFrame(state.day_sums(sums, state.posting_changes(new, seen)).collect(), state.SCHEMAS["day_sums"])
        seen = seen.unionByName(new)
    ctx = job(spark, "/tmp", ledger(spark)).settings.context("x", NOW)
    got = state.flows(sums, accounts, ctx.run_col, ctx.now_col).drop(*DROP)
    want = g.daily_flows(seen, accounts, ctx).drop(*DROP)
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_one_old_id_reads_one_batch(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    empty = spark.createDataFrame([], schemas.SILVER_PAYMENTS)
    fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields[1:]]
    of = lambda ids: ids.select(F.col("id").alias("event_id"), *fields)
    for n in range(6):
        lake.merge_insert(of(spark.range(1_000 * n, 1_000 * (n + 1))), "silver", "payments", "event_id", n)
    again = spark.range(2_500, 2_501).union(spark.range(6_000, 6_400))  # one old id and new ones
    held = lake.holding("silver", "payments", "event_id", of(again))
    filters = held._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]
    assert re.findall(r"batch#\d+L? (?:= |IN \()([\d,]+)", filters) == ["2"] and held.count() <= 100
    lake.merge_insert(of(again), "silver", "payments", "event_id", 6)
    assert lake.read("silver", "payments").where("batch = 6").count() == 400
    lake.files.delete(f"{tmp_path}/_keys/silver_payments/batch=4")  # a writer that died before its note
    held = lake.holding("silver", "payments", "event_id", of(spark.range(4_200, 4_201)))
    assert held.select("event_id").collect()[0][0] == 4_200
    lake.merge_insert(of(again), "silver", "payments", "event_id", 6)  # the batch once more: it keeps its rows
    assert lake.read("silver", "payments").count() == 6_400
    assert lake.holding("silver", "payments", "event_id", of(spark.range(0))).count() == 0


def test_key_ranges_cover_all_keys(spark):
    rng = random.Random(2)
    keys = [rng.choice([-(2**62), 0, 5, 2**62]) + rng.randrange(1000) for _ in range(300)] + [None]
    found = key_ranges(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert len(found) <= 64 and all(any(a <= k <= b for a, b in found) for k in keys if k is not None)
    assert sum(b - a for a, b in found) < 10_000  # four narrow places of a wide span
    assert key_ranges(spark.createDataFrame([(None,)], "k long"), "k") == []


def test_the_trace_reads_the_ranges_of_its_ids(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    at = F.lit("2026-01-05 09:00:00").cast("timestamp_ntz").alias("at")
    of = lambda low, high, stage="gold": spark.range(low, high).select(F.col("id").alias("payment_id"), F.lit(stage).alias("stage"), at)
    keys = ["payment_id", "stage"]
    lake.insert_absent(of(0, 1_000), "ops", "pipeline_trace", keys)
    plans = []
    append = Lake.append
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Lake, "append", lambda self, df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or append(self, df, *a))
        lake.insert_absent(of(990, 1_010), "ops", "pipeline_trace", keys)
    assert "stage#" in plans[0].split("PartitionFilters: ")[1].split("]")[0]
    assert "GreaterThanOrEqual(payment_id,990)" in plans[0]
    lake.insert_absent(of(0, 10, "silver"), "ops", "pipeline_trace", keys)
    stored = defaultdict(int)
    for r in lake.read("ops", "pipeline_trace").collect():
        stored[r["stage"]] += 1
    assert stored == {"gold": 1_010, "silver": 10}
