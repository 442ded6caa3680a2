"""Several writers of one lake: commits, versions that go, generations."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from qanat.plans import batch
from qanat.sources import commits
from qanat.sources.commits import CommitLog, Conflict, Files
from qanat.sources.lake import VERSIONS, Lake
from tests.ledgers import NOW, job, land, ledger, transfer_lines


def keyed(spark, low, high, mark):
    return spark.range(low, high).select(F.col("id").alias("k"), F.lit(mark).alias("mark"))


def held(lake, table="t"):
    return {r["k"]: r["mark"] for r in lake.read("gold", table).collect()}


def test_a_taken_name_is_not_overwritten(spark, tmp_path):
    files = Files(spark)
    assert files.create(f"{tmp_path}/a/1", "first") and not files.create(f"{tmp_path}/a/1", "second")
    assert files.read(f"{tmp_path}/a/1") == "first" and files.names(f"{tmp_path}/a") == ["1"]


def test_changes_of_many_writers_all_count(spark, tmp_path):
    logs = [CommitLog(Files(spark), f"{tmp_path}/log") for _ in range(6)]

    def add(log):
        for _ in range(5):
            log.commit(lambda state: {"n": state.get("n", 0) + 1})

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(add, logs))
    assert logs[0].latest() == (30, {"n": 30})


def test_old_numbers_go_and_a_writer_that_slept_commits_on_the_latest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "KEPT", 4)
    log = CommitLog(Files(spark), f"{tmp_path}/log")
    log.commit(lambda s: {"n": 1})
    slept = []

    def sleepy(state):
        if not slept:
            slept.append(state["n"])
            for _ in range(9):  # its next number is taken and removed meanwhile
                log.commit(lambda s: {"n": s["n"] + 1})
        return {"n": state["n"] + 100}

    assert log.commit(sleepy) == {"n": 110} and log.latest() == (11, {"n": 110})
    assert len(log._numbers()) <= 6


def test_two_writers_of_a_table_lose_no_row(spark, tmp_path):
    """Both read the same version; the slower one merges again."""
    one, two = Lake(spark, str(tmp_path)), Lake(spark, str(tmp_path))
    one.replace_by_key(keyed(spark, 0, 4, "start"), "gold", "t", ["k"])
    publish, between = one.publish, []

    def late(tables, since=None):
        if not between:
            between.append(two.replace_by_key(keyed(spark, 2, 6, "two"), "gold", "t", ["k"]))
        return publish(tables, since)

    one.publish = late
    assert one.replace_by_key(keyed(spark, 5, 7, "one"), "gold", "t", ["k"]) == 3 and between == [2]
    assert held(one) == {0: "start", 1: "start", 2: "two", 3: "two", 4: "two", 5: "one", 6: "one"}


def test_writers_in_parallel_and_a_pair_of_tables(spark, tmp_path):
    lakes = [Lake(spark, str(tmp_path)) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: lakes[n].replace_by_key(keyed(spark, 10 * n, 10 * n + 3, str(n)), "gold", "t", ["k"]), range(4)))
        assert held(lakes[0]) == {10 * n + i: str(n) for n in range(4) for i in range(3)}
        pair = lambda n: lakes[n].publish({("gold", t): keyed(spark, 0, 2, str(n)) for t in ("a", "b")})
        list(pool.map(pair, range(4)))
        list(pool.map(lambda n: lakes[n].advance("gold", n), range(4)))
    assert held(lakes[0], "a") == held(lakes[0], "b") and lakes[0].version("gold", "a") == 4
    assert lakes[1].progress("gold") == 3


def test_a_conflict_publishes_nothing(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.overwrite(keyed(spark, 0, 2, "a"), "gold", "t")
    with pytest.raises(Conflict):
        lake.publish({("gold", "t"): keyed(spark, 0, 9, "b"), ("gold", "u"): keyed(spark, 0, 9, "b")}, since={("gold", "t"): None})
    assert held(lake) == {0: "a", 1: "a"} and not lake.exists("gold", "u")
    assert len(lake.files.names(lake.path("gold", "t"))) == 1 and lake.files.names(lake.path("gold", "u")) == []


def test_old_versions_go_and_started_readers_end(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.overwrite(keyed(spark, 0, 5, "first"), "gold", "t")
    reader = lake.read("gold", "t")
    for n in range(VERSIONS - 1):
        lake.overwrite(keyed(spark, 0, n, "later"), "gold", "t")
    assert reader.count() == 5
    for n in range(4):
        lake.overwrite(keyed(spark, 0, n, "later"), "gold", "t")
    folder = lake.path("gold", "t")
    assert len(lake.files.names(folder)) == VERSIONS and lake.version("gold", "t") == VERSIONS + 4
    keyed(spark, 0, 1, "lost").write.parquet(f"{folder}/v-dead")  # a writer that died before its commit
    assert lake.sweep("gold", "t") == [] and lake.sweep("gold", "t", hours=-1) == ["v-dead"]
    assert len(held(lake)) == 3


def test_a_gold_merge_that_is_overtaken_is_done_again(spark, tmp_path, monkeypatch):
    """Another writer publishes a later batch while this one merges; the state holds both, and nothing twice."""
    j = job(spark, tmp_path, ledger(spark))
    land(j, "a", transfer_lines())
    batch.run_batch(j, "run-a", NOW)
    land(j, "b", transfer_lines(payment_id=9_002, first_id=20, first_tx=6_000))
    ctx = j.settings.context("run-b", NOW)
    batch.run_bronze(j, ctx)
    batch.run_silver(j, ctx)
    put, generations = batch._put_positions, []

    def overtaken(*args):
        put(*args)
        if not generations:
            generations.append(j.lake.manifest()["generation"])
            land(j, "c", transfer_lines(payment_id=9_003, first_id=30, first_tx=7_000))
            other = j.settings.context("run-c", NOW)
            batch.run_bronze(j, other)
            batch.run_silver(j, other)
            assert batch.run_gold(j, other)

    monkeypatch.setattr(batch, "_put_positions", overtaken)
    batch.run_gold(j, ctx)
    monkeypatch.undo()
    keep = {t: sorted(map(repr, j.lake.read("gold", t).drop("run_id", "computed_at").collect())) for t in ("payment_features", "daily_flows", "cash_position_daily")}
    assert j.lake.manifest()["through"] == j.lake.progress("silver") and len(keep["payment_features"]) == 3
    assert batch.run_gold(j, j.settings.context("full", NOW), force=True)
    for t, rows in keep.items():
        assert sorted(map(repr, j.lake.read("gold", t).drop("run_id", "computed_at").collect())) == rows
