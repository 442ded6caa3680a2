"""Skew-safe totals against plain windows, with one key holding most rows and NULL keys."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from qanat.operators.rates import counter_increases
from qanat.operators.skew import exact_median, in_ranges, numbered, previous, running, spread_join, value_counts


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = []
    for i in range(3_000):
        key = None if i % 10 == 0 else 1 if rnd.random() < 0.6 else rnd.randrange(2, 30)
        data.append((i, key, rnd.randrange(0, 5_000), rnd.choice([None, 1, 2]), float(rnd.randrange(1, 50)) * 25))
    return spark.createDataFrame(data, "id long, k int, t long, k2 int, amount double").withColumn(
        "amount", F.col("amount").cast("decimal(18,2)")
    )


@pytest.fixture
def ranges(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("ranges", [1, 4, 60], indirect=True)
def test_running_equals_plain_window(rows, inclusive, ranges):
    ours = running(rows, ["k", "k2"], ["t", "id"], {"n": F.lit(1).cast("long"), "s": F.col("amount")}, inclusive)
    w = Window.partitionBy("k", "k2").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    plain = rows.withColumn("n", F.sum(F.lit(1).cast("long")).over(w)).withColumn("s", F.sum("amount").over(w))
    same = plain.join(ours.select("id", F.col("n").alias("n2"), F.col("s").alias("s2")), "id")
    assert same.where(~F.col("n").eqNullSafe(F.col("n2")) | ~F.col("s").eqNullSafe(F.col("s2"))).count() == 0
    assert same.count() == 3_000


@pytest.mark.parametrize("ranges", [40], indirect=True)
def test_empty_values_and_values_of_one_key(spark, ranges):
    """A total without values stays NULL over ranges; the first rows of a key never see another key's total."""
    rows = spark.range(2_000).select("id", F.floor(F.col("id") / 900).alias("k"), F.when(F.col("id") % 900 >= 500, F.lit(2.5)).alias("v"))
    done = running(rows, ["k"], ["id"], {"s": F.col("v"), "n": F.lit(1)})
    assert done.where(~F.col("s").eqNullSafe(F.when(F.col("id") % 900 > 500, (F.col("id") % 900 - 500) * 2.5))).count() == 0
    assert done.where(F.coalesce("n", F.lit(0)) != F.col("id") % 900).count() == 0
    assert running(rows.limit(0), ["k"], ["id"], {"s": F.col("v")}).count() == 0


@pytest.mark.parametrize("ranges", [60], indirect=True)
def test_a_window_holds_one_range_of_a_hot_key(rows, ranges):
    """The largest window partition is a range of the hot key, not the key; few rows hand totals on."""
    dealt = in_ranges(rows, ["k"], ["t", "id"], {"n": F.lit(1)})
    sizes = dealt.groupBy("_range", "_key0").count().agg(F.max("count")).first()[0]
    assert sizes < 3_000 / 60 * 4 < rows.where("k = 1").count()
    assert dealt.where("_row is null").count() <= 60 * 59 / 2


def test_two_exchanges_of_the_rows(rows):
    """One by range, one by range and key; the second has no other purpose than to let a plain window run."""
    plan = running(rows, ["k"], ["t", "id"], {"n": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan


def test_numbered_is_one_to_n(rows):
    got = [r["id2"] for r in numbered(rows, ["t", "id"], "id2").orderBy("t", "id").collect()]
    assert got == list(range(1, 3_001))


def test_exact_median(rows):
    counts = value_counts(rows, ["k"], "amount")
    got = {r["k"]: r["median"] for r in exact_median(counts.where("k is not null"), ["k"], "amount").collect()}
    want = {}
    for r in rows.where("k is not null").collect():
        want.setdefault(r["k"], []).append(float(r["amount"]))
    assert got == {k: statistics.median(v) for k, v in want.items()}


def test_spread_join_keeps_every_row_once(spark, rows):
    look_up = spark.createDataFrame([(1, "hot"), (2, "two")], "k int, name string")
    joined = spread_join(rows, look_up, ["k"], "id")
    assert joined.count() == 3_000
    assert joined.where("name = 'hot'").count() == rows.where("k = 1").count()
    assert spread_join(rows, look_up, ["k"], "id", how="inner").count() == rows.where("k in (1, 2)").count()


@pytest.mark.parametrize("ranges", [30], indirect=True)
def test_a_burst_at_one_instant_is_cut_by_ids(spark, ranges):
    """However many rows share an instant, no window partition holds more than a range of them."""
    rows = spark.range(300_000).select(F.col("id"), F.lit("2026-01-05 09:00:00").cast("timestamp_ntz").alias("t"), F.lit(1).alias("k"))
    done = running(rows, ["k"], ["t", "id"], {"n": F.lit(1).cast("long")})
    assert done.where("coalesce(n, 0) <> id").count() == 0
    dealt = in_ranges(rows, ["k"], ["t", "id"], {"n": F.lit(1)})
    assert dealt.groupBy("_range").count().agg(F.max("count")).first()[0] <= 3 * 300_000 / 30


def test_running_has_one_plan_and_starts_no_job(spark, rows):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    small, large = rows.limit(10), rows
    plans = [running(df, ["k"], ["t", "id"], {"n": F.lit(1)})._jdf.queryExecution().logical().toString() for df in (small, large)]
    assert plans[0].count("Window") == plans[1].count("Window") > 0
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


@pytest.mark.parametrize("ranges", [1, 7, 60], indirect=True)
def test_previous_equals_lag(rows, ranges):
    ours = previous(rows, ["k", "k2"], ["t", "id"], {"before": F.col("amount")})
    w = Window.partitionBy("k", "k2").orderBy("t", "id")
    same = rows.withColumn("b2", F.lag("amount").over(w)).join(ours.select("id", "before"), "id")
    assert same.count() == 3_000 and same.where(~F.col("before").eqNullSafe(F.col("b2"))).count() == 0


@pytest.mark.parametrize("ranges", [50], indirect=True)
def test_a_million_samples_of_one_series_in_a_minute_are_spread(spark, ranges):
    """A counter that counts every sample and starts over every 250,000: all increases but the first sample's are 1."""
    at = (F.lit("2026-01-05 09:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") / 20_000).cast("decimal(18,6)"))).alias("ts")
    samples = spark.range(1_000_000).select(at, F.lit("r").alias("region"), F.lit("w").alias("workload"), (F.col("id") % 250_000 + 1).cast("double").alias("value"))
    found = counter_increases(samples)
    assert found.count() == 999_999 and found.where("increase <> 1").count() == 0
    dealt = in_ranges(samples, ["region", "workload"], ["ts", "value"], {"n": F.col("value")}, hand_last=True)
    assert dealt.groupBy("_range").count().agg(F.max("count")).first()[0] <= 3 * 1_000_000 / 50
