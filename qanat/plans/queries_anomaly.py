"""Queries: the anomaly model's inputs, rarity, reasons and the forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import score4
from ..functions.times import gulf_hour
from ..operators import anomaly, forest, gold
from ..sources.settle import settle
from .queries_gold import CTX
from .registry import query
from .views import VIEWS, Ledger

VIEWS["frame"] = """
SELECT f.payment_id, f.company_id, f.transaction_id, f.counterparty, f.amount, f.executed_at, amount_to_prior_mean AS ratio,
  ln(CAST(amount AS DOUBLE) / m.median) AS log_amount_rel,
  ln(greatest(coalesce(amount_to_prior_mean, 1.0), 1e-6)) AS log_ratio, hour_gst,
  CAST(is_weekend AS INTEGER) AS is_weekend, CAST(is_first_time_beneficiary AS INTEGER) AS is_first_time,
  same_day_duplicates AS dup_count
FROM features f JOIN (SELECT company_id, median(CAST(amount AS DOUBLE)) AS median FROM features GROUP BY company_id) m
  ON m.company_id = f.company_id"""

VIEWS["extremes"] = """
SELECT payment_id, feature, extremity FROM (
  SELECT payment_id, round(abs(log_amount_rel), 9) AS log_amount_rel, round(abs(log_ratio), 9) AS log_ratio,
    abs(hour_gst - (SELECT median(hour_gst) FROM frame)) AS hour_gst, CAST(is_weekend AS DOUBLE) AS is_weekend,
    CAST(is_first_time AS DOUBLE) AS is_first_time, CAST(dup_count AS DOUBLE) AS dup_count FROM frame)
UNPIVOT (extremity FOR feature IN (log_amount_rel, log_ratio, hour_gst, is_weekend, is_first_time, dup_count))"""

VIEWS["shares"] = """
SELECT payment_id, feature, CASE WHEN extremity > 0
  THEN 1.0 - CAST(rank() OVER (PARTITION BY feature ORDER BY extremity) - 1 AS DOUBLE) / COUNT(*) OVER (PARTITION BY feature)
  ELSE 1.0 END AS rarity FROM extremes"""

VIEWS["top_feature"] = """
SELECT payment_id, arg_min(feature, (rarity, list_position(['dup_count', 'log_ratio', 'hour_gst', 'is_weekend',
  'is_first_time', 'log_amount_rel'], feature))) AS strongest FROM shares GROUP BY payment_id"""


def features_table(L: Ledger) -> DataFrame:
    """Payment features as the gold table holds them: written once, read by every step after."""
    return settle(gold.payment_features(L.silver_payments, L.silver_postings, CTX, keep=settle))


def frame(L: Ledger) -> DataFrame:
    """The model frame, set down once: the distribution, the look-ups and the cells all read it."""
    return settle(anomaly.anomaly_frame(features_table(L)))


def rarities(L: Ledger, f: DataFrame) -> DataFrame:
    stats = anomaly.hour_median(f)
    return anomaly.rarity(f, anomaly.reference_table(f, stats), stats)


@query("SELECT company_id, median(CAST(amount AS DOUBLE)) AS median FROM features GROUP BY company_id")
def company_median(L: Ledger) -> DataFrame:
    pay = L.payments.where(F.col("status") == "EXECUTED")
    return anomaly.company_median(pay.select("company_id", "amount"))


@query("SELECT median(hour_gst) AS hour_median FROM features")
def hour_median(L: Ledger) -> DataFrame:
    pay = L.payments.where(F.col("status") == "EXECUTED")
    return anomaly.hour_median(pay.select(gulf_hour(F.col("executed_at")).alias("hour_gst")))


@query("""SELECT * EXCLUDE (log_amount_rel, log_ratio, ratio), round(log_amount_rel, 9) AS log_amount_rel,
  round(log_ratio, 9) AS log_ratio, round(ratio, 9) AS ratio FROM frame""")
def anomaly_frame(L: Ledger) -> DataFrame:
    return frame(L).withColumns({c: F.round(c, 9) for c in ("log_amount_rel", "log_ratio", "ratio")})


@query("SELECT * FROM extremes")
def feature_extremities(L: Ledger) -> DataFrame:
    f = frame(L)
    return anomaly.extremities(f, anomaly.hour_median(f), "payment_id")


@query("SELECT feature, extremity, COUNT(*) AS n FROM extremes GROUP BY feature, extremity")
def reference_distribution(L: Ledger) -> DataFrame:
    f = frame(L)
    return anomaly.reference_table(f, anomaly.hour_median(f))


@query("""SELECT payment_id, """ + ", ".join(
    f"round(MAX(rarity) FILTER (feature = '{f}'), 9) AS rarity_{f}" for f in anomaly.FEATURES
) + " FROM shares GROUP BY payment_id")
def feature_rarity(L: Ledger) -> DataFrame:
    f = frame(L)
    wide = anomaly.rarity_wide(f, rarities(L, f))
    return wide.select("payment_id", *[F.round(f"rarity_{c}", 9).alias(f"rarity_{c}") for c in anomaly.FEATURES])


@query("SELECT * FROM top_feature")
def strongest_feature(L: Ledger) -> DataFrame:
    f = frame(L)
    return anomaly.strongest(f, rarities(L, f)).select("payment_id", "strongest")


TIMES = "CASE WHEN {x} >= 10 THEN printf('%.0f', {x}) ELSE regexp_replace(printf('%.1f', {x}), '\\.0$', '') END"


@query(f"""
SELECT f.payment_id, CASE
  WHEN strongest = 'dup_count' THEN 'Possible duplicate: same ' || CASE WHEN counterparty = 'Own account transfer' THEN 'account'
    ELSE 'supplier' END || ', amount and day as an earlier payment'
  WHEN strongest = 'log_ratio' AND ratio IS NOT NULL THEN 'Unusual: ' || {TIMES.format(x='round(ratio, 9)')} || '× this supplier''s average'
  WHEN strongest IN ('hour_gst', 'is_weekend') THEN 'Unusual: ' || strftime(executed_at + INTERVAL 4 HOURS, '%A %H:%M')
    || ' payment' || CASE WHEN is_first_time = 1 THEN ' to a first-time beneficiary' ELSE '' END
  WHEN strongest = 'is_first_time' THEN 'Unusual: first payment to this beneficiary'
  ELSE 'Unusual: ' || {TIMES.format(x='round(exp(log_amount_rel), 9)')} || '× this company''s typical payment' END AS reason
FROM frame f JOIN top_feature t ON t.payment_id = f.payment_id""")
def anomaly_reasons(L: Ledger) -> DataFrame:
    """The sentence every payment would carry if it were flagged."""
    f = frame(L)
    return anomaly.strongest(f, rarities(L, f)).select("payment_id", anomaly.reason().alias("reason"))


@query("SELECT payment_id, CAST(greatest(least(CAST(amount AS DOUBLE) / 250.0 - 0.1, 1.0), 0.0) AS DECIMAL(6,4)) AS score FROM payments")
def clamped_scores(L: Ledger) -> DataFrame:
    return L.payments.select("payment_id", score4(F.col("amount").cast("double") / 250.0 - 0.1).alias("score"))


def scored(f: DataFrame) -> DataFrame:
    cells = forest.cell_table(f)
    total = cells.agg(F.sum("n")).scalar()
    return forest.score(f, settle(forest.fit_forest(cells)), total)


@query("""SELECT CAST(round(log_amount_rel / 0.05) AS BIGINT) AS c_log_amount_rel, CAST(round(log_ratio / 0.05) AS BIGINT) AS c_log_ratio,
  CAST(hour_gst AS BIGINT) AS c_hour_gst, CAST(is_weekend AS BIGINT) AS c_is_weekend, CAST(is_first_time AS BIGINT) AS c_is_first_time,
  CAST(dup_count AS BIGINT) AS c_dup_count, COUNT(*) AS n FROM frame GROUP BY ALL""")
def forest_cells(L: Ledger) -> DataFrame:
    """The weighted cells every tree is grown on."""
    return forest.cell_table(frame(L))


@query()
def anomaly_scores(L: Ledger) -> DataFrame:
    """Isolation-forest score of every executed payment."""
    return scored(frame(L)).select("payment_id", F.round("score", 6).alias("score"))


@query()
def flagged_payments(L: Ledger) -> DataFrame:
    """Payments at or above the threshold with score and reason, numbered for serving."""
    f = frame(L)
    stats = anomaly.hour_median(f)
    flagged = anomaly.flag(scored(f), anomaly.reference_table(f, stats), stats, keep=settle)
    return anomaly.anomaly_rows(flagged, "1", CTX)


@query()
def anomaly_metrics(L: Ledger) -> DataFrame:
    return anomaly.training_metrics(settle(scored(frame(L)).select("score")))
