"""Train and score. Models are tables; fitting and scoring run on the cluster."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import RunContext, Settings
from ..operators import anomaly, forecast, forest
from ..operators.history import daily_flow_history
from ..sources import models
from ..sources.lake import Lake
from ..sources.settle import settle
from ..sources.ledger import scheduled_payments, scoring_state

log = logging.getLogger("qanat")

SKIPPED = {"status": "skipped"}


def _frame(lake: Lake) -> DataFrame:
    """The model frame, set down once: cells, distribution and scores all read it."""
    return settle(anomaly.anomaly_frame(lake.read("gold", "payment_features")))


def _metrics_json(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.to_json(F.struct(*[F.col(c) for c in sorted(metrics.columns)])).alias("metrics"))


def train(lake: Lake, settings: Settings, ctx: RunContext) -> dict:
    """Fit both models on gold, register them as new champions and replace their rows in serving.models."""
    if not (lake.exists("gold", "daily_flows") and lake.exists("gold", "payment_features")):
        return {**SKIPPED, "reason": "no gold data"}
    history = daily_flow_history(lake.read("gold", "daily_flows"), ctx.as_of)
    frame = _frame(lake)
    if history.isEmpty() or frame.isEmpty():
        return {**SKIPPED, "reason": "no history"}

    flows, moments = lake.read("gold", "daily_flows"), lake.read("state", "flow_moments")
    profile = forecast.fit_from_moments(moments, flows, ctx.as_of)
    horizon = {"horizon_days": forecast.HORIZON_DAYS, "band": forecast.BAND, "holdout_days": forecast.HOLDOUT_DAYS}
    profile_version = models.register(lake, forecast.MODEL_NAME, {"profile": profile}, horizon)
    grid = forest.GRID
    stats = anomaly.hour_median(frame)
    parts = {
        "forest": forest.fit_forest(forest.cell_table(frame, grid), settings.n_trees, settings.ml_seed, grid),
        "reference": anomaly.reference_table(frame, stats),
        "stats": frame.agg(
            F.median("hour_gst").alias("hour_median"),
            F.count(F.lit(1)).alias("n"),
            F.lit(grid).alias("grid"),
            F.lit(settings.n_trees).alias("n_trees"),
        ),
    }
    chosen = {"seed": settings.ml_seed, "n_trees": settings.n_trees, "grid": grid, "threshold": anomaly.THRESHOLD}
    forest_version = models.register(lake, anomaly.MODEL_NAME, parts, chosen)

    metrics = {
        forecast.MODEL_NAME: (profile_version, forecast.backtest(history)),
        anomaly.MODEL_NAME: (forest_version, anomaly.training_metrics(settle(scored(lake, frame).select("score")))),
    }
    rows = [
        _metrics_json(m).select(
            F.lit(name).alias("model_name"),
            F.lit(models.registered_name(name)).alias("registered_name"),
            F.lit(version).alias("model_version"),
            ctx.now_col.alias("trained_at"),
            "metrics",
            ctx.run_col.alias("run_id"),
        )
        for name, (version, m) in metrics.items()
    ]
    lake.replace_by_key(rows[0].unionByName(rows[1]), "serving", "models", ["model_name"])
    return {"status": "trained", forecast.MODEL_NAME: profile_version, anomaly.MODEL_NAME: forest_version}


def champions(lake: Lake):
    fc = models.champion(lake, forecast.MODEL_NAME, "profile")
    an = models.champion(lake, anomaly.MODEL_NAME, "forest", "reference", "stats")
    return None if fc is None or an is None else (fc, an)


def scored(lake: Lake, frame: DataFrame) -> DataFrame:
    """Payments scored by the champion forest."""
    parts, _ = models.champion(lake, anomaly.MODEL_NAME, "forest", "stats")
    fixed = parts["stats"].first()  # one row of model parameters
    return forest.score(frame, parts["forest"], F.lit(fixed["n"]), fixed["grid"], fixed["n_trees"])


def up_to_date(lake: Lake, fc_version: str, an_version: str, ctx: RunContext) -> bool:
    """Serving already shows these versions for this business date: every forecast state row is the wanted
    one, and no anomaly names another version."""
    if not lake.exists("serving", "forecast"):
        return False
    state = scoring_state(lake.read("serving", "forecast"), lake.read("serving", "anomalies"))
    name, version, first = F.col("model_name"), F.col("model_version"), F.col("first_date")
    wanted_fc = (name == forecast.MODEL_NAME) & (version == fc_version) & (first == ctx.as_of)
    wanted_an = (name == anomaly.MODEL_NAME) & (version == an_version) & first.isNull()
    counts = state.agg(
        F.count(F.when(wanted_fc, 1)).alias("ok"),
        F.count(F.when(~F.coalesce(wanted_fc | wanted_an, F.lit(False)), 1)).alias("other"),
    ).first()
    return counts["ok"] == 1 and counts["other"] == 0


def score(lake: Lake, ledger, settings: Settings, ctx: RunContext, moved: bool) -> dict:
    """Replace the forecast and the anomalies together, each row naming its model and version."""
    found = champions(lake)
    if found is None:
        return {**SKIPPED, "reason": "no model"}
    if not lake.exists("gold", "cash_position_daily"):
        return {**SKIPPED, "reason": "no gold data"}
    (fc, fc_version), (an, an_version) = found
    if not moved and up_to_date(lake, fc_version, an_version, ctx):
        return {"status": "unchanged"}
    balances = forecast.latest_non_reserve(lake.read("gold", "cash_position_daily"))
    path = forecast.project(fc["profile"], balances, scheduled_payments(ledger), ctx.as_of)
    flagged = anomaly.flag(scored(lake, _frame(lake)), an["reference"], an["stats"], keep=settle)
    lake.publish(
        {
            ("serving", "forecast"): forecast.forecast_rows(path, forecast.MODEL_NAME, fc_version, ctx.now_col),
            ("serving", "anomalies"): anomaly.anomaly_rows(flagged, an_version, ctx),
        }
    )
    return {"status": "scored", forecast.MODEL_NAME: fc_version, anomaly.MODEL_NAME: an_version}
