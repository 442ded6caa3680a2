"""Models as tables: each training run writes a new version, and one alias move makes it the champion."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from .lake import Lake

LAYER = "ml"


def registered_name(name: str) -> str:
    return f"{LAYER}.{name}"


def register(lake: Lake, name: str, parts: Mapping[str, DataFrame], parameters: Mapping[str, object] | None = None) -> str:
    """Write every part of a model, and what it was trained with, as one new version and point the champion alias at it."""
    rows = sorted((key, str(value)) for key, value in (parameters or {}).items())
    parts = {**parts, "parameters": lake.spark.createDataFrame(rows, "name string, value string")}
    versions = lake.publish({(LAYER, f"{name}.{part}"): df for part, df in parts.items()})
    return str(max(versions.values()))


def champion(lake: Lake, name: str, *parts: str) -> tuple[dict[str, DataFrame], str] | None:
    """(parts, version) of the champion, or None before the first training."""
    versions = [lake.version(LAYER, f"{name}.{part}") for part in parts]
    if None in versions:
        return None
    return {part: lake.read(LAYER, f"{name}.{part}") for part in parts}, str(max(versions))
