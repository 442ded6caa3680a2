"""What a run knows about itself. Time is injected so that a retried stage writes the same rows."""

from __future__ import annotations

import os
from collections import ChainMap
from collections.abc import Mapping
from dataclasses import dataclass, fields
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.times import GULF_HOURS, date_lit, ts_lit


def clock() -> datetime:
    """The UTC wall clock now."""
    return datetime.now(UTC).replace(tzinfo=None)


@dataclass(frozen=True)
class RunContext:
    run_id: str
    now: datetime
    business_date: date
    cadence_seconds: int = 300
    started_at: datetime | None = None

    @property
    def run_col(self) -> Column:
        return F.lit(self.run_id)

    @property
    def now_col(self) -> Column:
        return ts_lit(self.now)

    @property
    def started_col(self) -> Column:
        return ts_lit(self.started_at or self.now)

    @property
    def as_of(self) -> Column:
        return date_lit(self.business_date)


@dataclass(frozen=True)
class Settings:
    """Job settings; an empty value counts as unset."""

    lake_root: str = "lake"
    landing_dir: str = "landing"
    table_format: str = "parquet"
    source: str = "files"  # files | kafka
    kafka_servers: str | None = None
    kafka_topic: str = "ledger-events"
    kafka_connection_string: str | None = None
    jdbc_url: str | None = None
    cadence_seconds: int = 300
    max_files_per_batch: int = 1_000  # a long backlog is drained in several micro-batches
    max_records_per_batch: int = 50_000_000
    as_of: date | None = None
    ml_seed: int = 42
    n_trees: int = 300

    @classmethod
    def read(cls, given: Mapping[str, str] | None = None, environment: Mapping[str, str] | None = None) -> Settings:
        """Settings by upper-case name, from `given` before the environment; empty text leaves the default."""
        texts = ChainMap(dict(given or {}), dict(os.environ if environment is None else environment))
        named = ((f, texts.get(f.name.upper(), "")) for f in fields(cls))
        return cls(**{f.name: _value(f.name, f.default, text) for f, text in named if text})

    def day(self, at: datetime) -> date:
        """The business date of a moment: the fixed one if there is one, else its Gulf date."""
        return self.as_of if self.as_of is not None else (at + timedelta(hours=GULF_HOURS)).date()

    def context(self, run_id: str, now: datetime | None = None, started_at: datetime | None = None) -> RunContext:
        """What a run that is at `now` (else the clock) and began at `started_at` (else now) knows of itself."""
        at = clock() if now is None else now
        began = at if started_at is None else started_at
        return RunContext(run_id, at, self.day(began), self.cadence_seconds, began)


def _value(name: str, default: object, text: str) -> object:
    if name == "as_of":
        return date.fromisoformat(text)
    return int(text) if isinstance(default, int) else text
