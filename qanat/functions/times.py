"""Time expressions. Timestamps are `timestamp_ntz` holding UTC; business dates are Gulf (UTC+4) dates."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

GULF_HOURS = 4
EPOCH = datetime(1970, 1, 1)


def ts_lit(value: datetime) -> Column:
    """A naive UTC datetime as a timestamp_ntz literal."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def date_lit(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")


def parse_ts(text: Column) -> Column:
    """ISO-8601 text to a UTC wall clock, whatever the session's zone; text that is no timestamp gives NULL.

    Text with a zone is an instant, counted from the epoch; text without one is UTC already."""
    clock = F.instr(text, ":")
    zoned = (clock > 0) & F.substring(text, clock, F.lit(60)).rlike("[A-Za-z+-]")  # letters and signs after the hour are a zone's
    instant = F.timestamp_add("MICROSECOND", F.unix_micros(text.try_cast("timestamp")), ts_lit(EPOCH))
    return F.when(zoned, instant).otherwise(text.try_cast("timestamp_ntz"))


def parse_date(text: Column) -> Column:
    return text.try_cast("date")


def gulf(ts: Column) -> Column:
    return ts + F.expr(f"INTERVAL {GULF_HOURS} HOURS")


def gulf_date(ts: Column) -> Column:
    return F.to_date(gulf(ts))


def gulf_hour(ts: Column) -> Column:
    return F.hour(gulf(ts))


def gulf_day_of_week(ts: Column) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(gulf(ts))


def gulf_weekend(ts: Column) -> Column:
    return F.dayofweek(gulf(ts)).isin(1, 7)


def weekday(day: Column) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(day)


def weekday_clock(ts: Column) -> Column:
    """`Saturday 02:00` in Gulf time."""
    return F.date_format(gulf(ts), "EEEE HH:mm")


def business_day(day: Column) -> Column:
    """Roll Saturday and Sunday forward to Monday."""
    return F.when(F.weekday(day) >= 5, F.date_add(day, 7 - F.weekday(day))).otherwise(day)


def next_payroll_thursday(as_of: Column) -> Column:
    """The first Thursday at least three days after `as_of`."""
    return F.next_day(F.date_add(as_of, 2), "THU")


def iso_ts(ts: Column) -> Column:
    """ISO text; the fraction appears only when there is one, always as six digits."""
    micros = F.date_format(ts, "SSSSSS")
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def next_batch_at(started_at: Column, finished_at: Column, cadence_seconds: int) -> Column:
    """When the next batch is due: a cadence after this one's start, or at its end if it took longer."""
    return F.greatest(started_at + F.expr(f"INTERVAL {int(cadence_seconds)} SECONDS"), finished_at)


def time_block(ts: Column, seconds: int) -> Column:
    """Number of the slice of so many seconds that a wall clock falls in; it never decreases as the clock moves on.

    Read off the clock itself, so that the session's zone and its changes play no part."""
    passed = F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.floor(F.second(ts))
    return F.floor(passed / F.lit(int(seconds)))
