"""Epoch seconds and calendar parts (survey D1-D7).

Everything here is independent of ``spark.sql.session.timeZone``: epochs are
read as UTC and split with integer arithmetic on days, so results do not move
when a cluster runs in another zone.
"""

from __future__ import annotations

import calendar
import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400


def epoch_seconds_of_ntz(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 of a zone-less (TIMESTAMP_NTZ) value."""
    return (F.unix_date(F.to_date(ts)).cast("long") * SECONDS_PER_DAY
            + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))


def epoch_of(year: int, month: int, day: int, hour: int = 0, minute: int = 0) -> int:
    """Calendar date (UTC) -> epoch seconds, computed once on the driver."""
    return calendar.timegm((year, month, day, hour, minute, 0, 0, 0, 0))


def epoch_of_col(year: Column, month: Column, day: Column) -> Column:
    """Column form of D7 for dates held in columns."""
    return F.unix_seconds(F.make_timestamp(year, month, day, F.lit(0), F.lit(0),
                                           F.lit(0), F.lit("UTC")))


def ntz_literal(epoch: int) -> Column:
    """Epoch seconds -> TIMESTAMP_NTZ literal, so range filters reach the parquet scan."""
    text = _dt.datetime.fromtimestamp(epoch, _dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def time_parts(epoch: Column) -> dict[str, Column]:
    """hour, ISO weekday (Mon=1..Sun=7), day of month, month, year of epoch seconds."""
    days = F.floor(epoch / SECONDS_PER_DAY)
    date = F.date_from_unix_date(days.cast("int"))
    return {
        "hour": F.floor((epoch - days * SECONDS_PER_DAY) / 3600).cast("int"),
        "dayofweek": (F.weekday(date) + 1).cast("int"),
        "day": F.dayofmonth(date),
        "month": F.month(date),
        "year": F.year(date),
    }
