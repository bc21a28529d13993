"""Time buckets and calendar columns on `timestamp_ntz` values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text layout of a rollup period.
PERIOD_FORMATS = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}


def trunc_ntz(unit: str, ts: Column) -> Column:
    """`date_trunc` that keeps the naive type (Spark returns a zoned one)."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def hour_bucket(ts: Column) -> Column:
    return trunc_ntz("hour", ts)


def add_hours(ts: Column, hours: Column | int) -> Column:
    n = F.lit(hours) if isinstance(hours, int) else hours
    return ts + F.make_dt_interval(hours=n.cast("int"))


def hours_between(lo: Column, hi: Column) -> Column:
    """Whole hours from `lo` to `hi`."""
    return F.timestamp_diff("HOUR", lo, hi)


def period_key(ts: Column, grain: str) -> Column:
    return F.date_format(ts, PERIOD_FORMATS[grain])


def calendar_columns(ts: Column) -> dict[str, Column]:
    """date, year, month, day, hour, ISO day_of_week (Monday 1) and is_weekend."""
    iso_day = F.weekday(ts) + 1
    return {
        "date": F.to_date(ts),
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "day_of_week": iso_day,
        "is_weekend": iso_day >= 6,
    }


def training_calendar(ts: Column) -> dict[str, Column]:
    """hour, day_of_week (Monday 0) and month, as the training set numbers them."""
    return {"hour": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts)}
