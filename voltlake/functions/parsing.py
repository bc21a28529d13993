"""Lenient parsing of text columns. Every function maps a bad value to null and stays JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accepted number, date and instant layouts. A shape is tested before the cast, because a
# failed cast costs far more than a pattern match and because Spark reads more than these (12.5d, NaN, 2024).
NUMBER = r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^[+-]?inf(inity)?$"
WHOLE_NUMBER = r"^[+-]?\d+(\.0*)?$"
DATE = r"^(\d{4}([-/])\d{1,2}\2\d{1,2}|\d{1,2}([-/])\d{1,2}\3\d{4})$"
DATE_WITH_TIME = r"^(\d{4}([-/])\d{1,2}\2\d{1,2}|\d{1,2}([-/])\d{1,2}\3\d{4})[T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?\s*([+-]\d{2}:?\d{2}|Z)?$"
INSTANT = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}(:\d{1,2}(:\d{1,2}(\.\d+)?)?)?\s*([+-]\d{2}:?\d{2}|Z)?)?$"
COMPACT_INSTANT = r"^(\d{4})(\d{2})(\d{2})([T ](\d{2})(\d{2})(\d{2})?(\.\d+)?([+-]\d{2}:?\d{2}|Z)?)?$"


def add_parsed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df.withColumns(columns)` for costly expressions that later filters test.

    A filter on a plain computed column is moved below it and computes the expression a second time; it
    is not moved below a generator, so the row is unfolded from a one-element array here. Generators are evaluated
    without generated code; where no filter follows, plain columns cost half as much.
    """
    struct = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select("*", F.inline(F.array(struct)))


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column; nulls stay null."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({name: F.trim(F.col(name)) for name in text}) if text else df


def lenient_double(c: Column) -> Column:
    """Number or null. Java type suffixes ("12.5d") and NaN are not numbers here."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def lenient_int(c: Column) -> Column:
    """Whole number or null; "7.0" reads as 7."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(WHOLE_NUMBER), text.try_cast("double").try_cast("int"))


def decimal_comma_double(c: Column) -> Column:
    return lenient_double(F.replace(c, F.lit(","), F.lit(".")))


def lenient_boolean(c: Column) -> Column:
    """Null is false; text is compared with "true" ignoring case and outer blanks."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))) == "true", F.lit(False))


def to_utc_ntz(c: Column) -> Column:
    """Zoned timestamp to UTC wall clock (the session runs in UTC)."""
    return c.cast("timestamp_ntz")


def offset_timestamp(c: Column, floor_to_ms: bool = False) -> Column:
    """Text with a UTC offset to naive UTC; text without one is taken as UTC."""
    parsed = F.trim(c).try_cast("timestamp")
    if floor_to_ms:
        parsed = F.date_trunc("MILLISECOND", parsed)
    return to_utc_ntz(parsed)


def multi_format_timestamp(c: Column) -> Column:
    """Date and time with "T" or a blank between them; seconds, fraction and offset optional.

    Parts may lack leading zeros, fractions beyond microseconds are cut, and the compact form without marks is read.
    """
    text = F.trim(c)
    compact = F.regexp_replace(text, COMPACT_INSTANT, "$1-$2-$3T$5:$6:$7$8$9")
    compact = F.regexp_replace(F.regexp_replace(compact, r"T::$", ""), r":(?=$|[+-]|Z)", "")
    spread = F.when(text.rlike(COMPACT_INSTANT), compact).otherwise(text)
    shown = F.regexp_replace(F.regexp_replace(spread, r"(\.\d{6})\d+", "$1"), r"\s+([+-]|Z)", "$1")
    shown = F.regexp_replace(shown, r"^(\S+[T ]\d{1,2}:\d{1,2})([+-]|Z)", "$1:00$2")  # an offset is read after seconds only
    return to_utc_ntz(F.when(text.rlike(INSTANT) | text.rlike(COMPACT_INSTANT), shown.try_cast("timestamp")))


def multi_format_date(c: Column) -> Column:
    """Year-month-day or day-month-year, with dashes or slashes; a time of day after it is left out."""
    text = F.trim(c)
    day_only = F.when(text.rlike(DATE_WITH_TIME), F.regexp_extract(text, r"^[^T ]+", 0)).otherwise(text)
    dashed = F.translate(day_only, "/", "-")
    day, year = F.substring_index(dashed, "-", 1), F.substring_index(dashed, "-", -1)
    month = F.substring_index(F.substring_index(dashed, "-", 2), "-", -1)
    iso = F.when(F.length(day) == 4, dashed).otherwise(F.concat_ws("-", year, month, day))
    general = F.when(day_only.rlike(DATE), iso.try_cast("date"))
    # The two layouts of ten characters need no pattern: what isn't a date in them doesn't cast.
    part = lambda at, n: F.substring(text, at, n)
    parted = lambda a, b: part(a, 1).isin("/", "-") & (part(a, 1) == part(b, 1))
    year_first = F.concat_ws("-", part(1, 4), part(6, 2), part(9, 2)).try_cast("date")
    day_first = F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)).try_cast("date")
    ten = F.length(text) == 10
    return F.when(ten & parted(3, 6), day_first).when(ten & parted(5, 8), year_first).otherwise(general)


def query_layer_timestamp(c: Column) -> Column:
    """Timestamp text as printed by a SQL client: " UTC", "Z" or an offset at the end, optional fraction."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\s*(UTC|Z)$", "")
    zoned = F.when(text.rlike(r"[+-]\d{2}:?\d{2}$"), text).otherwise(F.concat(text, F.lit("+00:00")))
    return to_utc_ntz(zoned.try_cast("timestamp"))


def market_hour_timestamp(day: Column, hour: Column, convention: str) -> Column:
    """Start of a market hour. Convention "v1": hour 1 is 00:00; "v2": hour 1 is 01:00. Outside 1..25 is null."""
    shift = {"v1": 1, "v2": 0}[convention]
    start = day.cast("timestamp_ntz") + F.make_dt_interval(hours=(hour - shift).cast("int"))
    return F.when(hour.between(1, 25), start)


def local_to_utc(local: Column, zone: str) -> Column:
    """Naive local time to naive UTC; null where the clock skips or repeats that time.

    Spark picks an offset silently. A skipped time does not survive the round trip; a repeated one is
    shown again by the instant one hour earlier or later.
    """
    wall, hour = local.cast("timestamp"), F.expr("INTERVAL '1' HOUR")  # the session runs in UTC: the same clock
    utc = F.to_utc_timestamp(wall, zone)

    def shows_wall(instant: Column) -> Column:
        return F.from_utc_timestamp(instant, zone) == wall

    return F.when(shows_wall(utc) & ~(shows_wall(utc - hour) | shows_wall(utc + hour)), utc).cast("timestamp_ntz")


def delivery_hour_to_utc(day: Column, hour: Column, zone: str, dst: str = "null") -> Column:
    """Local delivery date and market hour to UTC, wall clock `day + (hour - 1)` in `zone`.

    `dst="null"` leaves skipped and repeated local times null. `dst="fold"` counts the hours from local
    midnight instead, so a 25-hour day has 25 distinct instants.
    """
    if dst == "fold":
        midnight = F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))
        return F.when(hour.between(1, 25), midnight + F.make_dt_interval(hours=(hour - 1).cast("int")))
    if dst != "null":
        raise ValueError(f"unknown dst rule: {dst}")
    local = day.cast("timestamp_ntz") + F.make_dt_interval(hours=(hour - 1).cast("int"))
    return local_to_utc(local, zone)


def first_present(df: DataFrame, aliases: Sequence[str], default: object | None = None) -> Column:
    """First non-null of those `aliases` that exist as columns, else `default`."""
    found = [F.col(name) for name in aliases if name in df.columns]
    return F.coalesce(*found, F.lit(default)) if found else F.lit(default)


def finite_or_zero(c: Column) -> Column:
    """Number with null, unparsable and non-finite values replaced by 0."""
    value = lenient_double(c)
    return F.when(F.abs(value) < F.lit(float("inf")), value).otherwise(F.lit(0.0))
