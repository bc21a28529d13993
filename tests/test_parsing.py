import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from voltlake.functions import parsing as P


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "text,number",
    [("1.5", 1.5), (" -2 ", -2.0), ("1e3", 1000.0), (".5", 0.5), ("", None), ("n/d", None), ("12.5d", None), ("nan", None),
     ("inf", float("inf")), (None, None)],
)
def test_lenient_double(spark, text, number):
    assert one(spark, P.lenient_double, text) == number


@pytest.mark.parametrize("text,number", [("7", 7), ("7.0", 7), ("7.5", None), ("x", None), (None, None)])
def test_lenient_int(spark, text, number):
    assert one(spark, P.lenient_int, text) == number


def test_decimal_comma(spark):
    assert one(spark, P.decimal_comma_double, " 12,75") == 12.75


@pytest.mark.parametrize(
    "text,day",
    [("2024-01-31", date(2024, 1, 31)), ("31/01/2024", date(2024, 1, 31)), ("1-2-2024", date(2024, 2, 1)),
     ("2024/01/31", date(2024, 1, 31)), ("2024/01-31", None), ("31-13-2024", None), ("2024", None), ("", None)],
)
def test_multi_format_date(spark, text, day):
    assert one(spark, P.multi_format_date, text) == day


@pytest.mark.parametrize(
    "text,at",
    [("2024-01-31T10:15:30", datetime(2024, 1, 31, 10, 15, 30)), ("2024-01-31 10:15", datetime(2024, 1, 31, 10, 15)),
     ("2024-01-31T10:15:00+02:00", datetime(2024, 1, 31, 8, 15)), ("2024-01-31", datetime(2024, 1, 31)), ("31/01/2024", None)],
)
def test_multi_format_timestamp(spark, text, at):
    assert one(spark, P.multi_format_timestamp, text) == at


@pytest.mark.parametrize(
    "text",
    ["2024-01-31 10:00:00.000 UTC", "2024-01-31T10:00:00Z", "2024-01-31 10:00:00", "2024-01-31 11:00:00+01:00"],
)
def test_query_layer_timestamp(spark, text):
    assert one(spark, P.query_layer_timestamp, text) == datetime(2024, 1, 31, 10)


def test_offset_timestamp_floors_to_milliseconds(spark):
    text = "2024-01-31T10:00:00.123999+01:00"
    assert one(spark, lambda c: P.offset_timestamp(c, floor_to_ms=True), text) == datetime(2024, 1, 31, 9, 0, 0, 123000)
    assert one(spark, P.offset_timestamp, "lixo") is None


def utc_of(spark, day, hour, dst="null"):
    df = spark.createDataFrame([(day, hour)], "d date, h int")
    return df.select(P.delivery_hour_to_utc(F.col("d"), F.col("h"), "Europe/Lisbon", dst)).first()[0]


def test_skipped_local_hour_is_null(spark):
    day = date(2024, 3, 31)
    assert utc_of(spark, day, 1) == datetime(2024, 3, 31, 0)
    assert utc_of(spark, day, 2) is None
    assert utc_of(spark, day, 3) == datetime(2024, 3, 31, 1)


def test_repeated_local_hour_is_null(spark):
    day = date(2024, 10, 27)
    assert utc_of(spark, day, 1) == datetime(2024, 10, 26, 23)
    assert utc_of(spark, day, 2) is None
    assert utc_of(spark, day, 3) == datetime(2024, 10, 27, 2)


def test_hour_25_collides_with_the_next_day_unless_folded(spark):
    day, after = date(2024, 10, 27), date(2024, 10, 28)
    assert utc_of(spark, day, 25) == utc_of(spark, after, 1) == datetime(2024, 10, 28, 0)
    folded = [utc_of(spark, day, h, "fold") for h in range(1, 26)]
    assert len(set(folded)) == 25
    assert folded[0] == datetime(2024, 10, 26, 23) and folded[-1] == datetime(2024, 10, 27, 23)


def test_market_hour_conventions(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), h) for h in (0, 1, 24, 25, 26)], "d date, h int")
    rows = df.select(*[P.market_hour_timestamp(F.col("d"), F.col("h"), c).alias(c) for c in ("v1", "v2")]).collect()
    assert [r.v1 for r in rows] == [None, datetime(2024, 1, 1), datetime(2024, 1, 1, 23), datetime(2024, 1, 2), None]
    assert [r.v2 for r in rows] == [None, datetime(2024, 1, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 2, 1), None]


def test_aliases_and_non_finite(spark):
    df = spark.createDataFrame([(None, 5.0), (float("inf"), 6.0)], "b double, c double")
    picked = df.select(P.finite_or_zero(P.first_present(df, ["a", "b", "c"])).alias("x"), P.first_present(df, ["z"], "—").alias("y"))
    assert [tuple(r) for r in picked.collect()] == [(5.0, "—"), (0.0, "—")]


def test_dates_of_ten_characters_read_as_the_general_layout(spark):
    rng = random.Random(4)
    texts = ["2024-02-30", "30/02/2024", "29/02/2024", "2024/02/29", "12/12-2024", "20a4-01-01", "+024-01-01", "12/ 1/2024", "2024 -01-1", " 05/06/2024 ", "12-13-2024", "1-1-2024", "2024-2-9", None, ""]
    texts += ["".join(rng.choice("0123//--") for _ in range(10)) for _ in range(3000)]
    texts += [f"{rng.randrange(40):02d}{c}{rng.randrange(14):02d}{c}{rng.randrange(10000):04d}" for c in "/-" for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", P.multi_format_date(F.col("x")).alias("d")).collect()
    for r in got:
        want = None
        found = re.fullmatch(r"(\d{4})([-/])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/])(\d{1,2})\6(\d{4})", (r.x or "").strip())
        if found:
            y, _, m, d, d2, _, m2, y2 = found.groups()
            try:
                want = date(int(y or y2), int(m or m2), int(d or d2))
            except ValueError:
                continue  # no such day, or the year 0, which Python can't hold
        assert r.d == want or (want is None and r.d is None), r
