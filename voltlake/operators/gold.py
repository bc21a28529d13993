"""Hourly gold tables: energy balance, market, load features, cost, weather features, trend."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import measures as M
from ..functions import parsing as P
from ..functions.calendar import calendar_columns, hour_bucket, trunc_ntz
from ..sources.readers import source_position
from .ranking import last_write_wins
from .timeline import add_lead, bucket_window, main_rows, rolling_mean_columns, with_halo

PRODUCTION_MEASURES = ("producao_total_kwh", "producao_dgm_kwh", "producao_pre_kwh")


def hourly_sum(
    df: DataFrame, measures: Sequence[str], ts: str = "timestamp_utc", series: Sequence[str] = ()
) -> DataFrame:
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(*series, hour_bucket(F.col(ts)).alias(ts))
        .agg(*[F.sum(m).alias(m) for m in measures])
    )


def full_outer_on_hour(
    consumption: DataFrame, production: DataFrame, key: str = "timestamp_utc", series: Sequence[str] = ()
) -> DataFrame:
    """Full outer join of two hourly tables on the coalesced key, with `flag_missing_source`."""
    c = consumption.withColumn("_c", F.lit(True))
    p = production.withColumn("_p", F.lit(True))
    joined = c.join(p, [*series, key], "full_outer")
    return joined.withColumn("flag_missing_source", F.col("_c").isNull() | F.col("_p").isNull()).drop("_c", "_p")


def gold_balance_hourly(
    consumption: DataFrame, production: DataFrame, series: Sequence[str] = (), origin: bool = False
) -> DataFrame:
    """Hourly balance of 15-minute consumption and production, hours of either side kept.

    Both sides are summed to the hour under the same key, so they are stacked and aggregated once:
    one map-side combine and one shuffle instead of two aggregates, an outer join and its sorts.
    """
    ts = "timestamp_utc"
    stacked = consumption.select(
        *series, ts, F.col("consumo_total_kwh"), F.lit(1).alias("_c"), F.lit(0).alias("_p")
    ).unionByName(
        production.select(*series, ts, *PRODUCTION_MEASURES, F.lit(0).alias("_c"), F.lit(1).alias("_p")),
        allowMissingColumns=True,
    )
    hourly = (
        stacked.where(F.col(ts).isNotNull())
        .groupBy(*series, hour_bucket(F.col(ts)).alias(ts))
        .agg(
            F.sum("consumo_total_kwh").alias("consumo_total_kwh"),
            *[F.sum(m).alias(m) for m in PRODUCTION_MEASURES],
            (F.least(F.max("_c"), F.max("_p")) == 0).alias("flag_missing_source"),
        )
    )
    balance = M.balance_columns(F.col("consumo_total_kwh"), F.col("producao_total_kwh"))
    return hourly.select(
        *series,
        ts,
        "consumo_total_kwh",
        *PRODUCTION_MEASURES,
        *[expr.alias(name) for name, expr in balance.items()],
        "flag_missing_source",
        *([F.lit("observed").alias("origin")] if origin else []),
    )


def join_on_hour(left: DataFrame, right: DataFrame, key: str = "timestamp_utc", series: Sequence[str] = ()) -> DataFrame:
    """Inner join on the hour."""
    return left.join(right, [*series, key], "inner")


MARKET_LAG_HOURS = 24


def gold_market_hourly(
    consumption: DataFrame, price: DataFrame, process_date: str, series: Sequence[str] = ()
) -> DataFrame:
    """Consumption and price of the hours both have, with calendar, lags and 24-hour means.

    One halo of 24 rows per month bucket serves the lags and the means.
    """
    ts = "timestamp_utc"
    joined = join_on_hour(
        consumption.select(*series, ts, "consumo_total"), price.select(*series, ts, "market_price_pt"), ts, series
    )
    measures = ["consumo_total", "market_price_pt"]
    halo = with_halo(joined, measures, series, ts, before=MARKET_LAG_HOURS)
    w = bucket_window(series, F.unix_seconds(F.col(ts).cast("timestamp")))
    derived = {
        "consumo_lag_1h": F.lag("consumo_total", 1).over(w),
        "consumo_lag_24h": F.lag("consumo_total", 24).over(w),
        "price_lag_1h": F.lag("market_price_pt", 1).over(w),
    } | rolling_mean_columns(
        series,
        ts,
        {"rolling_avg_consumo_24h": "consumo_total", "rolling_avg_price_24h": "market_price_pt"},
        MARKET_LAG_HOURS,
    )
    rows = main_rows(halo.withColumns(derived))
    return rows.select(
        *series,
        ts,
        *[e.alias(c) for c, e in calendar_columns(F.col(ts)).items()],
        *measures,
        *derived,
        F.lit(process_date).cast("date").alias("process_date"),
    )


LOAD_FEATURES = (
    "consumo_total",
    "market_price_pt",
    "hour",
    "day_of_week",
    "is_weekend",
    "consumo_lag_1h",
    "consumo_lag_24h",
    "price_lag_1h",
    "rolling_avg_consumo_24h",
    "rolling_avg_price_24h",
)


def gold_load_features_hourly(market: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Training rows for next-hour consumption; rows with any null feature or no target are removed."""
    led = add_lead(
        market.select(*series, "timestamp_utc", *LOAD_FEATURES, "process_date"), "consumo_total", "consumo_next_hour",
        series=series,
    )
    return led.select(*series, "timestamp_utc", *LOAD_FEATURES, "consumo_next_hour", "process_date").dropna(
        subset=[*LOAD_FEATURES, "consumo_next_hour"]
    )


# Names recorded for the two hour conventions.
PARSER_NAMES = {"v1": "v1_hour_minus_1", "v2": "v2_hour_direct"}


def cost_consumption_hourly(readings: DataFrame, factor: float = 0.25) -> DataFrame:
    """Hourly energy from text readings `datahora`, `total`; rows that do not parse are skipped."""
    parsed = P.add_parsed(
        readings.select("datahora", "total"),
        {"_ts": P.multi_format_timestamp(F.col("datahora")), "_v": P.decimal_comma_double(F.col("total"))},
    ).where(F.col("_ts").isNotNull() & F.col("_v").isNotNull())
    return parsed.groupBy(hour_bucket(F.col("_ts")).alias("timestamp_utc")).agg(
        F.sum(F.col("_v") * factor).alias("consumo_mwh")
    )


def _priced_rows(raw_price: DataFrame) -> DataFrame:
    """Parsed price rows with a readable hour and price, placed by the first convention as `_v1`."""
    parsed = P.add_parsed(
        raw_price.select("date", "hour", "portugal", source_position(raw_price).alias("row_pos")),
        {
            "delivery_date_local": P.multi_format_date(F.col("date")),
            "market_hour": P.lenient_int(F.col("hour")),
            "preco_eur_mwh": P.decimal_comma_double(F.col("portugal")),
        },
    )
    instant = P.market_hour_timestamp(F.col("delivery_date_local"), F.col("market_hour"), "v1")
    return parsed.withColumn("_v1", instant).where(F.col("_v1").isNotNull() & F.col("preco_eur_mwh").isNotNull())


def _placed(convention: str) -> Column:
    return P.market_hour_timestamp(F.col("delivery_date_local"), F.col("market_hour"), convention)


def price_candidates(raw_price: DataFrame, conventions: Sequence[str] = ("v1", "v2")) -> DataFrame:
    """Hourly price per hour convention; of several rows for one hour the last in the source wins.

    The conventions differ by a constant shift, so two rows collide under one exactly if they collide
    under the other: the winners are found once and then placed under every convention.
    """
    values = ["preco_eur_mwh", "delivery_date_local", "market_hour"]
    winners = last_write_wins(_priced_rows(raw_price), ["_v1"], values, "row_pos")
    placed = [F.struct(F.lit(c).alias("convention"), _placed(c).alias("timestamp_utc")) for c in conventions]
    unfolded = winners.select(*values, F.explode(F.array(*placed)).alias("_c"))
    return unfolded.select("_c.*", *values)


#: Hours from the year 0001 to 1970, so that hour numbers count from 1 on.
_BEFORE_EPOCH = 24 * 719162 + 1


def hour_bitmaps(df: DataFrame, sets: Mapping[str, Column]) -> DataFrame:
    """Exact bitmaps of the whole hours each instant column holds: one row (set, bucket, hours) per 32,768 hours.

    Repeated hours cost a bit. Tasks build their bitmaps before the shuffle, so what travels has a fixed size per
    bucket and task whatever the number of rows.
    """
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("set"), c.alias("ts")) for n, c in sets.items()])).alias("_s")
    hours = df.select(named).select("_s.*").where(F.col("ts").isNotNull() & (F.col("ts") == hour_bucket(F.col("ts"))))
    number = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) + F.lit(_BEFORE_EPOCH)
    hours = hours.select("set", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"))
    return hours.groupBy("set", "bucket").agg(F.bitmap_construct_agg("bit").alias("hours"))


def convention_overlap(raw_price: DataFrame, consumption: DataFrame) -> DataFrame:
    """One row: hours each convention shares with consumption and the chosen one, "v2" only if strictly better.

    Hours meet as bitmaps, so the prices are neither picked nor joined to be counted.
    """
    price = hour_bitmaps(_priced_rows(raw_price), {c: _placed(c) for c in PARSER_NAMES})
    used = hour_bitmaps(consumption, {"used": F.col("timestamp_utc")})
    # Every convention meets the hours of consumption: two bitmaps a bucket if both have hours there.
    used = used.select(F.explode(F.array(*map(F.lit, PARSER_NAMES))).alias("set"), "bucket", "hours")
    met = price.unionByName(used).groupBy("set", "bucket").agg(F.count(F.lit(1)).alias("sides"), F.bitmap_and_agg("hours").alias("hours"))
    met = met.where("sides = 2").select("set", F.bitmap_count("hours").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(F.col("set") == c, F.col("n"))), F.lit(0).cast("bigint"))
    counts = met.agg(*[total(c).alias(f"intersection_{c}") for c in PARSER_NAMES])
    return counts.withColumn("convention", F.when(F.col("intersection_v2") > F.col("intersection_v1"), "v2").otherwise("v1"))


def gold_cost_hourly(
    consumption: DataFrame, raw_price: DataFrame, convention: str = "auto"
) -> DataFrame:
    """Hourly consumption × price for the hours both have.

    `raw_price` has text columns `date`, `hour`, `portugal` and its rows' positions. "auto" takes the hour
    convention with the larger overlap, which is counted and chosen before anything is joined.
    """
    hours = consumption.select("timestamp_utc", "consumo_mwh")
    if convention == "auto":
        convention = convention_overlap(raw_price, hours).first()["convention"]  # one row
    joined = join_on_hour(hours, price_candidates(raw_price, [convention]))
    return joined.select(
        "timestamp_utc",
        "consumo_mwh",
        "preco_eur_mwh",
        (F.col("consumo_mwh") * F.col("preco_eur_mwh")).alias("custo_estimado_eur"),
        "delivery_date_local",
        "market_hour",
        F.lit(PARSER_NAMES[convention]).alias("price_parser_version"),
    )


def serving_hourly(df: DataFrame, value: str, out: str, ts: str = "datahora", position: str | None = None) -> DataFrame:
    """Hourly table read for serving: null measure as 0, instant bucketed, the last row of an hour wins."""
    rows = df.where(F.col(ts).isNotNull()).select(
        hour_bucket(F.col(ts)).alias("timestamp_utc"),
        F.coalesce(F.col(value), F.lit(0.0)).alias(out),
        F.col(position or ts).alias("_pos"),
    )
    return last_write_wins(rows, ["timestamp_utc"], [out], "_pos")


def weather_daily(weather: DataFrame, ts: str = "ts", min_observations: int = 24) -> DataFrame:
    """Daily weather features of the days with enough hourly observations."""
    return (
        weather.groupBy(F.to_date(ts).alias("date_utc"))
        .agg(
            F.avg("temp_c").alias("temp_mean_c"),
            F.max("temp_c").alias("temp_max_c"),
            F.min("temp_c").alias("temp_min_c"),
            F.sum("precip_mm").alias("precip_total_mm"),
            F.avg("wind_kmh").alias("wind_mean_kmh"),
            F.max("wind_kmh").alias("wind_max_kmh"),
            F.sum("shortwave_radiation").alias("shortwave_radiation_sum"),
            F.count(F.lit(1)).alias("_observations"),
        )
        .where(F.col("_observations") >= min_observations)
        .drop("_observations")
    )


def weather_daily_features(
    weather: DataFrame, production: DataFrame, version: str, ts: str = "ts", min_observations: int = 24
) -> DataFrame:
    """Daily weather joined to the daily production of a gold balance table, in MWh."""
    daily = production.groupBy(F.to_date("timestamp_utc").alias("date_utc")).agg(
        (F.sum("producao_total_kwh") / 1000.0).alias("producao_total_mwh"),
        (F.sum("producao_pre_kwh") / 1000.0).alias("producao_pre_mwh"),
        (F.sum("producao_dgm_kwh") / 1000.0).alias("producao_dgm_mwh"),
    )
    return (
        weather_daily(weather, ts, min_observations)
        .join(daily.where(F.col("producao_total_mwh").isNotNull()), "date_utc")
        .withColumn("feature_set_version", F.lit(version))
    )


def imbalance_trend(gold: DataFrame, grain: str = "month", ts: str = "timestamp_utc") -> DataFrame:
    """Balance per period, its change from the period before, and the slope over all periods.

    The two windows run over one row per period.
    """
    periods = (
        gold.where(F.col(ts).isNotNull())
        .groupBy(trunc_ntz(grain, F.col(ts)).alias("periodo_inicio"))
        .agg(F.sum("saldo_kwh").alias("saldo_kwh"), F.count_if(F.col("flag_defice")).alias("horas_defice"))
    )
    in_order = W.orderBy("periodo_inicio")
    indexed = periods.withColumns(
        {
            "_n": F.row_number().over(in_order).cast("double"),
            "saldo_anterior_kwh": F.lag("saldo_kwh", 1).over(in_order),
        }
    )
    return indexed.select(
        "periodo_inicio",
        "saldo_kwh",
        "horas_defice",
        (F.col("saldo_kwh") - F.col("saldo_anterior_kwh")).alias("variacao_saldo_kwh"),
        F.regr_slope("saldo_kwh", "_n").over(W.partitionBy()).alias("declive_saldo_kwh"),
    )
