"""The driver tables read as energy data, in Spark and, under the same names, as SQL text."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import hour_bucket
from ..operators import gold as G
from .registry import Tables

SERIES = ["series"]


def consumption(t: Tables) -> DataFrame:
    e = t.events.where("event_type = 'view'")
    return e.select(
        (F.col("user_id") % 10).alias("series"), F.col("ts").alias("timestamp_utc"), F.col("value").alias("consumo_total_kwh")
    )


def production(t: Tables) -> DataFrame:
    e = t.events.where("event_type IN ('purchase', 'signup')")
    return e.select(
        (F.col("user_id") % 10).alias("series"),
        F.col("ts").alias("timestamp_utc"),
        F.col("value").alias("producao_total_kwh"),
        F.expr("CASE WHEN event_type = 'signup' THEN value END").alias("producao_dgm_kwh"),
        F.expr("CASE WHEN event_type = 'purchase' THEN value END").alias("producao_pre_kwh"),
    )


def balance(t: Tables) -> DataFrame:
    return G.gold_balance_hourly(consumption(t), production(t))


def balance_by_series(t: Tables) -> DataFrame:
    return G.gold_balance_hourly(consumption(t), production(t), SERIES)


def _balance_sql(series: bool) -> str:
    key, on, pick = (
        ("user_id % 10 AS series, ", " AND c.series = p.series", "coalesce(c.series, p.series) AS series, ")
        if series
        else ("", "", "")
    )
    by = "GROUP BY ALL"
    name = "gold_s" if series else "gold"
    return f"""
{name}_c AS (SELECT {key}date_trunc('hour', ts) AS h, sum(value) AS v FROM events WHERE event_type = 'view' {by}),
{name}_p AS (
  SELECT {key}date_trunc('hour', ts) AS h, sum(value) AS v,
         sum(CASE WHEN event_type = 'signup' THEN value END) AS dgm,
         sum(CASE WHEN event_type = 'purchase' THEN value END) AS pre
  FROM events WHERE event_type IN ('purchase', 'signup') {by}),
{name} AS (
  SELECT {pick}coalesce(c.h, p.h) AS timestamp_utc, c.v AS consumo_total_kwh, p.v AS producao_total_kwh,
         p.dgm AS producao_dgm_kwh, p.pre AS producao_pre_kwh, p.v - c.v AS saldo_kwh,
         CASE WHEN c.v <> 0 THEN p.v / c.v END AS ratio_producao_consumo,
         coalesce(p.v < c.v, false) AS flag_defice, coalesce(p.v > c.v, false) AS flag_excedente,
         (c.h IS NULL OR p.h IS NULL) AS flag_missing_source
  FROM {name}_c c FULL OUTER JOIN {name}_p p ON c.h = p.h{on})"""


GOLD = _balance_sql(False)
GOLD_S = _balance_sql(True)
MEASURES = (
    "consumo_total_kwh",
    "producao_total_kwh",
    "producao_dgm_kwh",
    "producao_pre_kwh",
    "saldo_kwh",
    "ratio_producao_consumo",
)
FLAGS = ("flag_defice", "flag_excedente", "flag_missing_source")


def sql_round(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


GOLD_OUT = f"timestamp_utc, {sql_round(MEASURES)}, {', '.join(FLAGS)}"


def price_hourly(t: Tables) -> DataFrame:
    """Hourly price: the last `error` reading of the hour."""
    e = t.events.where("event_type = 'error'")
    return e.groupBy(hour_bucket(F.col("ts")).alias("timestamp_utc")).agg(F.max_by("value", "ts").alias("preco_eur_mwh"))


def consumption_mwh(t: Tables) -> DataFrame:
    return G.hourly_sum(consumption(t), ["consumo_total_kwh"]).select(
        "timestamp_utc", (F.col("consumo_total_kwh") * 0.25).alias("consumo_mwh")
    )


def cost(t: Tables) -> DataFrame:
    return G.join_on_hour(consumption_mwh(t), price_hourly(t))


COST = """
k_c AS (SELECT date_trunc('hour', ts) AS timestamp_utc, sum(value) * 0.25 AS consumo_mwh
        FROM events WHERE event_type = 'view' GROUP BY 1),
k_p AS (SELECT date_trunc('hour', ts) AS timestamp_utc, arg_max(value, ts) AS preco_eur_mwh
        FROM events WHERE event_type = 'error' GROUP BY 1),
cost AS (SELECT c.timestamp_utc, consumo_mwh, preco_eur_mwh FROM k_c c JOIN k_p p ON c.timestamp_utc = p.timestamp_utc)"""


# Raw price rows: text columns of a day-ahead file built from lineitem; the source position is the line key.
def raw_price(t: Tables, *more: Column) -> DataFrame:
    return t.lineitem.select(
        *more,
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("date"),
        ((F.col("l_orderkey") % 25) + 1).cast("string").alias("hour"),
        F.replace(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("portugal"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("spain"),
        line_position().alias("row_pos"),
    )


def line_position() -> Column:
    """A position per line as one exact number, which lets aggregates over it hash: order, line, part and supplier."""
    places = {"l_orderkey": 23, "l_linenumber": 22, "l_partkey": 10, "l_suppkey": 0}
    return reduce(Column.__add__, [F.col(c).cast("decimal(12,0)") * F.lit(Decimal(10**n)) for c, n in places.items()])


RAW_PRICE = """
raw_price AS (
  SELECT CAST(l_shipdate AS DATE) AS day, CAST(l_orderkey % 25 + 1 AS INTEGER) AS hour, l_extendedprice AS price,
         l_orderkey::HUGEINT * 100000000000000000000000 + l_linenumber::HUGEINT * 10000000000000000000000
           + l_partkey::HUGEINT * 10000000000 + l_suppkey AS pos
  FROM lineitem)"""


# Raw readings with duplicates, zeros, bad values and unreadable instants, in the layout of the CSV files.
def raw_readings(t: Tables) -> DataFrame:
    day_key = F.concat(F.date_format("ts", "yyyy-MM-dd'T'"), F.lpad((F.col("user_id") % 24).cast("string"), 2, "0"), F.lit(":00:00+01:00"))
    return t.events.select(
        F.expr("CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'sem data' END").alias("_bad"),
        F.col("event_id"),
        day_key.alias("_key"),
        F.dayofmonth("ts").cast("string").alias("dia"),
        F.month("ts").cast("string").alias("mes"),
        F.year("ts").cast("string").alias("ano"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.date_format("ts", "HH:mm").alias("time"),
        *[F.col("value").cast("string").alias(c) for c in ("bt", "mt")],
        F.lit("0").alias("at"),
        F.lit(None).cast("string").alias("mat"),
        F.expr(
            "CASE WHEN event_id % 10 = 0 THEN '0' WHEN event_id % 17 = 0 THEN 'n/d' ELSE concat(' ', cast(value AS string)) END"
        ).alias("total"),
        F.col("event_id").alias("row_pos"),
    ).select(
        F.expr("CASE WHEN event_id % 23 = 0 OR event_id % 19 = 0 THEN _bad ELSE _key END").alias("datahora"),
        "dia", "mes", "ano", "date", "time", "bt", "mt", "at", "mat", "total", "row_pos",
    )


# The same rows with their parsed values.
RAW_READINGS = """
r AS (
  SELECT event_id AS row_pos,
         CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'sem data'
              ELSE strftime(ts, '%Y-%m-%d') || 'T' || lpad(CAST(user_id % 24 AS VARCHAR), 2, '0') || ':00:00+01:00' END AS datahora,
         CASE WHEN event_id % 23 = 0 OR event_id % 19 = 0 THEN NULL
              ELSE CAST(ts AS DATE) + INTERVAL 1 HOUR * (CAST(user_id % 24 AS INTEGER) - 1) END AS timestamp_utc,
         day(ts) AS dia, month(ts) AS mes, year(ts) AS ano, CAST(ts AS DATE) AS data_local,
         strftime(ts, '%H:%M') AS hora_local_raw, value AS bt, value AS mt, CAST(0 AS DOUBLE) AS at_, CAST(NULL AS DOUBLE) AS mat,
         CASE WHEN event_id % 10 = 0 THEN 0.0 WHEN event_id % 17 = 0 THEN NULL ELSE value END AS total
  FROM events)"""


def order_consumption(t: Tables) -> DataFrame:
    """Hourly energy over the years of the price rows: the order value, spread over the hours of its day."""
    hour = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_custkey") % 24).cast("int"))
    return t.orders.groupBy(hour.alias("timestamp_utc")).agg((F.sum("o_totalprice") * 0.25).alias("consumo_mwh"))


ORDER_CONSUMPTION = """
oc AS (SELECT o_orderdate + INTERVAL 1 HOUR * CAST(o_custkey % 24 AS INTEGER) AS timestamp_utc,
              sum(o_totalprice) * 0.25 AS consumo_mwh FROM orders GROUP BY 1)"""
