"""Catalogue: parsing, flags, filters and column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import measures as M
from ..functions import parsing as P
from ..operators import serving as S
from ..operators.silver import trusted_rows
from ..sources.readers import label_column, numeric_table
from .inputs import FLAGS, GOLD, GOLD_OUT, MEASURES, balance, raw_price, RAW_PRICE, sql_round
from .registry import query, rounded


@query("SELECT event_id, trim(props) AS props, trim(event_type) AS event_type FROM events")
def trim_text_columns(t):
    padded = t.events.select(
        "event_id", F.concat(F.lit("  "), "props", F.lit(" ")).alias("props"), F.concat("event_type", F.lit("  ")).alias("event_type")
    )
    return P.trim_strings(padded)


_TEXT_NUMBER = """CASE WHEN event_id % 7 = 0 THEN 'n/d' WHEN event_id % 11 = 0 THEN ''
  WHEN event_id % 13 = 0 THEN NULL ELSE concat(' ', CAST(value AS {text})) END"""


@query(
    f"""WITH x AS (SELECT event_id, {_TEXT_NUMBER.format(text='VARCHAR')} AS raw FROM events)
    SELECT event_id, TRY_CAST(trim(raw) AS DOUBLE) AS number, TRY_CAST(trim(raw) AS DOUBLE) IS NULL AS flag_bad FROM x"""
)
def lenient_numbers(t):
    raw = t.events.select("event_id", F.expr(_TEXT_NUMBER.format(text="STRING")).alias("raw"))
    return raw.select("event_id", P.lenient_double(F.col("raw")).alias("number")).withColumn("flag_bad", F.col("number").isNull())


@query("SELECT event_id, value AS number FROM events")
def decimal_comma_numbers(t):
    text = F.concat(F.lit(" "), F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")))
    return t.events.select("event_id", P.decimal_comma_double(text).alias("number"))


@query(
    """SELECT event_id,
      CASE WHEN event_id % 19 = 0 THEN NULL ELSE date_trunc('second', ts) - INTERVAL 1 HOUR * CAST(event_id % 3 AS INTEGER) END AS utc,
      CASE WHEN event_id % 19 = 0 THEN NULL ELSE date_trunc('milliseconds', ts) END AS floored
    FROM events"""
)
def offset_timestamps(t):
    offset = F.concat(F.lit("+0"), (F.col("event_id") % 3).cast("string"), F.lit(":00"))
    seconds = F.when(F.col("event_id") % 19 == 0, "sem hora").otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset)
    )
    micros = F.when(F.col("event_id") % 19 != 0, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("Z")))
    return t.events.select(
        "event_id", P.offset_timestamp(seconds).alias("utc"), P.offset_timestamp(micros, floor_to_ms=True).alias("floored")
    )


@query(
    """SELECT event_id, CASE event_id % 14
        WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 7 THEN date_trunc('second', ts)
        WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('minute', ts) WHEN 8 THEN date_trunc('minute', ts)
        WHEN 4 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 13 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
        WHEN 5 THEN date_trunc('day', ts) WHEN 12 THEN date_trunc('day', ts)
        WHEN 9 THEN date_trunc('second', ts) WHEN 10 THEN date_trunc('minute', ts) WHEN 11 THEN ts END AS utc FROM events"""
)
def multi_format_timestamps(t):
    layouts = {
        0: "yyyy-MM-dd'T'HH:mm:ss", 1: "yyyy-MM-dd HH:mm:ss", 2: "yyyy-MM-dd'T'HH:mm", 3: "yyyy-MM-dd HH:mm",
        4: "yyyy-MM-dd'T'HH:mm:ss'+02:00'", 5: "yyyy-MM-dd", 6: "dd MMM yyyy",
        7: "yyyy-M-d H:m:s", 8: "yyyy-M-d'T'H:m", 9: "yyyyMMdd'T'HHmmss", 10: "yyyyMMdd'T'HHmm'Z'", 11: "yyyy-MM-dd HH:mm:ss.SSSSSS'789'",
        12: "yyyyMMdd", 13: "yyyy-MM-dd HH:mm:ss' +0200'",
    }
    text = F.coalesce(*[F.when(F.col("event_id") % 14 == k, F.date_format("ts", v)) for k, v in layouts.items()])
    return t.events.select("event_id", P.multi_format_timestamp(text).alias("utc"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 IN (4, 9) THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders"
)
def multi_format_dates(t):
    layouts = {0: "yyyy-MM-dd", 1: "dd/MM/yyyy", 2: "dd-MM-yyyy", 3: "yyyy/MM/dd", 4: "yyyy MM dd",
               5: "yyyy-MM-dd'T'HH:mm:ss", 6: "dd/MM/yyyy HH:mm", 7: "yyyy-MM-dd HH:mm:ss'+01:00'", 8: "d-M-yyyy H:m", 9: "yyyy-MM-dd 'at noon'"}
    text = F.coalesce(*[F.when(F.col("o_orderkey") % 10 == k, F.date_format("o_orderdate", v)) for k, v in layouts.items()])
    return t.orders.select("o_orderkey", P.multi_format_date(text).alias("day"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts)
        WHEN 2 THEN date_trunc('milliseconds', ts) ELSE ts - INTERVAL 1 HOUR END AS utc FROM events"""
)
def query_layer_timestamps(t):
    layouts = {0: "yyyy-MM-dd HH:mm:ss.SSSSSS' UTC'", 1: "yyyy-MM-dd'T'HH:mm:ss'Z'", 2: "yyyy-MM-dd HH:mm:ss.SSS",
               3: "yyyy-MM-dd HH:mm:ss.SSSSSS'+01:00'"}
    text = F.coalesce(*[F.when(F.col("event_id") % 4 == k, F.date_format("ts", v)) for k, v in layouts.items()])
    return t.events.select("event_id", P.query_layer_timestamp(text).alias("utc"))


@query(
    """SELECT event_id, event_type = 'view' AS from_text, event_id % 3 = 0 AS from_null FROM events"""
)
def lenient_booleans(t):
    text = F.when(F.col("event_type") == "view", " TRUE ").otherwise("no")
    partly = F.when(F.col("event_id") % 3 == 0, F.lit(True))
    return t.events.select("event_id", P.lenient_boolean(text).alias("from_text"), P.lenient_boolean(partly).alias("from_null"))


# SQL states the zone's rule itself: from 1987 to 2006 New York went to UTC-4 on the first Sunday of April at
# 02:00 and back to UTC-5 on the last Sunday of October at 02:00, which covers every date of the table.
_RULE = """
years AS (SELECT DISTINCT year(day + INTERVAL 1 DAY) AS y FROM raw_price UNION SELECT DISTINCT year(day) FROM raw_price),
sundays AS (
  SELECT y, make_date(y, 4, 1) + CAST((7 - dayofweek(make_date(y, 4, 1))) % 7 AS INTEGER) AS spring,
         make_date(y, 10, 31) - CAST(dayofweek(make_date(y, 10, 31)) AS INTEGER) AS autumn
  FROM years)"""


@query(
    f"""WITH {RAW_PRICE}, {_RULE},
    local AS (SELECT hour, day, day + INTERVAL 1 HOUR * (hour - 1) AS wall FROM raw_price),
    rule AS (SELECT l.*, s.spring + INTERVAL 2 HOUR AS skip, s.autumn + INTERVAL 1 HOUR AS fold
             FROM local l JOIN sundays s ON s.y = year(l.wall))
    SELECT day, hour, count(*) AS n,
      CASE WHEN wall >= skip AND wall < skip + INTERVAL 1 HOUR THEN NULL
           WHEN wall >= fold AND wall < fold + INTERVAL 1 HOUR THEN NULL
           WHEN wall >= skip AND wall < fold THEN wall + INTERVAL 4 HOUR ELSE wall + INTERVAL 5 HOUR END AS utc
    FROM rule GROUP BY ALL"""
)
def delivery_hours_to_utc(t):
    raw = raw_price(t).select(P.multi_format_date(F.col("date")).alias("day"), P.lenient_int(F.col("hour")).alias("hour"))
    utc = P.delivery_hour_to_utc(F.col("day"), F.col("hour"), "America/New_York").alias("utc")
    return raw.groupBy("day", "hour", utc).agg(F.count(F.lit(1)).alias("n"))


def _convention_sql(shift: int) -> str:
    return f"""WITH {RAW_PRICE} SELECT day, hour, day + INTERVAL 1 HOUR * (hour - {shift}) AS at, count(*) AS n
    FROM raw_price GROUP BY ALL"""


def _convention(t, name):
    raw = raw_price(t).select(P.multi_format_date(F.col("date")).alias("day"), P.lenient_int(F.col("hour")).alias("hour"))
    at = P.market_hour_timestamp(F.col("day"), F.col("hour"), name).alias("at")
    return raw.groupBy("day", "hour", at).agg(F.count(F.lit(1)).alias("n"))


@query(_convention_sql(1))
def market_hour_convention_v1(t):
    return _convention(t, "v1")


@query(_convention_sql(0))
def market_hour_convention_v2(t):
    return _convention(t, "v2")


@query("SELECT event_id, date_trunc('hour', ts) AS hour_utc FROM events")
def hour_buckets(t):
    return t.events.select("event_id", C.hour_bucket(F.col("ts")).alias("hour_utc"))


@query("SELECT event_id, round(value * 0.25, 6) + 0.0 AS energia_mwh FROM events")
def power_to_energy(t):
    return rounded(t.events.select("event_id", (F.col("value") * 0.25).alias("energia_mwh")))


@query("SELECT ts AS timestamp_utc, user_id AS serie, value AS consumo_total_kwh FROM events")
def layer_rename(t):
    return t.events.select(F.col("ts").alias("timestamp_utc"), F.col("user_id").alias("serie"), F.col("value").alias("consumo_total_kwh"))


_MARKED = "CASE WHEN event_id % 10 = 0 THEN 0.0 WHEN event_id % 17 = 0 THEN NULL ELSE value END"


@query(
    f"""WITH x AS (SELECT event_id, ts, {_MARKED} AS v, CASE WHEN event_id % 29 = 0 THEN NULL ELSE ts END AS t FROM events)
    SELECT event_id, t IS NULL AS flag_bad_timestamp, v IS NULL AS flag_bad_total, coalesce(v, 0) = 0 AS zero_a,
      coalesce(v = 0, false) AS zero_b, coalesce(CAST(t - INTERVAL 1 HOUR AS DATE) <> CAST(ts AS DATE), false) AS flag_date_mismatch
    FROM x"""
)
def quality_flags(t):
    x = t.events.select(
        "event_id", F.to_date("ts").alias("local"), F.expr(_MARKED).cast("double").alias("v"),
        F.when(F.col("event_id") % 29 != 0, C.add_hours(F.col("ts"), -1)).alias("t"),
    )
    return x.select(
        "event_id",
        F.col("t").isNull().alias("flag_bad_timestamp"),
        F.col("v").isNull().alias("flag_bad_total"),
        M.zero_flag(F.col("v"), "A").alias("zero_a"),
        M.zero_flag(F.col("v"), "B").alias("zero_b"),
        M.date_mismatch_flag(F.col("t"), F.col("local")).alias("flag_date_mismatch"),
    )


@query(
    """WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_orderkey % 28 AS hour,
      CASE WHEN l_discount = 0 THEN NULL ELSE l_discount - 0.05 END AS pt FROM lineitem)
    SELECT k, n, p, s, hour NOT BETWEEN 1 AND 25 AS flag_bad_hour, pt IS NULL AS flag_bad_preco_pt,
      coalesce(pt = 0, false) AS flag_zero_preco_pt FROM x"""
)
def price_flags(t):
    pt = F.when(F.col("l_discount") != 0, F.col("l_discount") - 0.05)
    return t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        M.bad_hour_flag(F.col("l_orderkey") % 28).alias("flag_bad_hour"),
        pt.isNull().alias("flag_bad_preco_pt"),
        M.zero_flag(pt, "B").alias("flag_zero_preco_pt"),
    )


@query(
    f"""SELECT event_id, round({_MARKED}, 6) + 0.0 AS v FROM events WHERE event_id % 29 <> 0 AND ({_MARKED}) IS NOT NULL"""
)
def trusted_row_filter(t):
    x = t.events.select(
        "event_id", F.expr(_MARKED).cast("double").alias("v"), (F.col("event_id") % 29 == 0).alias("flag_bad_timestamp")
    ).withColumn("flag_bad_total", F.col("v").isNull())
    return rounded(trusted_rows(x).select("event_id", "v"))


@query(
    """WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s,
        CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS a, l_tax AS b, 0.1 AS total FROM lineitem)
    SELECT k, n, p, s, round(coalesce(a, 0) + coalesce(b, 0), 6) + 0.0 AS componentes,
      round(abs(total - (coalesce(a, 0) + coalesce(b, 0))), 6) + 0.0 AS diff,
      abs(total - (coalesce(a, 0) + coalesce(b, 0))) > 0.001 AS flag_component_sum_mismatch FROM x"""
)
def component_sums(t):
    x = t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("a"), F.col("l_tax").alias("b"), F.lit(0.1).alias("total"),
    )
    gap = M.component_gap("total", ["a", "b"])
    return rounded(x.select("k", "n", "p", "s", M.component_sum(["a", "b"]).alias("componentes"), gap.alias("diff"),
                            (gap > 0.001).alias("flag_component_sum_mismatch")))


@query(
    """WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_tax * 100 AS prod,
      CASE WHEN l_discount < 0.02 THEN NULL WHEN l_discount < 0.04 THEN 0 ELSE l_discount * 100 END AS cons FROM lineitem)
    SELECT k, n, p, s, round(prod - cons, 6) + 0.0 AS saldo_kwh, round(CASE WHEN cons <> 0 THEN prod / cons END, 6) + 0.0 AS ratio_producao_consumo,
      coalesce(prod < cons, false) AS flag_defice, coalesce(prod > cons, false) AS flag_excedente,
      prod IS NOT NULL AND cons IS NOT NULL AS has_complete_data FROM x"""
)
def balance_kpis(t):
    cons = F.when(F.col("l_discount") < 0.02, None).when(F.col("l_discount") < 0.04, 0.0).otherwise(F.col("l_discount") * 100)
    x = t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        (F.col("l_tax") * 100).alias("prod"), cons.alias("cons"),
    )
    kpis = M.balance_columns(F.col("cons"), F.col("prod"))
    complete = M.complete_reading(F.col("cons"), F.col("prod"), F.lit(False)).alias("has_complete_data")
    return rounded(x.select("k", "n", "p", "s", *[e.alias(c) for c, e in kpis.items()], complete))


@query(
    f"WITH {GOLD} SELECT timestamp_utc, consumo_total_kwh IS NOT NULL AND producao_total_kwh IS NOT NULL AND NOT flag_missing_source AS has_complete_data FROM gold"
)
def complete_data_flag(t):
    return S.with_completeness(balance(t)).select("timestamp_utc", "has_complete_data")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * l_extendedprice, 6) + 0.0 AS custo_estimado_eur FROM lineitem")
def hourly_cost_product(t):
    return rounded(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                     (F.col("l_quantity") * F.col("l_extendedprice")).alias("custo_estimado_eur")))


@query(
    f"WITH {GOLD} SELECT {GOLD_OUT} FROM gold WHERE timestamp_utc BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:00:00'"
)
def inclusive_time_slice(t):
    sliced = S.time_slice(balance(t), datetime(2024, 1, 5, 6), datetime(2024, 1, 20, 18))
    return rounded(sliced.select("timestamp_utc", *MEASURES, *FLAGS), MEASURES)


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-12 00:00:00'")
def open_ended_time_slice(t):
    return S.time_slice(t.events.select("event_id", "value", "ts"), start=datetime(2024, 1, 12), ts="ts").select("event_id", "value")


@query(
    """SELECT event_id, CAST(ts AS DATE) AS date, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
      CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) AS INTEGER) AS day_of_week,
      isodow(ts) >= 6 AS is_weekend FROM events"""
)
def calendar_columns(t):
    return t.events.select("event_id", *[e.alias(c) for c, e in C.calendar_columns(F.col("ts")).items()])


@query(
    """SELECT o_orderkey, CAST(hour(o_orderdate) AS INTEGER) AS hour, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
      CAST(month(o_orderdate) AS INTEGER) AS month FROM orders"""
)
def training_calendar(t):
    return t.orders.select("o_orderkey", *[e.alias(c) for c, e in C.training_calendar(F.col("o_orderdate")).items()])


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(CASE WHEN l_tax > 0.02 THEN l_tax END, l_discount, 0), 6) + 0.0 AS consumo
    FROM lineitem"""
)
def alias_resolution(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                          F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("consumo_total"), F.col("l_discount").alias("consumo_total_kwh"))
    value = P.finite_or_zero(P.first_present(x, ["total_consumo", "consumo_total", "consumo_total_kwh"], 0.0))
    return rounded(x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", value.alias("consumo")))


@query(
    f"""WITH {GOLD} SELECT strftime(timestamp_utc, '%Y-%m-%d') AS periodo, {sql_round(['consumo_total', 'producao_total', 'producao_pre', 'producao_dgm', 'saldo'])},
      round(CASE WHEN consumo_total > 0 THEN producao_total / consumo_total END, 6) + 0.0 AS ratio_producao_consumo, CAST(0 AS DOUBLE) AS defice_horas, CAST(0 AS DOUBLE) AS excedente_horas, CAST(n AS DOUBLE) AS leituras
    FROM (SELECT date_trunc('day', timestamp_utc) AS timestamp_utc, coalesce(sum(consumo_total_kwh), 0) AS consumo_total,
      coalesce(sum(producao_total_kwh), 0) AS producao_total, coalesce(sum(producao_pre_kwh), 0) AS producao_pre,
      coalesce(sum(producao_dgm_kwh), 0) AS producao_dgm, coalesce(sum(saldo_kwh), 0) AS saldo, count(*) AS n FROM gold GROUP BY 1)"""
)
def grouped_series_normalised(t):
    rollup = S.balance_rollup(balance(t), "day").drop("ratio_producao_consumo", "defice_horas", "excedente_horas")
    return rounded(S.normalise_grouped(rollup.withColumnRenamed("periodo", "chave_tempo")))


@query(
    """SELECT CAST(l_shipdate AS DATE) AS day, round(avg(l_extendedprice), 6) + 0.0 AS market_price_pt FROM lineitem
    GROUP BY 1"""
)
def price_metric_selection(t):
    prices = t.lineitem.select(F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("market_price_pt"))
    return rounded(prices.groupBy("day").agg(F.avg("market_price_pt").alias("market_price_pt")))


@query("SELECT event_id, value BETWEEN 1 AND 200 AS plausible FROM events")
def price_plausibility(t):
    return t.events.select("event_id", F.col("value").between(1.0, 200.0).alias("plausible"))


@query("SELECT doc_id, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM labels")
def numeric_training_table(t):
    table = numeric_table(t.labels.select(F.col("doc_id").alias("Doc Id"), F.col("quality").alias(" Quality"), F.col("toxic").alias("Toxic ")))
    return table.withColumn("doc_id", F.col("doc_id").cast("long"))


@query("SELECT label AS label_value, count(*) AS n, 'label' AS label_name FROM embeddings GROUP BY 1")
def label_discovery(t):
    e = t.embeddings
    name = label_column(e)
    return e.groupBy(F.col(name).alias("label_value")).agg(F.count(F.lit(1)).alias("n")).withColumn("label_name", F.lit(name))


@query(
    """WITH x AS (SELECT date_trunc('hour', ts) AS timestamp_utc, ts, CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE value END AS v FROM events)
    SELECT timestamp_utc, arg_max(v, ts) AS consumo_mwh FROM x GROUP BY 1"""
)
def serving_hourly_read(t):
    from ..operators.gold import serving_hourly

    x = t.events.select("ts", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("v"))
    return serving_hourly(x, "v", "consumo_mwh", ts="ts")


@query("SELECT count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events WHERE event_id % 31 <> 0")
def null_key_rows_dropped(t):
    x = t.events.select(F.when(F.col("event_id") % 31 != 0, F.col("ts")).alias("timestamp_utc"), "value")
    kept = x.where(F.col("timestamp_utc").isNotNull())
    return rounded(kept.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), digits=4)
