"""Catalogue: bronze, silver and gold tables, joins and windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F


from ..operators import gold as G
from ..operators import timeline as T
from ..operators.bronze import bronze_clean, preferred_rows
from ..operators.features import deficit_features, latest_features
from ..operators.ranking import duplicate_counts, pick_first, rank_duplicates
from ..operators.silver import hourly_with_controls, silver_15min, silver_hourly
from ..schemas import CONSUMPTION_COMPONENTS, CONSUMPTION_TOTAL
from .inputs import (
    COST,
    GOLD,
    GOLD_OUT,
    GOLD_S,
    MEASURES,
    ORDER_CONSUMPTION,
    RAW_PRICE,
    RAW_READINGS,
    SERIES,
    balance,
    balance_by_series,
    consumption,
    consumption_mwh,
    cost,
    order_consumption,
    price_hourly,
    production,
    raw_price,
    raw_readings,
    sql_round,
)
from .registry import query, rounded

INGEST = datetime(2024, 2, 1, 12)
RUN = "run-1"
# The event table spans a month, so its series are cut by week.
BUCKET = "week"
GOLD_MEASURES = list(T.GOLD_MEASURES)


# ---- flagship ----


@query(f"WITH {GOLD} SELECT {GOLD_OUT} FROM gold")
def gold_balance_hourly(t):
    return rounded(balance(t), MEASURES)


@query(f"WITH {GOLD_S} SELECT series, {GOLD_OUT} FROM gold_s")
def gold_balance_by_series(t):
    return rounded(balance_by_series(t), MEASURES)


# ---- bronze ----

_RANKED = """
ranked AS (SELECT *, {count} AS duplicate_count, {rank} AS duplicate_rank FROM r)"""


def _ranked_sql(key: str, null_is_group: bool) -> str:
    count = f"count(*) OVER (PARTITION BY {key})"
    rank = (
        f"row_number() OVER (PARTITION BY {key} ORDER BY CASE WHEN coalesce(total, 0) = 0 THEN 1 ELSE 0 END, "
        "total DESC NULLS LAST, row_pos)"
    )
    if not null_is_group:
        count, rank = (f"CASE WHEN {key} IS NOT NULL THEN {x} END" for x in (count, rank))
    return _RANKED.format(count=count, rank=rank)


_BRONZE_OUT = """coalesce(datahora, '') AS datahora_raw, timestamp_utc, CAST(dia AS INTEGER) AS dia, CAST(mes AS INTEGER) AS mes,
  CAST(ano AS INTEGER) AS ano, data_local, hora_local_raw, bt AS consumo_bt_kwh, mt AS consumo_mt_kwh, at_ AS consumo_at_kwh,
  coalesce(mat, -1) AS consumo_mat_kwh, coalesce(total, -1) AS consumo_total_kwh,
  CAST(coalesce(duplicate_count, 0) AS BIGINT) AS duplicate_count, CAST(coalesce(duplicate_rank, 0) AS BIGINT) AS duplicate_rank,
  coalesce(duplicate_count > 1, false) AS flag_duplicate_timestamp, timestamp_utc IS NULL AS flag_bad_timestamp,
  data_local IS NULL AS flag_bad_date, total IS NULL AS flag_bad_total"""


def _shown(bronze):
    """Unknown numbers shown as -1 or 0 for comparison; their flags are compared as they are."""
    fill = {"consumo_mat_kwh": -1.0, "consumo_total_kwh": -1.0, "duplicate_count": 0, "duplicate_rank": 0, "datahora_raw": ""}
    return bronze.fillna(fill).withColumn("flag_duplicate_timestamp", F.coalesce("flag_duplicate_timestamp", F.lit(False)))


@query(
    f"""WITH {RAW_READINGS}, {_ranked_sql('datahora', True)} SELECT {_BRONZE_OUT}, coalesce(total, 0) = 0 AS flag_zero_row,
    TIMESTAMP '2024-02-01 12:00:00' AS ingest_ts_utc FROM ranked"""
)
def bronze_consumption_a(t):
    return _shown(bronze_clean(raw_readings(t), "consumption", RUN, INGEST, "A"))


@query(
    f"""WITH {RAW_READINGS}, {_ranked_sql('timestamp_utc', False)} SELECT {_BRONZE_OUT}, coalesce(total = 0, false) AS flag_zero_row,
    coalesce(CAST(timestamp_utc AS DATE) <> data_local, false) AS flag_date_mismatch, 'events' AS source_file_name, 'run-1' AS run_id,
    TIMESTAMP '2024-02-01 12:00:00' AS ingest_ts_utc FROM ranked"""
)
def bronze_consumption_b(t):
    raw = raw_readings(t).withColumn("source_file_name", F.lit("events"))
    return _shown(bronze_clean(raw, "consumption", RUN, INGEST, "B"))


@query(
    f"""WITH {RAW_READINGS}, {_ranked_sql('datahora', True)}
    SELECT count(*) AS n, count(timestamp_utc) AS parsed, CAST(sum(duplicate_rank) AS BIGINT) AS ranks, round(sum(bt), 4) + 0.0 AS dgm, round(sum(total), 4) + 0.0 AS total
    FROM ranked"""
)
def bronze_production(t):
    raw = raw_readings(t).withColumnsRenamed({"bt": "dgm", "mt": "pre"})
    b = bronze_clean(raw, "production", RUN, INGEST, "A")
    return rounded(
        b.agg(F.count(F.lit(1)).alias("n"), F.count("timestamp_utc").alias("parsed"), F.sum("duplicate_rank").alias("ranks"),
              F.sum("producao_dgm_kwh").alias("dgm"), F.sum("producao_total_kwh").alias("total")), digits=4)


_BRONZE_PRICE = f"""{RAW_PRICE},
bp AS (SELECT *, day + INTERVAL 1 HOUR * (hour - 1) AS timestamp_utc FROM raw_price),
bpr AS (SELECT *, count(*) OVER (PARTITION BY timestamp_utc) AS duplicate_count,
  row_number() OVER (PARTITION BY timestamp_utc ORDER BY CASE WHEN price = 0 THEN 1 ELSE 0 END, price DESC, pos) AS duplicate_rank FROM bp)"""


def _bronze_price(t):
    # The table's own dates are taken as UTC, so every delivery hour exists once.
    raw = raw_price(t).withColumn("portugal", F.col("spain"))
    return bronze_clean(raw, "price", RUN, INGEST, source_tz="UTC")


@query(
    f"""WITH {_BRONZE_PRICE} SELECT strftime(day, '%d/%m/%Y') AS date_raw, day AS delivery_date_local, hour AS market_hour, timestamp_utc,
    price AS preco_pt_eur_mwh, CAST(duplicate_count AS BIGINT) AS duplicate_count, CAST(duplicate_rank AS BIGINT) AS duplicate_rank,
    duplicate_count > 1 AS flag_duplicate_timestamp, false AS flag_bad_hour, 'UTC' AS market_timezone_assumed FROM bpr"""
)
def bronze_price(t):
    return _bronze_price(t).select(
        "date_raw", "delivery_date_local", "market_hour", "timestamp_utc", "preco_pt_eur_mwh", "duplicate_count", "duplicate_rank",
        "flag_duplicate_timestamp", "flag_bad_hour", "market_timezone_assumed")


@query(
    f"""WITH {_BRONZE_PRICE} SELECT timestamp_utc, price AS preco_pt_eur_mwh FROM bpr WHERE duplicate_rank = 1"""
)
def preferred_price_rows(t):
    return preferred_rows(_bronze_price(t)).select("timestamp_utc", "preco_pt_eur_mwh")


_KEYED = """x AS (SELECT event_id, user_id, date_trunc('day', ts) AS day, event_type,
  CASE WHEN event_id % 10 = 0 THEN 0.0 WHEN event_id % 17 = 0 THEN NULL ELSE value END AS v FROM events)"""


def _keyed(t):
    return t.events.select(
        "event_id", "event_type",
        F.concat_ws("/", "user_id", F.to_date("ts").cast("string")).alias("key"),
        F.expr("CASE WHEN event_id % 10 = 0 THEN 0.0 WHEN event_id % 17 = 0 THEN NULL ELSE value END").cast("double").alias("v"),
    )


@query(f"""WITH {_KEYED} SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id, day) AS BIGINT) AS duplicate_count FROM x""")
def duplicate_count_per_key(t):
    return duplicate_counts(_keyed(t), "key").select("event_id", "duplicate_count")


@query(
    f"""WITH {_KEYED} SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, day ORDER BY
      CASE WHEN coalesce(v, 0) = 0 THEN 1 ELSE 0 END, v DESC NULLS LAST, event_id) AS BIGINT) AS duplicate_rank FROM x"""
)
def duplicate_rank_per_key(t):
    return rank_duplicates(_keyed(t), "key", "v", "event_id").select("event_id", "duplicate_rank")


@query(
    f"""WITH {_KEYED} SELECT event_id, event_type, CAST(count(*) OVER (PARTITION BY event_type) AS BIGINT) AS duplicate_count,
      CAST(row_number() OVER (PARTITION BY event_type ORDER BY
      CASE WHEN coalesce(v, 0) = 0 THEN 1 ELSE 0 END, v DESC NULLS LAST, event_id) AS BIGINT) AS duplicate_rank FROM x"""
)
def duplicate_rank_of_hot_keys(t):
    """Five keys hold all rows; each is ranked over several tasks."""
    ranked = rank_duplicates(_keyed(t), "event_type", "v", "event_id", hot_rows=500)
    return ranked.select("event_id", "event_type", "duplicate_count", "duplicate_rank")


# ---- silver ----


@query(
    f"""WITH {_KEYED}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY CASE WHEN v = 0 THEN 1 ELSE 0 END, v DESC, event_id) AS rn
    FROM x WHERE v IS NOT NULL) SELECT event_id, round(v, 6) + 0.0 AS v FROM s WHERE rn = 1"""
)
def silver_pick(t):
    rows = _keyed(t).where(F.col("v").isNotNull())
    picked = pick_first(rows, ["key"], [(F.col("v") == 0).cast("int"), F.col("v").desc_nulls_last(), F.col("event_id")])
    return rounded(picked.select("event_id", "v"))


@query(
    f"""WITH {RAW_READINGS}, {_ranked_sql('datahora', True)},
    s AS (SELECT *, row_number() OVER (PARTITION BY timestamp_utc ORDER BY CASE WHEN total = 0 THEN 1 ELSE 0 END, total DESC, duplicate_rank) AS pick
          FROM ranked WHERE timestamp_utc IS NOT NULL AND total IS NOT NULL)
    SELECT timestamp_utc, CAST(dia AS INTEGER) AS dia, data_local, round(total, 6) + 0.0 AS consumo_total_kwh,
      round(bt + mt + at_, 6) + 0.0 AS consumo_componentes_kwh, round(abs(total - (bt + mt + at_)), 6) + 0.0 AS diff_componentes_total_kwh,
      abs(total - (bt + mt + at_)) > 0.001 AS flag_component_sum_mismatch, CAST(duplicate_count AS BIGINT) AS duplicate_count,
      CAST(duplicate_rank AS BIGINT) AS bronze_duplicate_rank, total = 0 AS flag_zero_row, datahora AS datahora_raw
    FROM s WHERE pick = 1"""
)
def silver_quarter_hour(t):
    bronze = bronze_clean(raw_readings(t), "consumption", RUN, INGEST, "A")
    silver = silver_15min(bronze, CONSUMPTION_TOTAL, list(CONSUMPTION_COMPONENTS.values()), "consumo_componentes_kwh")
    return rounded(silver.select(
        "timestamp_utc", "dia", "data_local", "consumo_total_kwh", "consumo_componentes_kwh", "diff_componentes_total_kwh",
        "flag_component_sum_mismatch", "duplicate_count", "bronze_duplicate_rank", "flag_zero_row", "datahora_raw"))


@query(
    """SELECT date_trunc('hour', ts) AS timestamp_utc, round(sum(value), 6) + 0.0 AS consumo_total, min(ts) AS source_min_ts,
    max(ts) AS source_max_ts, CAST(count(*) AS BIGINT) AS source_rows FROM events GROUP BY 1"""
)
def hourly_sum_with_controls(t):
    return rounded(hourly_with_controls(t.events, "value", "consumo_total", ts="ts").withColumnRenamed("ts", "timestamp_utc"))


@query(
    f"""WITH {RAW_READINGS}, {_ranked_sql('timestamp_utc', False)}
    SELECT date_trunc('hour', timestamp_utc) AS timestamp_utc, CAST(year(any_value(timestamp_utc)) AS INTEGER) AS year,
    CAST(day(any_value(timestamp_utc)) AS INTEGER) AS day, CAST(hour(any_value(timestamp_utc)) AS INTEGER) AS hour,
    round(sum(total), 6) + 0.0 AS consumo_total, CAST(count(*) AS BIGINT) AS source_rows, DATE '2024-02-01' AS process_date
    FROM ranked WHERE duplicate_rank = 1 AND total IS NOT NULL GROUP BY 1"""
)
def silver_consumption_hourly(t):
    bronze = bronze_clean(raw_readings(t), "consumption", RUN, INGEST, "B")
    silver = silver_hourly(bronze, "consumption", "2024-02-01")
    return rounded(silver.select("timestamp_utc", "year", "day", "hour", "consumo_total", "source_rows", "process_date"))


@query(
    f"""WITH {_BRONZE_PRICE} SELECT timestamp_utc, CAST(year(timestamp_utc) AS INTEGER) AS year, CAST(month(timestamp_utc) AS INTEGER) AS month,
    price AS market_price_pt, strftime(day, '%d/%m/%Y') AS source_date_raw, hour AS source_hour_raw, DATE '2024-02-01' AS process_date
    FROM bpr WHERE duplicate_rank = 1"""
)
def silver_price_hourly(t):
    silver = silver_hourly(_bronze_price(t), "price", "2024-02-01")
    return silver.select("timestamp_utc", "year", "month", "market_price_pt", "source_date_raw", "source_hour_raw", "process_date")


# ---- hourly sums and joins ----


@query("SELECT date_trunc('hour', ts) AS timestamp_utc, round(sum(value), 6) + 0.0 AS consumo_total_kwh FROM events WHERE event_type = 'view' GROUP BY 1")
def hourly_consumption(t):
    return rounded(G.hourly_sum(consumption(t), ["consumo_total_kwh"]))


@query(
    """SELECT date_trunc('hour', ts) AS timestamp_utc, round(sum(value), 6) + 0.0 AS producao_total_kwh,
    round(sum(CASE WHEN event_type = 'signup' THEN value END), 6) + 0.0 AS producao_dgm_kwh,
    round(sum(CASE WHEN event_type = 'purchase' THEN value END), 6) + 0.0 AS producao_pre_kwh
    FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1"""
)
def hourly_production(t):
    return rounded(G.hourly_sum(production(t), list(G.PRODUCTION_MEASURES)))


@query(
    f"WITH {GOLD_S} SELECT series, timestamp_utc, {sql_round(['consumo_total_kwh', 'producao_total_kwh'])}, flag_missing_source FROM gold_s"
)
def full_outer_hours(t):
    c = G.hourly_sum(consumption(t), ["consumo_total_kwh"], series=SERIES)
    p = G.hourly_sum(production(t), ["producao_total_kwh"], series=SERIES)
    return rounded(G.full_outer_on_hour(c, p, series=SERIES))


@query(f"WITH {COST} SELECT timestamp_utc, {sql_round(['consumo_mwh', 'preco_eur_mwh'])} FROM cost")
def inner_join_on_hour(t):
    return rounded(cost(t))


@query(f"WITH {COST} SELECT timestamp_utc FROM k_c INTERSECT SELECT timestamp_utc FROM k_p")
def hour_key_intersection(t):
    return consumption_mwh(t).select("timestamp_utc").intersect(price_hourly(t).select("timestamp_utc"))


_CAL = """cal AS (SELECT series, unnest(generate_series(min(timestamp_utc), max(timestamp_utc), INTERVAL 1 HOUR)) AS timestamp_utc
  FROM gold_s GROUP BY series)"""


@query(f"WITH {GOLD_S}, {_CAL} SELECT series, timestamp_utc FROM cal")
def hourly_calendar(t):
    return T.hourly_calendar(balance_by_series(t), series=SERIES)


@query(
    f"""WITH {GOLD_S}, {_CAL} SELECT c.series, c.timestamp_utc, round(g.consumo_total_kwh, 6) + 0.0 AS consumo_total_kwh, g.timestamp_utc IS NULL AS row_missing
    FROM cal c LEFT JOIN gold_s g ON g.series = c.series AND g.timestamp_utc = c.timestamp_utc"""
)
def calendar_left_join(t):
    joined = T.calendar_join(balance_by_series(t), series=SERIES)
    return rounded(joined.select("series", "timestamp_utc", "consumo_total_kwh", "row_missing"))


@query(
    f"""WITH {GOLD_S}, {_CAL} SELECT c.series, count(*) AS horas_em_falta FROM cal c
    WHERE NOT EXISTS (SELECT 1 FROM gold_s g WHERE g.series = c.series AND g.timestamp_utc = c.timestamp_utc) GROUP BY 1"""
)
def missing_hours_per_series(t):
    return T.missing_hours(balance_by_series(t), series=SERIES).groupBy("series").agg(F.count(F.lit(1)).alias("horas_em_falta"))


@query(
    f"""WITH {GOLD_S}, b AS (SELECT arg_max(consumo_total_kwh, (timestamp_utc, series)) AS base FROM gold_s WHERE consumo_total_kwh > 0)
    SELECT series, timestamp_utc, round(consumo_total_kwh / base, 6) + 0.0 AS relativo FROM gold_s CROSS JOIN b"""
)
def cross_join_with_base_value(t):
    gold = balance_by_series(t)
    newest = F.when(F.col("consumo_total_kwh") > 0, F.struct("timestamp_utc", "series"))
    base = F.broadcast(gold.agg(F.max_by("consumo_total_kwh", newest).alias("base")))  # one row
    ratio = (F.col("consumo_total_kwh") / F.col("base")).alias("relativo")
    return rounded(gold.crossJoin(base).select("series", "timestamp_utc", ratio))


@query(
    f"""WITH {GOLD_S} SELECT series, timestamp_utc, round(saldo_kwh, 6) + 0.0 AS saldo_kwh FROM gold_s
    WHERE timestamp_utc >= (SELECT date_trunc('day', max(timestamp_utc)) FROM gold_s WHERE NOT flag_missing_source)"""
)
def scalar_subquery_filter(t):
    gold = balance_by_series(t)
    last_day = gold.where(~F.col("flag_missing_source")).agg(F.date_trunc("day", F.max("timestamp_utc")).cast("timestamp_ntz"))
    return rounded(gold.where(F.col("timestamp_utc") >= last_day.scalar()).select("series", "timestamp_utc", "saldo_kwh"))


_CANDIDATES = f"""{RAW_PRICE}, {ORDER_CONSUMPTION},
won AS MATERIALIZED (SELECT day + INTERVAL 1 HOUR * (hour - 1) AS v1, arg_max(price, pos) AS preco_eur_mwh, arg_max(day, pos) AS delivery_date_local,
  arg_max(hour, pos) AS market_hour FROM raw_price GROUP BY 1),
cand AS (SELECT 'v1' AS convention, v1 AS timestamp_utc, * EXCLUDE (v1) FROM won
  UNION ALL SELECT 'v2', v1 + INTERVAL 1 HOUR, * EXCLUDE (v1) FROM won),
choice AS (SELECT count(*) FILTER (convention = 'v1') AS intersection_v1, count(*) FILTER (convention = 'v2') AS intersection_v2
  FROM cand JOIN oc USING (timestamp_utc)),
chosen AS MATERIALIZED (SELECT *, CASE WHEN intersection_v2 > intersection_v1 THEN 'v2' ELSE 'v1' END AS convention FROM choice)"""


@query(f"WITH {_CANDIDATES} SELECT intersection_v1, intersection_v2, convention FROM chosen")
def parser_choice_by_overlap(t):
    return G.convention_overlap(raw_price(t), order_consumption(t))


@query(
    f"""WITH {_CANDIDATES} SELECT c.timestamp_utc, round(oc.consumo_mwh, 4) + 0.0 AS consumo_mwh, round(preco_eur_mwh, 4) + 0.0 AS preco_eur_mwh,
      round(oc.consumo_mwh * preco_eur_mwh) + 0.0 AS custo_estimado_eur, delivery_date_local, market_hour,
      CASE c.convention WHEN 'v1' THEN 'v1_hour_minus_1' ELSE 'v2_hour_direct' END AS price_parser_version
    FROM cand c JOIN chosen x ON c.convention = x.convention JOIN oc ON oc.timestamp_utc = c.timestamp_utc"""
)
def gold_cost_hourly(t):
    out = G.gold_cost_hourly(order_consumption(t), raw_price(t))
    return rounded(rounded(out, ["consumo_mwh", "preco_eur_mwh"], 4), ["custo_estimado_eur"], 0)


@query(f"WITH {_CANDIDATES} SELECT timestamp_utc, preco_eur_mwh FROM cand WHERE convention = 'v1'")
def last_write_wins_price(t):
    return G.price_candidates(raw_price(t), ["v1"]).select("timestamp_utc", "preco_eur_mwh")


@query(
    """SELECT date_trunc('hour', ts) AS timestamp_utc, round(sum(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END * 0.25), 6) + 0.0 AS consumo_mwh
    FROM events WHERE event_id % 7 <> 0 GROUP BY 1"""
)
def hourly_energy_from_power(t):
    readings = t.events.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("datahora"),
        F.when(F.col("event_id") % 7 == 0, "n/d").otherwise(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(","))).alias("total"),
    )
    return rounded(G.cost_consumption_hourly(readings))


# ---- windows ----


def _neighbour_sql(kind: str, m: str) -> str:
    side = "last_value({m} IGNORE NULLS) OVER (PARTITION BY series ORDER BY timestamp_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    if kind == "next":
        side = "first_value({m} IGNORE NULLS) OVER (PARTITION BY series ORDER BY timestamp_utc ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"round({side.format(m=m)}, 6) + 0.0 AS {kind}_{m}"


@query(f"WITH {GOLD_S} SELECT series, timestamp_utc, {', '.join(_neighbour_sql('prev', m) for m in GOLD_MEASURES)} FROM gold_s")
def previous_known_values(t):
    out = T.neighbour_known_values(balance_by_series(t), GOLD_MEASURES, SERIES, bucket=BUCKET)
    return rounded(out.select("series", "timestamp_utc", *[f"prev_{m}" for m in GOLD_MEASURES]))


@query(f"WITH {GOLD_S} SELECT series, timestamp_utc, {', '.join(_neighbour_sql('next', m) for m in GOLD_MEASURES)} FROM gold_s")
def next_known_values(t):
    out = T.neighbour_known_values(balance_by_series(t), GOLD_MEASURES, SERIES, bucket=BUCKET)
    return rounded(out.select("series", "timestamp_utc", *[f"next_{m}" for m in GOLD_MEASURES]))


_LAGS = (1, 2, 3, 6, 12, 24)
_LAG_MEASURES = ("consumo_total_kwh", "producao_total_kwh", "saldo_kwh", "ratio_producao_consumo")
_LAG_NAMES = [f"{m}_lag_{k}" for m in _LAG_MEASURES for k in _LAGS]


def _lags_sql(over: str) -> str:
    return ", ".join(f"round(lag({m}, {k}) OVER ({over}), 6) + 0.0 AS {m}_lag_{k}" for m in _LAG_MEASURES for k in _LAGS)


@query(f"WITH {GOLD_S} SELECT series, timestamp_utc, {_lags_sql('PARTITION BY series ORDER BY timestamp_utc')} FROM gold_s")
def positional_lags(t):
    out = T.add_lags(balance_by_series(t), _LAG_MEASURES, _LAGS, SERIES, bucket=BUCKET)
    return rounded(out.select("series", "timestamp_utc", *_LAG_NAMES))


@query(
    f"""WITH {GOLD_S} SELECT g.series, g.timestamp_utc, {', '.join(f'round(l{k}.saldo_kwh, 6) + 0.0 AS saldo_kwh_lag_{k}' for k in _LAGS)} FROM gold_s g
    {' '.join(f'LEFT JOIN gold_s l{k} ON l{k}.series = g.series AND l{k}.timestamp_utc = g.timestamp_utc - INTERVAL {k} HOUR' for k in _LAGS)}"""
)
def time_aware_lags(t):
    out = T.add_lags(balance_by_series(t), ["saldo_kwh"], _LAGS, SERIES, time_aware=True, bucket=BUCKET)
    return rounded(out.select("series", "timestamp_utc", *[f"saldo_kwh_lag_{k}" for k in _LAGS]))


@query(f"WITH {GOLD} SELECT timestamp_utc, {_lags_sql('ORDER BY timestamp_utc')} FROM gold")
def positional_lags_single_series(t):
    out = T.add_lags(balance(t), _LAG_MEASURES, _LAGS, bucket=BUCKET)
    return rounded(out.select("timestamp_utc", *_LAG_NAMES))


@query(
    f"WITH {GOLD_S} SELECT series, timestamp_utc, lead(flag_defice) OVER (PARTITION BY series ORDER BY timestamp_utc) AS alvo FROM gold_s"
)
def next_row_target(t):
    out = T.add_lead(balance_by_series(t), "flag_defice", "alvo", series=SERIES, bucket=BUCKET)
    return out.select("series", "timestamp_utc", "alvo")


@query(
    f"""WITH {GOLD_S} SELECT series, timestamp_utc, round(CASE WHEN count(*) OVER (PARTITION BY series ORDER BY timestamp_utc ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) = 24
      THEN avg(consumo_total_kwh) OVER (PARTITION BY series ORDER BY timestamp_utc RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) END, 6) + 0.0 AS media FROM gold_s"""
)
def rolling_day_mean(t):
    out = T.add_rolling_means(balance_by_series(t), {"media": "consumo_total_kwh"}, 24, SERIES, bucket=BUCKET)
    return rounded(out.select("series", "timestamp_utc", "media"))


# ---- backfill and projection ----

_FILL = ", ".join(
    f"""coalesce((last_value({m} IGNORE NULLS) OVER b + first_value({m} IGNORE NULLS) OVER a) / 2,
      last_value({m} IGNORE NULLS) OVER b, first_value({m} IGNORE NULLS) OVER a) AS {m}"""
    for m in GOLD_MEASURES
)
_BACKFILL = f"""{_CAL},
base AS (SELECT c.series, c.timestamp_utc, {', '.join(GOLD_MEASURES)}, g.timestamp_utc IS NULL AS row_missing
  FROM cal c LEFT JOIN gold_s g ON g.series = c.series AND g.timestamp_utc = c.timestamp_utc),
nb AS (SELECT series, timestamp_utc, row_missing, {_FILL} FROM base
  WINDOW b AS (PARTITION BY series ORDER BY timestamp_utc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (PARTITION BY series ORDER BY timestamp_utc ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
filled AS (SELECT *, producao_total_kwh - consumo_total_kwh AS saldo_kwh,
  CASE WHEN consumo_total_kwh <> 0 THEN producao_total_kwh / consumo_total_kwh END AS ratio_producao_consumo,
  coalesce(producao_total_kwh < consumo_total_kwh, false) AS flag_defice, coalesce(producao_total_kwh > consumo_total_kwh, false) AS flag_excedente,
  true AS flag_missing_source FROM nb WHERE row_missing)"""


@query(f"WITH {GOLD_S}, {_BACKFILL} SELECT series, {GOLD_OUT} FROM filled")
def backfill_missing_hours(t):
    return rounded(T.backfill_missing_hours(balance_by_series(t), SERIES, BUCKET), MEASURES)


@query(
    f"""WITH {GOLD_S}, {_BACKFILL} SELECT series, {GOLD_OUT}, 'imputed' AS origin FROM filled
    UNION ALL SELECT series, {GOLD_OUT}, 'observed' FROM gold_s"""
)
def balance_with_imputed_hours(t):
    gold = G.gold_balance_hourly(consumption(t), production(t), SERIES, origin=True)
    return rounded(gold.unionByName(T.backfill_missing_hours(gold, SERIES, BUCKET)), MEASURES)


PROJECT_AS_OF = datetime(2024, 2, 10, 7, 45)



@query(
    f"""WITH {GOLD_S} SELECT series, max(timestamp_utc) AS last_ts, {', '.join(f'round(arg_max({m}, timestamp_utc) FILTER ({m} > 0), 6) + 0.0 AS {m}' for m in GOLD_MEASURES)}
    FROM gold_s GROUP BY series"""
)
def latest_positive_values(t):
    return rounded(T.latest_positive(balance_by_series(t), GOLD_MEASURES, SERIES))


def _wave(m: str) -> str:
    p = T.PROJECTION[m]
    return (
        f"greatest({p['floor']}, coalesce({m}, {p['default']}) * (1 + {p['amplitude']} * sin(2 * pi() * ((hour(h) + {p['phase']}) / 24.0::DOUBLE))) "
        f"* (1 + 0.02 * sin(2 * pi() * (dayofyear(h) / 365.0::DOUBLE)))) AS {m}"
    )


_PROJECT = f"""
lp AS (SELECT series, max(timestamp_utc) AS last_ts, {', '.join(f'arg_max({m}, timestamp_utc) FILTER ({m} > 0) AS {m}' for m in GOLD_MEASURES)} FROM gold_s GROUP BY series),
hrs AS (SELECT *, unnest(generate_series(last_ts + INTERVAL 1 HOUR, TIMESTAMP '2024-02-10 07:00:00', INTERVAL 1 HOUR)) AS h FROM lp),
raw AS (SELECT series, h AS timestamp_utc, {', '.join(_wave(m) for m in GOLD_MEASURES)} FROM hrs),
marg AS (SELECT series, timestamp_utc, consumo_total_kwh, producao_dgm_kwh, producao_pre_kwh, greatest(consumo_total_kwh * 1.03, producao_total_kwh *
   (1.04 + 0.05 * sin(2 * pi() * ((hour(timestamp_utc) + 6) / 24.0::DOUBLE)) + 0.03 * (((epoch(timestamp_utc)::BIGINT // 3600) * 7919 % 1000) / 1000.0::DOUBLE - 0.5))) AS producao_total_kwh FROM raw),
proj AS (SELECT *, producao_total_kwh - consumo_total_kwh AS saldo_kwh, producao_total_kwh / consumo_total_kwh AS ratio_producao_consumo,
   false AS flag_defice, true AS flag_excedente, true AS flag_missing_source FROM marg)"""


@query(f"WITH {GOLD_S}, {_PROJECT} SELECT series, {GOLD_OUT} FROM proj")
def project_forward(t):
    return rounded(T.project_forward(balance_by_series(t), PROJECT_AS_OF, SERIES), MEASURES)


# ---- market, features, cost, weather, trend ----

_MARKET = f"""{COST},
mk AS (SELECT timestamp_utc, consumo_mwh AS consumo_total, preco_eur_mwh AS market_price_pt FROM cost),
market AS (SELECT *, CAST(timestamp_utc AS DATE) AS date, CAST(year(timestamp_utc) AS INTEGER) AS year, CAST(month(timestamp_utc) AS INTEGER) AS month,
  CAST(day(timestamp_utc) AS INTEGER) AS day, CAST(hour(timestamp_utc) AS INTEGER) AS hour, CAST(isodow(timestamp_utc) AS INTEGER) AS day_of_week,
  isodow(timestamp_utc) >= 6 AS is_weekend, lag(consumo_total) OVER w AS consumo_lag_1h, lag(consumo_total, 24) OVER w AS consumo_lag_24h,
  lag(market_price_pt) OVER w AS price_lag_1h,
  CASE WHEN row_number() OVER w >= 24 THEN avg(consumo_total) OVER d END AS rolling_avg_consumo_24h,
  CASE WHEN row_number() OVER w >= 24 THEN avg(market_price_pt) OVER d END AS rolling_avg_price_24h, DATE '2024-02-01' AS process_date
  FROM mk WINDOW w AS (ORDER BY timestamp_utc), d AS (ORDER BY timestamp_utc RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW))"""
_MARKET_DOUBLES = ["consumo_total", "market_price_pt", "consumo_lag_1h", "consumo_lag_24h", "price_lag_1h", "rolling_avg_consumo_24h", "rolling_avg_price_24h"]


def _market(t):
    c = consumption_mwh(t).withColumnRenamed("consumo_mwh", "consumo_total")
    p = price_hourly(t).withColumnRenamed("preco_eur_mwh", "market_price_pt")
    return G.gold_market_hourly(c, p, "2024-02-01")


@query(
    f"""WITH {_MARKET} SELECT timestamp_utc, date, year, month, day, hour, day_of_week, is_weekend, {sql_round(_MARKET_DOUBLES, 8)}, process_date FROM market"""
)
def gold_market_hourly(t):
    return rounded(_market(t), digits=8)


@query(
    f"""WITH {_MARKET}, f AS (SELECT *, lead(consumo_total) OVER (ORDER BY timestamp_utc) AS consumo_next_hour FROM market)
    SELECT timestamp_utc, hour, day_of_week, is_weekend, {sql_round(_MARKET_DOUBLES + ['consumo_next_hour'], 8)}, process_date FROM f
    WHERE consumo_lag_24h IS NOT NULL AND rolling_avg_consumo_24h IS NOT NULL AND rolling_avg_price_24h IS NOT NULL AND price_lag_1h IS NOT NULL AND consumo_next_hour IS NOT NULL"""
)
def gold_load_features_hourly(t):
    return rounded(G.gold_load_features_hourly(_market(t)), digits=8)


def _weather(t):
    return t.events.where("event_type = 'click'").select(
        "ts", F.col("value").alias("temp_c"), (F.col("value") / 10).alias("precip_mm"), (F.col("value") / 2).alias("wind_kmh"),
        (F.col("value") * 3).alias("shortwave_radiation"))


_WEATHER = """wd AS (SELECT CAST(ts AS DATE) AS date_utc, avg(value) AS temp_mean_c, max(value) AS temp_max_c, min(value) AS temp_min_c,
  sum(value / 10) AS precip_total_mm, avg(value / 2) AS wind_mean_kmh, max(value / 2) AS wind_max_kmh, sum(value * 3) AS shortwave_radiation_sum
  FROM events WHERE event_type = 'click' GROUP BY 1 HAVING count(*) >= 24)"""
_WEATHER_COLS = ["temp_mean_c", "temp_max_c", "temp_min_c", "precip_total_mm", "wind_mean_kmh", "wind_max_kmh", "shortwave_radiation_sum"]


@query(f"WITH {_WEATHER} SELECT date_utc, {sql_round(_WEATHER_COLS, 5)} FROM wd")
def weather_daily(t):
    return rounded(G.weather_daily(_weather(t)), digits=5)


@query(
    f"""WITH {GOLD}, {_WEATHER}, pd AS (SELECT CAST(timestamp_utc AS DATE) AS date_utc, sum(producao_total_kwh) / 1000 AS producao_total_mwh,
      sum(producao_pre_kwh) / 1000 AS producao_pre_mwh, sum(producao_dgm_kwh) / 1000 AS producao_dgm_mwh FROM gold GROUP BY 1)
    SELECT w.date_utc, {sql_round(_WEATHER_COLS + ['producao_total_mwh', 'producao_pre_mwh', 'producao_dgm_mwh'], 5)}, 'v1' AS feature_set_version
    FROM wd w JOIN pd ON w.date_utc = pd.date_utc WHERE producao_total_mwh IS NOT NULL"""
)
def weather_daily_features(t):
    return rounded(G.weather_daily_features(_weather(t), balance(t), "v1"), digits=5)


@query(
    f"""WITH {GOLD}, m AS (SELECT date_trunc('day', timestamp_utc) AS periodo_inicio, sum(saldo_kwh) AS saldo_kwh, count(*) FILTER (flag_defice) AS horas_defice FROM gold GROUP BY 1),
    n AS (SELECT *, row_number() OVER (ORDER BY periodo_inicio) AS i, saldo_kwh - lag(saldo_kwh) OVER (ORDER BY periodo_inicio) AS variacao_saldo_kwh FROM m)
    SELECT periodo_inicio, horas_defice, {sql_round(['saldo_kwh', 'variacao_saldo_kwh'], 5)}, round((SELECT regr_slope(saldo_kwh, i) FROM n), 5) + 0.0 AS declive_saldo_kwh FROM n"""
)
def imbalance_trend(t):
    return rounded(G.imbalance_trend(balance(t), "day"), digits=5)


_TRAINING_SQL = f"""f AS (SELECT timestamp_utc, CAST(lead(flag_defice) OVER w AS INTEGER) AS target_defice_t_plus_1,
      CAST(hour(timestamp_utc) AS INTEGER) AS hour, CAST(isodow(timestamp_utc) - 1 AS INTEGER) AS day_of_week, CAST(month(timestamp_utc) AS INTEGER) AS month,
      {_lags_sql('ORDER BY timestamp_utc')} FROM gold WINDOW w AS (ORDER BY timestamp_utc))"""
_TRAINING_WHERE = f"WHERE target_defice_t_plus_1 IS NOT NULL AND {' AND '.join(f'{n} IS NOT NULL' for n in _LAG_NAMES)}"


@query(f"WITH {GOLD}, {_TRAINING_SQL} SELECT * FROM f {_TRAINING_WHERE}")
def deficit_training_rows(t):
    return rounded(deficit_features(balance(t)))


@query(
    f"""WITH {GOLD}, f AS (SELECT timestamp_utc, CAST(hour(timestamp_utc) AS INTEGER) AS hour, CAST(isodow(timestamp_utc) - 1 AS INTEGER) AS day_of_week,
      CAST(month(timestamp_utc) AS INTEGER) AS month, {_lags_sql('ORDER BY timestamp_utc')} FROM gold)
    SELECT * FROM f ORDER BY timestamp_utc DESC LIMIT 1"""
)
def latest_inference_row(t):
    return rounded(latest_features(balance(t), check=False))


@query(
    f"""WITH {GOLD_S}, f AS (SELECT series, timestamp_utc, CAST(hour(timestamp_utc) AS INTEGER) AS hour, CAST(isodow(timestamp_utc) - 1 AS INTEGER) AS day_of_week,
      CAST(month(timestamp_utc) AS INTEGER) AS month, CAST(least(count(*) OVER (PARTITION BY series), 25) AS INTEGER) AS rows_seen,
      {_lags_sql('PARTITION BY series ORDER BY timestamp_utc')} FROM gold_s)
    SELECT *, {' AND '.join(f'{n} IS NOT NULL' for n in _LAG_NAMES)} AS ready FROM f QUALIFY row_number() OVER (PARTITION BY series ORDER BY timestamp_utc DESC) = 1"""
)
def latest_inference_rows_by_series(t):
    """The newest hour of every series with its features, and whether they are all known."""
    return rounded(latest_features(balance_by_series(t), series=SERIES))
