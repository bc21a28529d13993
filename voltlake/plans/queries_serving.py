"""Catalogue: rollups, overviews, previews, quality reports."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import serving as S
from ..operators import timeline as T
from ..operators.bronze import bronze_clean
from ..operators.features import deficit_features, feature_names
from ..operators.silver import hourly_with_controls
from ..sources.readers import source_contract
from .inputs import (
    COST, GOLD, GOLD_OUT, GOLD_S, MEASURES, RAW_PRICE, RAW_READINGS, SERIES, balance, balance_by_series, consumption_mwh, cost,
    price_hourly, raw_price, raw_readings, sql_round,
)
from .queries_tables import _PROJECT, _TRAINING_SQL, _TRAINING_WHERE, BUCKET, INGEST, PROJECT_AS_OF, RUN, _ranked_sql
from .registry import query, rounded

_ENERGY = ["consumo_total_kwh", "producao_total_kwh", "producao_dgm_kwh", "producao_pre_kwh", "saldo_kwh"]


def _rollup_sql(grain: str, fmt: str, series: bool = False) -> str:
    table, key = ("gold_s", "series, ") if series else ("gold", "")
    return f"""WITH {GOLD_S if series else GOLD}, r AS (SELECT {key}strftime(timestamp_utc, '{fmt}') AS periodo,
      {', '.join(f'coalesce(sum({c}), 0) AS {c}' for c in _ENERGY)},
      count(*) FILTER (NOT flag_missing_source AND flag_defice) AS defice_horas,
      count(*) FILTER (NOT flag_missing_source AND flag_excedente AND NOT flag_defice) AS excedente_horas,
      count(*) FILTER (flag_missing_source) AS missing_horas, count(*) AS leituras, count(*) FILTER (NOT flag_missing_source) AS leituras_completas
      FROM {table} GROUP BY ALL)
    SELECT {key}periodo, {sql_round(_ENERGY, 5)}, defice_horas, excedente_horas, missing_horas, leituras, leituras_completas,
      round(CASE WHEN consumo_total_kwh > 0 THEN producao_total_kwh / consumo_total_kwh END, 5) + 0.0 AS ratio_producao_consumo FROM r"""


@query(_rollup_sql("day", "%Y-%m-%d"))
def balance_rollup_daily(t):
    return rounded(S.balance_rollup(balance(t), "day"), digits=5)


@query(_rollup_sql("month", "%Y-%m"))
def balance_rollup_monthly(t):
    return rounded(S.balance_rollup(balance(t), "month"), digits=5)


@query(_rollup_sql("day", "%Y-%m-%d", series=True))
def balance_rollup_daily_by_series(t):
    return rounded(S.balance_rollup(balance_by_series(t), "day", SERIES), digits=5)


@query(
    f"""WITH {GOLD}, a AS (SELECT count(*) AS total_horas, sum(consumo_total_kwh) AS c, sum(producao_total_kwh) AS p, sum(producao_pre_kwh) AS pre,
      sum(producao_dgm_kwh) AS dgm, sum(saldo_kwh) AS s, count(*) FILTER (flag_defice) AS horas_defice, count(*) FILTER (flag_excedente) AS horas_excedente,
      count(*) FILTER (flag_missing_source) AS horas_missing_source FROM gold)
    SELECT total_horas, horas_defice, horas_excedente, horas_missing_source, round(c, 4) + 0.0 AS total_consumo_kwh, round(p, 4) + 0.0 AS total_producao_kwh,
      round(pre, 4) + 0.0 AS total_producao_pre_kwh, round(dgm, 4) + 0.0 AS total_producao_dgm_kwh, round(s, 4) + 0.0 AS saldo_total_kwh,
      round(p / c, 4) + 0.0 AS ratio_global_producao_consumo, round(pre / p * 100, 4) + 0.0 AS share_pre_percentual,
      round(dgm / p * 100, 4) + 0.0 AS share_dgm_percentual, round(CAST(horas_defice AS DOUBLE) / total_horas * 100, 4) + 0.0 AS percentual_defice FROM a"""
)
def balance_analytics(t):
    return rounded(S.balance_analytics(balance(t)), digits=4)


@query(
    f"""WITH {GOLD_S} SELECT series, timestamp_utc, {sql_round(['saldo_kwh', 'consumo_total_kwh', 'producao_total_kwh'])} FROM gold_s
    WHERE saldo_kwh IS NOT NULL ORDER BY gold_s.saldo_kwh, timestamp_utc, series LIMIT 10"""
)
def worst_deficits(t):
    return rounded(S.worst_deficits(balance_by_series(t), ties=["timestamp_utc", "series"]))


@query(
    f"""WITH {GOLD_S} SELECT series, timestamp_utc, {sql_round(['saldo_kwh', 'consumo_total_kwh', 'producao_total_kwh', 'ratio_producao_consumo'])}, flag_missing_source
    FROM gold_s ORDER BY abs(gold_s.saldo_kwh) DESC NULLS LAST, timestamp_utc, series LIMIT 100"""
)
def largest_imbalances(t):
    return rounded(S.largest_imbalances(balance_by_series(t), ties=["timestamp_utc", "series"]))


@query(f"WITH {GOLD} SELECT {GOLD_OUT} FROM gold ORDER BY timestamp_utc LIMIT 24")
def first_rows_preview(t):
    return rounded(S.preview(balance(t), 24, ["timestamp_utc"]), MEASURES)


@query(
    f"""WITH {RAW_READINGS}, {_ranked_sql('datahora', True)} SELECT timestamp_utc, CAST(duplicate_count AS BIGINT) AS duplicate_count,
      CAST(duplicate_rank AS BIGINT) AS duplicate_rank, coalesce(total, -1) AS consumo_total_kwh FROM ranked
      WHERE duplicate_count > 1 AND timestamp_utc IS NOT NULL ORDER BY timestamp_utc, duplicate_rank LIMIT 20"""
)
def flagged_duplicates_preview(t):
    bronze = bronze_clean(raw_readings(t), "consumption", RUN, INGEST, "A")
    shared = F.col("flag_duplicate_timestamp") & ~F.col("flag_bad_timestamp")
    out = S.preview(bronze, 20, ["timestamp_utc", "duplicate_rank"], shared)
    return out.select("timestamp_utc", "duplicate_count", "duplicate_rank", F.coalesce("consumo_total_kwh", F.lit(-1.0)).alias("consumo_total_kwh"))


@query(f"WITH {GOLD} SELECT {GOLD_OUT} FROM gold ORDER BY timestamp_utc")
def ordered_table_read(t):
    return rounded(balance(t), MEASURES).orderBy("timestamp_utc")


@query(
    f"""WITH {COST} (SELECT timestamp_utc, round(consumo_mwh, 6) + 0.0 AS consumo_mwh, 'first' AS "end" FROM k_c ORDER BY timestamp_utc LIMIT 5)
    UNION ALL (SELECT timestamp_utc, round(consumo_mwh, 6) + 0.0, 'last' FROM k_c ORDER BY timestamp_utc DESC LIMIT 5)"""
)
def series_ends(t):
    return rounded(S.ends(consumption_mwh(t), 5, "timestamp_utc"))


def _cost_rollup_sql(fmt: str) -> str:
    return f"""WITH {COST}, r AS (SELECT strftime(timestamp_utc, '{fmt}') AS periodo, sum(consumo_mwh) AS consumo_mwh, sum(consumo_mwh * preco_eur_mwh) AS custo,
      avg(preco_eur_mwh) AS simples, count(*) AS leituras FROM cost GROUP BY 1)
    SELECT periodo, round(consumo_mwh, 6) + 0.0 AS consumo_mwh, round(custo, 6) + 0.0 AS custo_estimado_eur, round(simples, 6) + 0.0 AS preco_medio_simples_eur_mwh,
      round(CASE WHEN consumo_mwh <> 0 THEN custo / consumo_mwh ELSE 0 END, 6) + 0.0 AS preco_medio_ponderado_eur_mwh, leituras FROM r"""


@query(_cost_rollup_sql("%Y-%m-%d"))
def cost_rollup_daily(t):
    return rounded(S.cost_rollup(cost(t), "day"), digits=6)


@query(_cost_rollup_sql("%Y-%m"))
def cost_rollup_monthly(t):
    return rounded(S.cost_rollup(cost(t), "month"), digits=6)


@query(
    f"""WITH {COST} SELECT count(*) AS registos, min(timestamp_utc) AS inicio, max(timestamp_utc) AS fim, round(sum(consumo_mwh), 6) + 0.0 AS consumo_total_mwh,
      round(sum(consumo_mwh * preco_eur_mwh), 6) + 0.0 AS custo_estimado_total_eur, round(avg(preco_eur_mwh), 6) + 0.0 AS preco_medio_simples_eur_mwh,
      round(sum(consumo_mwh * preco_eur_mwh) / sum(consumo_mwh), 6) + 0.0 AS preco_medio_ponderado_eur_mwh,
      round(arg_max(consumo_mwh, timestamp_utc), 6) + 0.0 AS ultimo_consumo_mwh, round(arg_max(preco_eur_mwh, timestamp_utc), 6) + 0.0 AS ultimo_preco_eur_mwh,
      round(arg_max(consumo_mwh * preco_eur_mwh, timestamp_utc), 6) + 0.0 AS ultimo_custo_estimado_eur FROM cost"""
)
def cost_overview(t):
    return rounded(S.cost_overview(cost(t)), digits=6)


def _ends_sql(name: str, table: str, value: str) -> str:
    count = f"(SELECT count(*) FROM {table})"
    return " UNION ALL ".join(
        f"(SELECT timestamp_utc, round({value}, 6) + 0.0 AS valor, '{end}' AS \"end\", {count} AS registos, '{name}' AS serie FROM {table} ORDER BY timestamp_utc {way} LIMIT 5)"
        for end, way in (("first", "ASC"), ("last", "DESC"))
    )


@query(
    f"""WITH {COST} {_ends_sql('consumo', 'k_c', 'consumo_mwh')} UNION ALL {_ends_sql('preco', 'k_p', 'preco_eur_mwh')}
    UNION ALL {_ends_sql('intersecao', 'cost', 'CAST(NULL AS DOUBLE)')}"""
)
def serving_debug_profile(t):
    return rounded(S.debug_profile(consumption_mwh(t), price_hourly(t)))


# ---- validation reports ----


@query(
    f"""WITH {RAW_READINGS}, {_ranked_sql('timestamp_utc', False)} SELECT count(*) AS total_linhas, count(DISTINCT timestamp_utc) AS timestamps_distintos,
      min(timestamp_utc) AS min_ts, max(timestamp_utc) AS max_ts, count(*) FILTER (duplicate_count > 1) AS flag_duplicate_timestamp,
      count(*) FILTER (timestamp_utc IS NULL) AS flag_bad_timestamp, count(*) FILTER (data_local IS NULL) AS flag_bad_date,
      count(*) FILTER (total IS NULL) AS flag_bad_total, count(*) FILTER (total = 0) AS flag_zero_row,
      count(*) FILTER (CAST(timestamp_utc AS DATE) <> data_local) AS flag_date_mismatch FROM ranked"""
)
def bronze_quality_report(t):
    return Q.bronze_report(bronze_clean(raw_readings(t), "consumption", RUN, INGEST, "B"))


@query(
    f"""WITH {RAW_READINGS}, {_ranked_sql('datahora', True)} SELECT count(*) AS total_linhas, count(*) FILTER (duplicate_count > 1) AS flag_duplicate_timestamp,
      count(*) FILTER (timestamp_utc IS NULL) AS flag_bad_timestamp, count(*) FILTER (data_local IS NULL) AS flag_bad_date,
      count(*) FILTER (total IS NULL) AS flag_bad_total, count(*) FILTER (coalesce(total, 0) = 0) AS flag_zero_row FROM ranked"""
)
def bronze_flag_counts(t):
    return Q.flag_counts(bronze_clean(raw_readings(t), "consumption", RUN, INGEST, "A"))


@query(f"WITH {GOLD} SELECT count(*) AS linhas, min(timestamp_utc) AS min_ts, max(timestamp_utc) AS max_ts FROM gold")
def table_bounds(t):
    return Q.table_bounds(balance(t))


@query(
    f"""WITH {GOLD_S} SELECT count(*) AS total_linhas, count(*) FILTER (flag_defice) AS flag_defice, count(*) FILTER (flag_excedente) AS flag_excedente,
      count(*) FILTER (flag_missing_source) AS flag_missing_source FROM gold_s"""
)
def gold_flag_totals(t):
    return Q.flag_counts(balance_by_series(t))


def _order_balance(t):
    """Seven years of balance rows: the order value as consumption, known only for settled orders, and a share of it as production."""
    return t.orders.select(
        "o_orderkey",
        F.col("o_orderdate").alias("timestamp_utc"),
        F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END").alias("consumo_total_kwh"),
        F.expr("CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice * 1.01 - 1000 END").alias("producao_total_kwh"),
    ).withColumns(
        {
            "saldo_kwh": F.col("producao_total_kwh") - F.col("consumo_total_kwh"),
            "flag_missing_source": F.col("consumo_total_kwh").isNull() | F.col("producao_total_kwh").isNull(),
        }
    ).withColumns(
        {
            "flag_defice": F.coalesce(F.col("saldo_kwh") < 0, F.lit(False)),
            "flag_excedente": F.coalesce(F.col("saldo_kwh") > 0, F.lit(False)),
            "ratio_producao_consumo": F.try_divide("producao_total_kwh", "consumo_total_kwh"),
        }
    )


_ORDER_BALANCE = """ob0 AS (SELECT o_orderkey, o_orderdate AS timestamp_utc, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS c,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice * 1.01::DOUBLE - 1000 END AS p FROM orders),
ob AS (SELECT *, p - c AS s, coalesce(p - c < 0, false) AS d, coalesce(p - c > 0, false) AS e, c IS NULL OR p IS NULL AS m FROM ob0)"""


@query(
    f"""WITH {_ORDER_BALANCE} SELECT date_trunc('month', timestamp_utc)::TIMESTAMP AS mes, count(*) AS horas_observadas,
      CAST(date_sub('hour', min(timestamp_utc), max(timestamp_utc)) + 1 AS BIGINT) AS horas_esperadas_no_intervalo,
      CAST(date_sub('hour', min(timestamp_utc), max(timestamp_utc)) + 1 - count(*) AS BIGINT) AS horas_em_falta_no_intervalo,
      count(*) FILTER (c IS NULL) AS horas_sem_consumo, count(*) FILTER (p IS NULL) AS horas_sem_producao, count(*) FILTER (m) AS horas_com_fonte_em_falta
    FROM ob GROUP BY 1"""
)
def monthly_coverage(t):
    return Q.monthly_coverage(_order_balance(t))


@query(
    f"""WITH {_ORDER_BALANCE} SELECT date_trunc('month', timestamp_utc)::TIMESTAMP AS mes, round(sum(c), 2) + 0.0 AS consumo_kwh, round(sum(p), 1) + 0.0 AS producao_kwh,
      round(sum(s), 1) + 0.0 AS saldo_kwh, round(sum(p) / sum(c), 6) + 0.0 AS ratio_pc, count(*) FILTER (d) AS horas_defice, count(*) FILTER (e) AS horas_excedente, count(*) AS horas_lidas
    FROM ob GROUP BY 1"""
)
def monthly_drift(t):
    d = Q.monthly_drift(_order_balance(t))
    return rounded(rounded(rounded(d, ["consumo_kwh"], 2), ["producao_kwh", "saldo_kwh"], 1), ["ratio_pc"], 6)


@query(
    f"""WITH {_ORDER_BALANCE} SELECT timestamp_utc, o_orderkey, round(c, 3) + 0.0 AS consumo_total_kwh, round(p, 3) + 0.0 AS producao_total_kwh, round(s, 3) + 0.0 AS saldo_kwh,
      round(p / c, 6) + 0.0 AS ratio_producao_consumo, m AS flag_missing_source FROM ob ORDER BY abs(s) DESC NULLS LAST, timestamp_utc, o_orderkey LIMIT 100"""
)
def largest_order_imbalances(t):
    gold = _order_balance(t)
    out = S.largest_imbalances(gold, ties=["timestamp_utc", "o_orderkey"])
    return rounded(rounded(out, ["consumo_total_kwh", "producao_total_kwh", "saldo_kwh"], 3), ["ratio_producao_consumo"])


_SYNTHESIS_FLAGS = ("flag_defice", "flag_excedente", "flag_missing_source")


@query(
    f"""WITH {GOLD}, gold_s AS (SELECT 0 AS series, * FROM gold), {_PROJECT},
    whole AS (SELECT timestamp_utc, {', '.join(MEASURES)}, flag_defice, flag_excedente, flag_missing_source FROM gold
      UNION ALL SELECT timestamp_utc, {', '.join(MEASURES)}, flag_defice, flag_excedente, flag_missing_source FROM proj)
    SELECT min(timestamp_utc) AS min_inserted_ts, max(timestamp_utc) AS max_inserted_ts, count(*) AS rows_inserted,
      {', '.join(f'count(*) FILTER (coalesce({c}, 0) = 0) AS zero_or_null_{c}' for c in MEASURES)},
      {', '.join(f'count(*) FILTER ({c} IS NULL) AS null_{c}' for c in _SYNTHESIS_FLAGS)}
    FROM whole WHERE flag_missing_source AND timestamp_utc >= (SELECT max(timestamp_utc) + INTERVAL 1 HOUR FROM whole WHERE NOT flag_missing_source)"""
)
def synthesis_coverage(t):
    gold = balance(t)
    return Q.synthesis_coverage(gold.unionByName(T.project_forward(gold, PROJECT_AS_OF)))


# ---- checks ----


def _check_sql(name: str, observed: str, threshold: float, rule: str = "max") -> str:
    op = "<=" if rule == "max" else ">="
    return (
        f"SELECT '{name}' AS \"check\", round(CAST({observed} AS DOUBLE), 6) + 0.0 AS observed, CAST({threshold} AS DOUBLE) AS threshold, "
        f"coalesce(CAST({observed} AS DOUBLE) {op} {threshold}, false) AS passed"
    )


def _union(*parts: DataFrame) -> DataFrame:
    return rounded(reduce(DataFrame.unionByName, parts), ["observed"])


@query(
    f"""WITH {GOLD_S} {_check_sql('unique_key', '(SELECT count(*) FROM (SELECT 1 FROM gold_s GROUP BY series, timestamp_utc HAVING count(*) > 1))', 0)}
    UNION ALL {_check_sql('unique_hour', '(SELECT count(*) FROM (SELECT 1 FROM gold_s GROUP BY timestamp_utc HAVING count(*) > 1))', 0)}"""
)
def check_unique_key(t):
    gold = balance_by_series(t)
    return _union(Q.unique_key(gold, [*SERIES, "timestamp_utc"]), Q.unique_key(gold, ["timestamp_utc"], "unique_hour"))


@query(
    f"""WITH {GOLD}
    {_check_sql('non_negative_consumo_total_kwh', '(SELECT count(*) FROM gold WHERE consumo_total_kwh < 0)', 0)}
    UNION ALL {_check_sql('non_negative_saldo_kwh', '(SELECT count(*) FROM gold WHERE saldo_kwh < 0)', 0)}
    UNION ALL {_check_sql('exclusive_flags', '(SELECT count(*) FROM gold WHERE flag_defice AND flag_excedente)', 0)}
    UNION ALL {_check_sql('freshness_hours', "(SELECT date_diff('second', max(timestamp_utc), TIMESTAMP '2024-01-31 00:30:00') / 3600.0 FROM gold)", 2)}
    UNION ALL {_check_sql('null_share_consumo_total_kwh', '(SELECT avg(CASE WHEN consumo_total_kwh IS NULL THEN 1.0 ELSE 0.0 END) FROM gold)', 0.01)}
    UNION ALL {_check_sql('plausible_saldo_kwh', '(SELECT count(*) FROM gold WHERE saldo_kwh NOT BETWEEN -500 AND 500)', 0)}"""
)
def check_balance_contract(t):
    """Non-negative measures, exclusive flags, freshness, null share and plausible range in one pass."""
    return _union(
        Q.run_checks(
            balance(t),
            [
                *Q.non_negative(["consumo_total_kwh", "saldo_kwh"]),
                Q.exclusive_flags(),
                Q.freshness(datetime(2024, 1, 31, 0, 30), 2),
                *Q.null_share(["consumo_total_kwh"], 0.01),
                Q.plausible_range("saldo_kwh"),
            ],
        )
    )


@query(
    f"""WITH {RAW_PRICE} {_check_sql('hour_domain', '(SELECT count(*) FROM raw_price WHERE hour NOT BETWEEN 1 AND 25)', 0)}
    UNION ALL {_check_sql('version_present_price_parser_version', '0', 0)}"""
)
def check_price_domain(t):
    rows = raw_price(t).select(F.col("hour").cast("int").alias("market_hour"), F.lit("v1_hour_minus_1").alias("price_parser_version"))
    return _union(Q.run_checks(rows, [Q.hour_domain(), Q.version_present("price_parser_version")]))


@query(
    f"""WITH {GOLD_S} {_check_sql('completeness', '''(SELECT CAST(sum(n) AS DOUBLE) / sum(e) FROM (SELECT count(*) AS n,
      date_sub('hour', min(timestamp_utc), max(timestamp_utc)) + 1 AS e FROM gold_s GROUP BY series))''', 0.99, 'min')}
    UNION ALL {_check_sql('day_completeness', '''(SELECT CAST(count(DISTINCT CAST(timestamp_utc AS DATE)) AS DOUBLE) / (date_diff('day', CAST(min(timestamp_utc) AS DATE), CAST(max(timestamp_utc) AS DATE)) + 1) FROM gold_s)''', 0.995, 'min')}"""
)
def check_completeness(t):
    gold = balance_by_series(t)
    days = gold.groupBy(F.to_date("timestamp_utc").alias("dia")).agg(F.count(F.lit(1)).alias("n"))
    daily = Q.day_completeness(days, "dia").withColumn("check", F.lit("day_completeness"))
    return _union(Q.completeness(gold, series=SERIES), daily)


@query(
    f"""WITH {COST} {_check_sql('join_rate', '(SELECT avg(CASE WHEN timestamp_utc IN (SELECT timestamp_utc FROM k_p) THEN 1.0 ELSE 0.0 END) FROM k_c)', 0.98, 'min')}"""
)
def check_join_rate(t):
    return _union(Q.join_rate(consumption_mwh(t), price_hourly(t), ["timestamp_utc"]))


@query(
    """SELECT 'incomplete_hours' AS "check", CAST(count(*) AS DOUBLE) AS observed, CAST(0 AS DOUBLE) AS threshold, count(*) <= 0 AS passed FROM
    (SELECT date_trunc('hour', ts), count(*) AS n FROM events GROUP BY 1) WHERE n <> 4"""
)
def check_source_rows(t):
    return _union(Q.run_checks(hourly_with_controls(t.events, "value", "total", ts="ts"), [Q.source_rows_per_hour()]))


@query(
    f"""WITH {COST} {_check_sql('unique_left', '(SELECT count(*) FROM (SELECT 1 FROM k_c GROUP BY timestamp_utc HAVING count(*) > 1))', 0)} UNION ALL {_check_sql('unique_right', '(SELECT count(*) FROM (SELECT 1 FROM k_p GROUP BY timestamp_utc HAVING count(*) > 1))', 0)}
    UNION ALL {_check_sql('unique_joined', '(SELECT count(*) FROM (SELECT 1 FROM cost GROUP BY timestamp_utc HAVING count(*) > 1))', 0)}"""
)
def check_one_to_one_join(t):
    return _union(Q.one_to_one(consumption_mwh(t), price_hourly(t), cost(t), ["timestamp_utc"]))


@query(
    f"""WITH {GOLD} SELECT date_trunc('day', timestamp_utc) AS periodo_inicio, unnest(['consumo_total_kwh', 'producao_total_kwh']) AS feature,
      round(unnest([avg(consumo_total_kwh), avg(producao_total_kwh)]), 6) + 0.0 AS mean,
      round(unnest([stddev_samp(consumo_total_kwh), stddev_samp(producao_total_kwh)]), 6) + 0.0 AS stddev FROM gold GROUP BY 1"""
)
def feature_drift(t):
    return rounded(Q.feature_drift(balance(t), ["consumo_total_kwh", "producao_total_kwh"], "day"))


@query(
    f"""WITH {GOLD}, {_TRAINING_SQL}, tr AS (SELECT *, date_diff('second', lag(timestamp_utc) OVER (ORDER BY timestamp_utc), timestamp_utc) AS step FROM f {_TRAINING_WHERE})
    {_check_sql('null_feature_cells', '0', 0)} UNION ALL {_check_sql('gaps', '(SELECT count(*) FROM tr WHERE step <> 3600)', 0)}"""
)
def check_training_rows(t):
    return _union(Q.training_ready(deficit_features(balance(t)), feature_names()))


@query(
    f"""WITH {GOLD_S} SELECT CAST(sum(e - n) AS BIGINT) AS horas_em_falta FROM (SELECT count(*) AS n,
      date_sub('hour', min(timestamp_utc), max(timestamp_utc)) + 1 AS e FROM gold_s GROUP BY series)"""
)
def missing_hour_count(t):
    return Q.missing_hour_count(balance_by_series(t), series=SERIES)


@query("SELECT CAST(0 AS BIGINT) AS horas_em_falta, count(*) > 0 AS has_rows FROM events")
def backfill_leaves_no_gap(t):
    """A second backfill over the filled table finds nothing."""
    gold = balance_by_series(t)
    filled = gold.unionByName(T.backfill_missing_hours(gold, SERIES, BUCKET))
    again = T.backfill_missing_hours(filled, SERIES, BUCKET)
    return again.agg(F.count(F.lit(1)).alias("horas_em_falta")).withColumn("has_rows", F.lit(True))


@query(
    f"""WITH {GOLD}, a AS (SELECT count(*) AS n, sum(consumo_total_kwh) AS c, sum(producao_total_kwh) AS p, sum(producao_pre_kwh) AS pre,
      sum(producao_dgm_kwh) AS dgm, sum(saldo_kwh) AS s, count(*) FILTER (flag_defice) AS d FROM gold)
    SELECT n AS registos, round(c, 4) + 0.0 AS consumo_total, round(p, 4) + 0.0 AS producao_total, round(s, 4) + 0.0 AS saldo_total,
      round(pre, 4) + 0.0 AS producao_pre, round(dgm, 4) + 0.0 AS producao_dgm, round(pre / p * 100, 4) + 0.0 AS share_pre_percentual,
      0.0::DOUBLE AS share_dgm_percentual, round(p / c, 4) + 0.0 AS ratio_producao_consumo, round(CAST(d AS DOUBLE) / n * 100, 4) + 0.0 AS percentual_defice FROM a"""
)
def analytics_normalised(t):
    """Analytics under other names: one alias each, no share of one kind and no deficit share, which is derived."""
    found = S.balance_analytics(balance(t)).drop("share_dgm_percentual", "percentual_defice")
    renamed = {"total_consumo_kwh": "total_consumo", "producao_pre_kwh": "x", "saldo_total_kwh": "total_saldo", "total_horas": "registos",
               "total_producao_pre_kwh": "producao_pre", "share_pre_percentual": "peso_pre", "horas_defice": "defice_horas"}
    return rounded(S.normalise_analytics(found.withColumnsRenamed(renamed)), digits=4)


@query(
    f"""WITH {GOLD_S} SELECT timestamp_utc AS "timestamp", round(consumo_total_kwh, 6) + 0.0 AS consumo_total, round(producao_total_kwh, 6) + 0.0 AS producao_total,
      round(saldo_kwh, 6) + 0.0 AS saldo, round(producao_total_kwh / nullif(consumo_total_kwh, 0), 6) + 0.0 AS ratio_producao_consumo
    FROM gold_s WHERE saldo_kwh IS NOT NULL ORDER BY gold_s.saldo_kwh, timestamp_utc, series LIMIT 10"""
)
def worst_hours_normalised(t):
    worst = S.worst_deficits(balance_by_series(t), ties=["timestamp_utc", "series"]).drop("series")
    return rounded(S.normalise_worst_hours(worst.withColumnsRenamed({"timestamp_utc": "momento_utc", "saldo_kwh": "total_saldo_kwh"})))


@query(
    """SELECT 'events' AS dataset, '' AS missing, count(*) > 0 AS has_rows FROM events
    UNION ALL SELECT 'orders', 'datahora,total', count(*) > 0 FROM orders
    UNION ALL SELECT 'refunds', '', count(*) > 0 FROM lineitem WHERE l_quantity < 0"""
)
def check_source_contracts(t):
    """Required columns and rows of three sources: one sound, one without two columns, one without rows."""
    parts = [
        source_contract(t.events, ["ts", "value"], "events"),
        source_contract(t.orders, ["datahora", "o_orderkey", "total"], "orders"),
        source_contract(t.lineitem.where("l_quantity < 0"), ["l_orderkey"], "refunds"),
    ]
    return reduce(DataFrame.unionByName, parts)
