"""Column layouts of the raw inputs and of every table layer.

The names and types are fixed values: the tables must be readable by existing consumers.
"""

from __future__ import annotations

from pyspark.sql import types as T

STRING, DOUBLE, INT, LONG = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
BOOL, DATE, TS = T.BooleanType(), T.DateType(), T.TimestampNTZType()


def _schema(*groups: tuple[T.DataType, str]) -> T.StructType:
    return T.StructType(
        [T.StructField(name, dtype, True) for dtype, names in groups for name in names.split()]
    )


CONSUMPTION_COMPONENTS = {
    "bt": "consumo_bt_kwh",
    "mt": "consumo_mt_kwh",
    "at": "consumo_at_kwh",
    "mat": "consumo_mat_kwh",
}
PRODUCTION_COMPONENTS = {"dgm": "producao_dgm_kwh", "pre": "producao_pre_kwh"}
CONSUMPTION_TOTAL = "consumo_total_kwh"
PRODUCTION_TOTAL = "producao_total_kwh"

# Raw files, all text on read.
RAW_CONSUMPTION = _schema((STRING, "datahora dia mes ano date time bt mt at mat total"))
RAW_PRODUCTION = _schema((STRING, "datahora dia mes ano date time dgm pre total"))
RAW_PRICE = _schema((STRING, "date hour portugal spain"))

_BRONZE_HEAD = [
    (STRING, "datahora_raw"),
    (TS, "timestamp_utc"),
    (INT, "dia mes ano"),
    (DATE, "data_local"),
    (STRING, "hora_local_raw"),
]
_BRONZE_TAIL = [
    (LONG, "duplicate_count duplicate_rank"),
    (BOOL, "flag_duplicate_timestamp flag_bad_timestamp flag_bad_date flag_bad_total flag_zero_row"),
]
_CONSUMPTION_MEASURES = (DOUBLE, "consumo_bt_kwh consumo_mt_kwh consumo_at_kwh consumo_mat_kwh consumo_total_kwh")
_PRODUCTION_MEASURES = (DOUBLE, "producao_dgm_kwh producao_pre_kwh producao_total_kwh")
_LINEAGE = [(BOOL, "flag_date_mismatch"), (STRING, "source_file_name run_id"), (TS, "ingest_ts_utc")]

BRONZE_CONSUMPTION_A = _schema(*_BRONZE_HEAD, _CONSUMPTION_MEASURES, *_BRONZE_TAIL, (TS, "ingest_ts_utc"))
BRONZE_CONSUMPTION_B = _schema(*_BRONZE_HEAD, _CONSUMPTION_MEASURES, *_BRONZE_TAIL, *_LINEAGE)
BRONZE_PRODUCTION = _schema(*_BRONZE_HEAD, _PRODUCTION_MEASURES, *_BRONZE_TAIL, (TS, "ingest_ts_utc"))
BRONZE_PRICE = _schema(
    (STRING, "date_raw"),
    (DATE, "delivery_date_local"),
    (INT, "market_hour"),
    (TS, "timestamp_utc"),
    (DOUBLE, "preco_pt_eur_mwh preco_es_eur_mwh"),
    (LONG, "duplicate_count duplicate_rank"),
    (
        BOOL,
        "flag_duplicate_timestamp flag_bad_timestamp flag_bad_date flag_bad_hour"
        " flag_bad_preco_pt flag_bad_preco_es flag_zero_preco_pt",
    ),
    (STRING, "market_timezone_assumed source_file_name run_id"),
    (TS, "ingest_ts_utc"),
)

GOLD_BALANCE = _schema(
    (TS, "timestamp_utc"),
    (
        DOUBLE,
        "consumo_total_kwh producao_total_kwh producao_dgm_kwh producao_pre_kwh saldo_kwh ratio_producao_consumo",
    ),
    (BOOL, "flag_defice flag_excedente flag_missing_source"),
)

GOLD_MARKET = _schema(
    (TS, "timestamp_utc"),
    (DATE, "date"),
    (INT, "year month day hour day_of_week"),
    (BOOL, "is_weekend"),
    (
        DOUBLE,
        "consumo_total market_price_pt consumo_lag_1h consumo_lag_24h price_lag_1h"
        " rolling_avg_consumo_24h rolling_avg_price_24h",
    ),
    (DATE, "process_date"),
)
