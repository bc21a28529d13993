"""Raw text rows to bronze tables: typed columns, quality flags, duplicate ranks. No row is dropped."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import parsing as P
from ..schemas import (
    CONSUMPTION_COMPONENTS,
    CONSUMPTION_TOTAL,
    PRODUCTION_COMPONENTS,
    PRODUCTION_TOTAL,
)
from ..sources.readers import require_columns, source_position, with_lineage
from .ranking import HOT_ROWS, rank_duplicates

_READING_KINDS = {
    "consumption": (CONSUMPTION_COMPONENTS, CONSUMPTION_TOTAL),
    "production": (PRODUCTION_COMPONENTS, PRODUCTION_TOTAL),
}


def _source_file(raw: DataFrame) -> Column:
    return F.col("source_file_name") if "source_file_name" in raw.columns else F.lit(None).cast("string")


def bronze_clean(
    raw: DataFrame,
    kind: str,
    run_id: str,
    ingest_ts: datetime,
    variant: str = "A",
    source_tz: str = "Europe/Lisbon",
    dst: str = "null",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Bronze table of `kind` "consumption", "production" or "price".

    Variant "A" keys duplicates on the raw timestamp text, floors to milliseconds and flags unknown
    totals as zero; variant "B" keys on the parsed instant and adds the date check and lineage columns.
    """
    if kind == "price":
        return _bronze_price(raw, run_id, ingest_ts, source_tz, dst, hot_rows)
    if kind not in _READING_KINDS:
        raise ValueError(f"unknown kind: {kind}")
    components, total = _READING_KINDS[kind]
    return _bronze_readings(raw, kind, components, total, run_id, ingest_ts, variant, hot_rows)


def _bronze_readings(
    raw: DataFrame,
    kind: str,
    components: dict[str, str],
    total: str,
    run_id: str,
    ingest_ts: datetime,
    variant: str,
    hot_rows: int,
) -> DataFrame:
    text = P.trim_strings(
        require_columns(raw, ["datahora", "dia", "mes", "ano", "date", "time", *components, "total"], kind)
    )
    instant = P.offset_timestamp(F.col("datahora"), floor_to_ms=variant == "A")
    typed = text.withColumn("timestamp_utc", instant).select(
        F.col("datahora").alias("datahora_raw"),
        "timestamp_utc",
        *[P.lenient_int(F.col(c)).alias(c) for c in ("dia", "mes", "ano")],
        P.multi_format_date(F.col("date")).alias("data_local"),
        F.col("time").alias("hora_local_raw"),
        *[P.lenient_double(F.col(raw_name)).alias(name) for raw_name, name in components.items()],
        P.lenient_double(F.col("total")).alias(total),
        _source_file(raw).alias("source_file_name"),
        source_position(raw).alias("row_pos"),
    )
    ranked = rank_duplicates(
        typed,
        key="datahora_raw" if variant == "A" else "timestamp_utc",
        value=total,
        position="row_pos",
        null_key_is_group=variant == "A",
        hot_rows=hot_rows,
    )
    flagged = with_lineage(ranked, run_id, ingest_ts).withColumns(
        {
            "flag_bad_timestamp": F.col("timestamp_utc").isNull(),
            "flag_bad_date": F.col("data_local").isNull(),
            "flag_bad_total": F.col(total).isNull(),
            "flag_zero_row": M.zero_flag(F.col(total), variant),
            "flag_date_mismatch": M.date_mismatch_flag(F.col("timestamp_utc"), F.col("data_local")),
        }
    )
    extra = ["flag_date_mismatch", "source_file_name", "run_id"] if variant == "B" else []
    return flagged.select(
        "datahora_raw",
        "timestamp_utc",
        "dia",
        "mes",
        "ano",
        "data_local",
        "hora_local_raw",
        *components.values(),
        total,
        "duplicate_count",
        "duplicate_rank",
        "flag_duplicate_timestamp",
        "flag_bad_timestamp",
        "flag_bad_date",
        "flag_bad_total",
        "flag_zero_row",
        *extra,
        "ingest_ts_utc",
    )


def _bronze_price(
    raw: DataFrame, run_id: str, ingest_ts: datetime, source_tz: str, dst: str, hot_rows: int
) -> DataFrame:
    text = P.trim_strings(require_columns(raw, ["date", "hour", "portugal", "spain"], "price"))
    day_and_hour = {
        "delivery_date_local": P.multi_format_date(F.col("date")),
        "market_hour": P.lenient_int(F.col("hour")),
    }
    instant = P.delivery_hour_to_utc(F.col("delivery_date_local"), F.col("market_hour"), source_tz, dst)
    typed = text.withColumns(day_and_hour).withColumn("timestamp_utc", instant).select(
        F.col("date").alias("date_raw"),
        "delivery_date_local",
        "market_hour",
        "timestamp_utc",
        P.lenient_double(F.col("portugal")).alias("preco_pt_eur_mwh"),
        P.lenient_double(F.col("spain")).alias("preco_es_eur_mwh"),
        _source_file(raw).alias("source_file_name"),
        source_position(raw).alias("row_pos"),
    )
    ranked = rank_duplicates(
        typed, key="timestamp_utc", value="preco_pt_eur_mwh", position="row_pos", hot_rows=hot_rows
    )
    flags = {
        "flag_bad_timestamp": F.col("timestamp_utc").isNull(),
        "flag_bad_date": F.col("delivery_date_local").isNull(),
        "flag_bad_hour": M.bad_hour_flag(F.col("market_hour")),
        "flag_bad_preco_pt": F.col("preco_pt_eur_mwh").isNull(),
        "flag_bad_preco_es": F.col("preco_es_eur_mwh").isNull(),
        "flag_zero_preco_pt": M.zero_flag(F.col("preco_pt_eur_mwh"), "B"),
        "market_timezone_assumed": F.lit(source_tz),
    }
    return with_lineage(ranked, run_id, ingest_ts).withColumns(flags).select(
        "date_raw",
        "delivery_date_local",
        "market_hour",
        "timestamp_utc",
        "preco_pt_eur_mwh",
        "preco_es_eur_mwh",
        "duplicate_count",
        "duplicate_rank",
        "flag_duplicate_timestamp",
        *flags,
        "source_file_name",
        "run_id",
        "ingest_ts_utc",
    )


def preferred_rows(bronze: DataFrame) -> DataFrame:
    """The best row per key with a readable timestamp."""
    return bronze.where((F.col("duplicate_rank") == 1) & ~F.col("flag_bad_timestamp"))
