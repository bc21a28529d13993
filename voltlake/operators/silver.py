"""Bronze to silver: one trusted row per timestamp, or one row per hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.calendar import calendar_columns, hour_bucket
from .ranking import pick_first


def trusted_rows(bronze: DataFrame) -> DataFrame:
    """Rows with a readable timestamp and total."""
    return bronze.where(~F.col("flag_bad_timestamp") & ~F.col("flag_bad_total"))


def pick_order(total: str) -> list[Column]:
    """Non-zero first, larger total, better bronze rank, later ingest; the raw text settles ties."""
    return [
        M.is_true(F.col("flag_zero_row")).cast("int"),
        F.col(total).desc_nulls_last(),
        F.col("duplicate_rank").asc_nulls_last(),
        F.col("ingest_ts_utc").desc_nulls_last(),
        F.col("datahora_raw"),
    ]


def silver_15min(
    bronze: DataFrame,
    total: str,
    components: Sequence[str],
    components_name: str,
    key: str = "timestamp_utc",
    series: Sequence[str] = (),
    tol: float = 0.001,
) -> DataFrame:
    """One row per timestamp with the component sum and its gap to the total."""
    picked = pick_first(trusted_rows(bronze), [*series, key], pick_order(total))
    gap = M.component_gap(total, components)
    wanted = {
        **{c: F.col(c) for c in [*series, key]},
        **{c: F.col(c) for c in ("dia", "mes", "ano", "data_local", "hora_local_raw") if c in bronze.columns},
        **{c: F.col(c) for c in components},
        total: F.col(total),
        components_name: M.component_sum(components),
        "diff_componentes_total_kwh": gap,
        "flag_component_sum_mismatch": gap > tol,
        "flag_duplicate_timestamp": F.col("flag_duplicate_timestamp"),
        "duplicate_count": F.col("duplicate_count"),
        "bronze_duplicate_rank": F.col("duplicate_rank"),
        "flag_zero_row": F.col("flag_zero_row"),
        **{c: F.col(c) for c in ("datahora_raw",) if c in bronze.columns},
        "ingest_ts_utc": F.col("ingest_ts_utc"),
    }
    return picked.select(*[expr.alias(name) for name, expr in wanted.items()])


def hourly_with_controls(
    readings: DataFrame, value: str, out: str, ts: str = "timestamp_utc", series: Sequence[str] = ()
) -> DataFrame:
    """Hourly sum with first and last source instant and the number of source rows."""
    return (
        readings.where(F.col(ts).isNotNull())
        .withColumn("_source_ts", F.col(ts))
        .groupBy(*series, hour_bucket(F.col(ts)).alias(ts))
        .agg(
            F.sum(value).alias(out),
            F.min("_source_ts").alias("source_min_ts"),
            F.max("_source_ts").alias("source_max_ts"),
            F.count(F.lit(1)).alias("source_rows"),
        )
    )


def silver_hourly(bronze: DataFrame, kind: str, process_date: str) -> DataFrame:
    """Hourly silver table from the preferred bronze rows of `kind` "consumption" or "price"."""
    rows = bronze.where((F.col("duplicate_rank") == 1) & ~F.col("flag_bad_timestamp"))
    day = F.lit(process_date).cast("date")
    parts = {c: e for c, e in calendar_columns(F.col("timestamp_utc")).items() if c in ("year", "month", "day", "hour")}
    if kind == "consumption":
        hourly = hourly_with_controls(
            rows.where(~F.col("flag_bad_total")), "consumo_total_kwh", "consumo_total"
        )
        return hourly.select(
            "timestamp_utc",
            *[e.alias(c) for c, e in parts.items()],
            "consumo_total",
            "source_min_ts",
            "source_max_ts",
            "source_rows",
            day.alias("process_date"),
        )
    if kind == "price":
        return rows.where(~F.col("flag_bad_hour") & ~F.col("flag_bad_preco_pt")).select(
            "timestamp_utc",
            *[e.alias(c) for c, e in parts.items()],
            F.col("preco_pt_eur_mwh").alias("market_price_pt"),
            F.col("date_raw").alias("source_date_raw"),
            F.col("market_hour").alias("source_hour_raw"),
            day.alias("process_date"),
        )
    raise ValueError(f"unknown kind: {kind}")
