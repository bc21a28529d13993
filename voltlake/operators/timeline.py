"""Ordered work on time series: windows cut into time buckets, calendars, gap backfill, projection.

A window over one long series would run in one task. Here a series is cut into buckets (a month by
default) and each bucket is its own window partition. What a bucket needs from its neighbours is
brought in as a few marked rows that take part in the window and are dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from ..functions import measures as M
from ..functions.calendar import add_hours, hour_bucket, hours_between, trunc_ntz

BUCKET = "_bucket"
CARRIED = "_carried"
_HOUR = "INTERVAL '1' HOUR"


def bucket_window(series: Sequence[str], order: str | Column) -> WindowSpec:
    return W.partitionBy(*series, BUCKET).orderBy(order)


def main_rows(df: DataFrame) -> DataFrame:
    """Drop the carried rows and the helper columns."""
    return df.where(~F.col(CARRIED)).drop(BUCKET, CARRIED)


def with_known_edges(
    df: DataFrame, measures: Sequence[str], series: Sequence[str], order: str, bucket: str = "month"
) -> DataFrame:
    """Add to each bucket one row before it and one after it.

    The row before holds the newest earlier instant and, per measure, the newest earlier known value;
    the row after mirrors it. The bucket summary has one row per series and bucket.
    """
    base = df.withColumns({BUCKET: trunc_ntz(bucket, F.col(order)), CARRIED: F.lit(False)})
    summary = base.groupBy(*series, BUCKET).agg(
        F.min(order).alias("_first"),
        F.max(order).alias("_last"),
        *[F.min_by(m, F.when(F.col(m).isNotNull(), F.col(order))).alias(f"_first_{m}") for m in measures],
        *[F.max_by(m, F.when(F.col(m).isNotNull(), F.col(order))).alias(f"_last_{m}") for m in measures],
    )
    along = W.partitionBy(*series).orderBy(BUCKET)
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    later = along.rowsBetween(1, W.unboundedFollowing)
    sides = summary.select(
        *series,
        BUCKET,
        F.struct(
            F.last("_last", ignorenulls=True).over(earlier).alias(order),
            *[F.last(f"_last_{m}", ignorenulls=True).over(earlier).alias(m) for m in measures],
        ).alias("_before"),
        F.struct(
            F.first("_first", ignorenulls=True).over(later).alias(order),
            *[F.first(f"_first_{m}", ignorenulls=True).over(later).alias(m) for m in measures],
        ).alias("_after"),
    )
    edges = sides.select(*series, BUCKET, F.explode(F.array("_before", "_after")).alias("_edge"))
    edges = edges.select(*series, BUCKET, "_edge.*")
    edges = edges.where(F.col(order).isNotNull()).withColumn(CARRIED, F.lit(True))
    return base.unionByName(edges, allowMissingColumns=True)


def with_halo(
    df: DataFrame,
    columns: Sequence[str],
    series: Sequence[str],
    order: str,
    before: int = 0,
    after: int = 0,
    bucket: str = "month",
) -> DataFrame:
    """Add to each bucket the last `before` rows ahead of it and the first `after` rows behind it.

    Only `columns` of those rows are carried. A bucket's own edge rows are found with a row-number
    limit, so at most `before + after` rows per bucket leave a map task.
    """
    base = df.withColumns({BUCKET: trunc_ntz(bucket, F.col(order)), CARRIED: F.lit(False)})
    result = base
    for count, newest_first in ((before, True), (after, False)):
        if count == 0:
            continue
        ordering = F.col(order).desc() if newest_first else F.col(order).asc()
        row = F.struct(order, *columns)
        edge = (
            base.select(*series, BUCKET, order, *columns)
            .withColumn("_n", F.row_number().over(W.partitionBy(*series, BUCKET).orderBy(ordering)))
            .where(F.col("_n") <= count)
            .groupBy(*series, BUCKET)
            .agg(F.sort_array(F.collect_list(row)).alias("_rows"))
        )
        # Every bucket in the table has a row, so `count` neighbouring buckets always suffice.
        frame = (-count, -1) if newest_first else (1, count)
        along = W.partitionBy(*series).orderBy(BUCKET).rowsBetween(*frame)
        around = edge.select(*series, BUCKET, F.flatten(F.collect_list("_rows").over(along)).alias("_around"))
        start = F.greatest(F.size("_around") - count, F.lit(0)) + 1 if newest_first else F.lit(1)
        halo = (
            around.select(*series, BUCKET, F.explode(F.slice("_around", start, F.lit(count))).alias("_row"))
            .select(*series, BUCKET, "_row.*")
            .withColumn(CARRIED, F.lit(True))
        )
        result = result.unionByName(halo, allowMissingColumns=True)
    return result


def neighbour_known_values(
    df: DataFrame, measures: Sequence[str], series: Sequence[str] = (), order: str = "timestamp_utc", bucket: str = "month"
) -> DataFrame:
    """Add `prev_<measure>` and `next_<measure>`, the nearest known value strictly before and after a row."""
    w = bucket_window(series, order)
    known = with_known_edges(df, measures, series, order, bucket).withColumns(
        {f"prev_{m}": F.last(m, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)) for m in measures}
        | {f"next_{m}": F.first(m, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)) for m in measures}
    )
    return main_rows(known)


def lag_columns(w: WindowSpec, measures: Sequence[str], lags: Sequence[int]) -> dict[str, Column]:
    return {f"{m}_lag_{k}": F.lag(m, k).over(w) for m in measures for k in lags}


def add_lags(
    df: DataFrame,
    measures: Sequence[str],
    lags: Sequence[int],
    series: Sequence[str] = (),
    order: str = "timestamp_utc",
    time_aware: bool = False,
    bucket: str = "month",
) -> DataFrame:
    """Add `<measure>_lag_<k>`: the value `k` rows earlier, or `k` hours earlier when `time_aware`."""
    halo = with_halo(df, measures, series, order, before=max(lags), bucket=bucket)
    if not time_aware:
        return main_rows(halo.withColumns(lag_columns(bucket_window(series, order), measures, lags)))
    w = bucket_window(series, F.unix_seconds(F.col(order).cast("timestamp")))
    columns = {
        f"{m}_lag_{k}": F.first(m).over(w.rangeBetween(-3600 * k, -3600 * k)) for m in measures for k in lags
    }
    return main_rows(halo.withColumns(columns))


def add_lead(
    df: DataFrame,
    measure: str,
    out: str,
    rows: int = 1,
    series: Sequence[str] = (),
    order: str = "timestamp_utc",
    bucket: str = "month",
) -> DataFrame:
    """Add `out`, the value of `measure` `rows` rows later."""
    halo = with_halo(df, [measure], series, order, after=rows, bucket=bucket)
    return main_rows(halo.withColumn(out, F.lead(measure, rows).over(bucket_window(series, order))))


def rolling_mean_columns(series: Sequence[str], order: str, means: Mapping[str, str], hours: int) -> dict[str, Column]:
    """`{out: measure}` means over the last `hours` hours, null until the series has `hours` rows."""
    w = bucket_window(series, F.unix_seconds(F.col(order).cast("timestamp")))
    started = F.count(F.lit(1)).over(w.rowsBetween(-(hours - 1), 0)) == hours
    span = w.rangeBetween(-3600 * (hours - 1), 0)
    return {out: F.when(started, F.avg(m).over(span)) for out, m in means.items()}


def add_rolling_means(
    df: DataFrame,
    means: Mapping[str, str],
    hours: int = 24,
    series: Sequence[str] = (),
    order: str = "timestamp_utc",
    bucket: str = "month",
) -> DataFrame:
    halo = with_halo(df, list(means.values()), series, order, before=hours - 1, bucket=bucket)
    return main_rows(halo.withColumns(rolling_mean_columns(series, order, means, hours)))


def hourly_calendar(df: DataFrame, key: str = "timestamp_utc", series: Sequence[str] = ()) -> DataFrame:
    """Every hour from the first to the last one of each series; days are exploded before hours."""
    span = df.groupBy(*series).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    lo, hi = hour_bucket(F.col("_lo")), hour_bucket(F.col("_hi"))
    days = span.select(*series, lo.alias("_lo"), hi.alias("_hi")).select(
        *series,
        "_lo",
        "_hi",
        F.explode(F.sequence(F.to_date("_lo"), F.to_date("_hi"), F.expr("INTERVAL '1' DAY"))).alias("_day"),
    )
    hours = days.select(
        *series, "_lo", "_hi", "_day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("_hour")
    ).withColumn(key, add_hours(F.col("_day").cast("timestamp_ntz"), F.col("_hour")))
    return hours.where(F.col(key).between(F.col("_lo"), F.col("_hi"))).select(*series, key)


def missing_hours(df: DataFrame, key: str = "timestamp_utc", series: Sequence[str] = ()) -> DataFrame:
    """Calendar hours without a row."""
    return hourly_calendar(df, key, series).join(df.select(*series, key), [*series, key], "left_anti")


def calendar_join(df: DataFrame, key: str = "timestamp_utc", series: Sequence[str] = ()) -> DataFrame:
    """Calendar hours with the columns of `df` where present and `row_missing`."""
    marked = df.withColumn("_present", F.lit(True))
    joined = hourly_calendar(df, key, series).join(marked, [*series, key], "left")
    return joined.withColumn("row_missing", F.col("_present").isNull()).drop("_present")


GOLD_MEASURES = ("consumo_total_kwh", "producao_total_kwh", "producao_dgm_kwh", "producao_pre_kwh")


def _gold_row(df: DataFrame, series: Sequence[str], origin: str | None) -> DataFrame:
    balance = M.balance_columns(F.col("consumo_total_kwh"), F.col("producao_total_kwh"))
    return df.select(
        *series,
        "timestamp_utc",
        *GOLD_MEASURES,
        *[expr.alias(name) for name, expr in balance.items()],
        F.lit(True).alias("flag_missing_source"),
        *([F.lit(origin).alias("origin")] if origin else []),
    )


def backfill_missing_hours(gold: DataFrame, series: Sequence[str] = (), bucket: str = "month") -> DataFrame:
    """New rows for the hours absent between a series' first and last hour; present rows are untouched.

    A measure is the mean of the nearest known values on both sides, or the one that exists. All hours
    of one gap share those values, so each present row looks at its successor and, if hours lie between
    them, unfolds the gap; no calendar join is needed. The input has at most one row per hour.
    """
    key = "timestamp_utc"
    w = bucket_window(series, key)
    upto, beyond = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(1, W.unboundedFollowing)
    edged = with_known_edges(gold.select(*series, key, *GOLD_MEASURES), GOLD_MEASURES, series, key, bucket)
    gaps = (
        edged.withColumns(
            {"_next_at": F.lead(key).over(w)}
            | {f"_prev_{m}": F.last(m, ignorenulls=True).over(upto) for m in GOLD_MEASURES}
            | {f"_next_{m}": F.first(m, ignorenulls=True).over(beyond) for m in GOLD_MEASURES}
        )
        .where(~F.col(CARRIED) & (hours_between(F.col(key), F.col("_next_at")) > 1))
    )
    hour = F.expr(_HOUR)

    def fill(m: str) -> Column:
        before, after = F.col(f"_prev_{m}"), F.col(f"_next_{m}")
        return F.coalesce((before + after) / 2, before, after)

    filled = gaps.select(
        *series,
        F.explode(F.sequence(F.col(key) + hour, F.col("_next_at") - hour, hour)).alias(key),
        *[fill(m).alias(m) for m in GOLD_MEASURES],
    )
    return _gold_row(filled, series, "imputed" if "origin" in gold.columns else None)


# Fixed values of the projection: fallback level, floor, daily amplitude and daily phase (hours) per measure.
PROJECTION = {
    "consumo_total_kwh": {"default": 50000.0, "floor": 100.0, "amplitude": 0.10, "phase": 0},
    "producao_total_kwh": {"default": 62000.0, "floor": 120.0, "amplitude": 0.12, "phase": -2},
    "producao_dgm_kwh": {"default": 29000.0, "floor": 60.0, "amplitude": 0.11, "phase": -1},
    "producao_pre_kwh": {"default": 33000.0, "floor": 60.0, "amplitude": 0.13, "phase": -3},
}
YEARLY_AMPLITUDE = 0.02
# Production keeps at least this margin over consumption; its spread is a base, a daily swing and noise.
PRODUCTION_MARGIN = 1.03
SPREAD_BASE, SPREAD_SWING, SPREAD_PHASE, SPREAD_NOISE = 1.04, 0.05, 6, 0.03
MIN_RATIO = 0.000001


def _wave(turns: Column) -> Column:
    return F.sin(F.lit(2.0) * F.pi() * turns)


def hour_noise(ts: Column) -> Column:
    """Deterministic value in [-0.5, 0.5) from the hour number since 1970."""
    hour_number = F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600)
    return F.pmod(hour_number * 7919, F.lit(1000)) / 1000.0 - 0.5


def latest_positive(df: DataFrame, measures: Sequence[str], series: Sequence[str] = (), key: str = "timestamp_utc") -> DataFrame:
    """Per measure its newest value above 0, plus the newest instant as `last_ts`."""
    return df.groupBy(*series).agg(
        F.max(key).alias("last_ts"),
        *[F.max_by(m, F.when(F.col(m) > 0, F.col(key))).alias(m) for m in measures],
    )


def project_forward(
    gold: DataFrame,
    as_of: datetime,
    series: Sequence[str] = (),
    defaults: Mapping[str, float] | None = None,
    noise: bool = True,
) -> DataFrame:
    """New rows from the hour after each series' last one up to the hour of `as_of`.

    Each measure is its newest positive value (or a default) on a daily and a yearly wave, with a floor.
    """
    levels = {m: p["default"] for m, p in PROJECTION.items()} | dict(defaults or {})
    ts = F.col("timestamp_utc")
    end = hour_bucket(F.lit(as_of.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz"))
    start = add_hours(hour_bucket(F.col("last_ts")), 1)
    base = latest_positive(gold, list(PROJECTION), series).where(F.col("last_ts").isNotNull())
    hours = base.where(start <= end).select(
        *series,
        F.explode(F.sequence(start, end, F.expr(_HOUR))).alias("timestamp_utc"),
        *[F.coalesce(F.col(m), F.lit(levels[m])).alias(m) for m in PROJECTION],
    )
    year_wave = 1 + YEARLY_AMPLITUDE * _wave(F.dayofyear(ts) / 365.0)
    raw = hours.select(
        *series,
        "timestamp_utc",
        *[
            F.greatest(
                F.lit(p["floor"]),
                F.col(m) * (1 + p["amplitude"] * _wave((F.hour(ts) + p["phase"]) / 24.0)) * year_wave,
            ).alias(m)
            for m, p in PROJECTION.items()
        ],
    )
    spread = SPREAD_BASE + SPREAD_SWING * _wave((F.hour(ts) + SPREAD_PHASE) / 24.0)
    if noise:
        spread = spread + SPREAD_NOISE * hour_noise(ts)
    margined = raw.withColumn(
        "producao_total_kwh",
        F.greatest(F.col("consumo_total_kwh") * PRODUCTION_MARGIN, F.col("producao_total_kwh") * spread),
    )
    rows = _gold_row(margined, series, "projected" if "origin" in gold.columns else None)
    # A projected hour is always a surplus.
    return rows.withColumns(
        {
            "ratio_producao_consumo": F.greatest(F.lit(MIN_RATIO), F.col("ratio_producao_consumo")),
            "flag_defice": F.lit(False),
            "flag_excedente": F.lit(True),
        }
    )
