"""Training rows: deficit features, time split, stratified folds and hold-out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.calendar import training_calendar, trunc_ntz
from ..session import fan_out
from .timeline import bucket_window, lag_columns, main_rows, with_halo

# Lagged measures, lags and the target of the deficit model.
LAG_MEASURES = ("consumo_total_kwh", "producao_total_kwh", "saldo_kwh", "ratio_producao_consumo")
LAGS = (1, 2, 3, 6, 12, 24)
TARGET = "target_defice_t_plus_1"
MIN_INFERENCE_ROWS = 25


def feature_names(lags: Sequence[int] = LAGS) -> list[str]:
    return ["hour", "day_of_week", "month", *[f"{m}_lag_{k}" for m in LAG_MEASURES for k in lags]]


def deficit_features(
    gold: DataFrame, lags: Sequence[int] = LAGS, time_aware: bool = False, series: Sequence[str] = ()
) -> DataFrame:
    """Calendar and lag features with the next row's deficit flag as target; incomplete rows are removed.

    Lags count rows; `time_aware` makes them count hours, so a gap gives null instead of a shifted value.
    """
    ts = "timestamp_utc"
    rows = gold.where(F.col(ts).isNotNull()).select(*series, ts, *LAG_MEASURES, "flag_defice")
    halo = with_halo(rows, [*LAG_MEASURES, "flag_defice"], series, ts, before=max(lags), after=1)
    w = bucket_window(series, ts)
    if time_aware:
        by_hour = bucket_window(series, F.unix_seconds(F.col(ts).cast("timestamp")))
        lagged = {
            f"{m}_lag_{k}": F.first(m).over(by_hour.rangeBetween(-3600 * k, -3600 * k))
            for m in LAG_MEASURES
            for k in lags
        }
    else:
        lagged = lag_columns(w, LAG_MEASURES, lags)
    derived = training_calendar(F.col(ts)) | lagged | {TARGET: F.lead("flag_defice", 1).over(w).cast("int")}
    names = feature_names(lags)
    return main_rows(halo.withColumns(derived)).select(*series, ts, TARGET, *names).dropna(subset=[TARGET, *names])


def latest_features(
    gold: DataFrame, lags: Sequence[int] = LAGS, check: bool = True, series: Sequence[str] = ()
) -> DataFrame:
    """Features of the newest hour, computed from the newest `max(lags) + 1` rows only.

    With `series`, one row per series. Its rows are limited per key before the shuffle, and a series is read as
    one short list. `rows_seen` says how many there were and `ready` whether no feature is null; nothing is raised.
    Without `series` and with `check`, raises when there are too few rows or any feature is null.
    """
    ts = "timestamp_utc"
    need = max(lags) + 1
    rows = gold.where(F.col(ts).isNotNull()).select(*series, ts, *LAG_MEASURES)
    newest_first = [F.col(ts).desc(), *[F.col(m) for m in LAG_MEASURES]]
    if series:
        place = F.row_number().over(W.partitionBy(*series).orderBy(*newest_first))
        newest = rows.withColumn("_place", place).where(F.col("_place") <= need)
    else:
        newest = rows.orderBy(*newest_first).limit(need)
    # At most 25 rows a series from here on, so one ordered list of them replaces a window.
    listed = newest.groupBy(*series).agg(F.sort_array(F.collect_list(F.struct(ts, *LAG_MEASURES)), asc=False).alias("_r"))
    picked = listed.select(
        *series,
        F.size("_r").alias("rows_seen"),
        F.get("_r", F.lit(0))[ts].alias(ts),
        *[F.get("_r", F.lit(k))[m].alias(f"{m}_lag_{k}") for m in LAG_MEASURES for k in lags],
    )
    named = picked.withColumns(training_calendar(F.col(ts)))
    names = feature_names(lags)
    if series:
        known = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
        return named.select(*series, ts, "rows_seen", known.alias("ready"), *names)
    if check:
        found = named.first()  # one row
        if found["rows_seen"] < need:
            raise ValueError(f"at least {need} hours are needed, found {found['rows_seen']}")
        unknown = [n for n in names if found[n] is None]
        if unknown:
            raise ValueError(f"the newest hour lacks {unknown}")
        named = gold.sparkSession.createDataFrame([found], named.schema)  # not computed a second time
    return named.select(ts, *names)


def temporal_cutoff(df: DataFrame, ts: str, test_ratio: float) -> DataFrame:
    """One row `cutoff`: the instant of the first test row when the earliest `1 - test_ratio` of rows train.

    Rows are counted per instant first; the running count is cut into months, so no window holds more
    than the distinct instants of a month.
    """
    per_ts = df.groupBy(ts).agg(F.count(F.lit(1)).alias("_n")).withColumn("_m", trunc_ntz("month", F.col(ts)))
    months = per_ts.groupBy("_m").agg(F.sum("_n").alias("_rows"))
    ahead = W.orderBy("_m").rowsBetween(W.unboundedPreceding, -1)
    months = months.select(
        "_m",
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"),
        F.floor(F.sum("_rows").over(W.partitionBy()) * (1 - test_ratio)).alias("_train"),
    )
    within = W.partitionBy("_m").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    running = per_ts.withColumn("_upto", F.sum("_n").over(within)).join(months, "_m")
    return running.where(F.col("_before") + F.col("_upto") > F.col("_train")).agg(F.min(ts).alias("cutoff"))


def temporal_split(df: DataFrame, ts: str = "timestamp_utc", test_ratio: float = 0.2) -> DataFrame:
    """Add `is_test`: rows from the cutoff instant on. Rows of one instant stay together."""
    cutoff = F.broadcast(temporal_cutoff(df, ts, test_ratio))  # one row
    return df.crossJoin(cutoff).withColumn("is_test", F.col(ts) >= F.col("cutoff")).drop("cutoff")


def _shuffle_key(row_id: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def stratified_rank(df: DataFrame, label: str, row_id: str, seed: int) -> DataFrame:
    """Add `_rank`, the 1-based place of a row in the seeded shuffle of its class, and `_class_rows`.

    The shuffle order is a hash, so its leading digits cut any class into even slices; a slice is ranked
    on its own and shifted by the rows in the class's earlier slices.
    """
    digits = len(f"{fan_out(df.sparkSession, 4096) - 1:x}")
    hashed = df.withColumn("_h", _shuffle_key(row_id, seed)).withColumn("_slice", F.substring("_h", 1, digits))
    earlier = W.partitionBy(label).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = hashed.groupBy(label, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    slices = slices.select(
        F.col(label).alias("_label"),
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(label)).alias("_class_rows"),
    )
    joined = hashed.join(slices, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_slice") == F.col("_s")))
    place = F.row_number().over(W.partitionBy(label, "_slice").orderBy("_h", row_id))
    return joined.withColumn("_rank", F.col("_before") + place).drop("_label", "_s", "_before", "_h", "_slice")


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add `fold` in 0..k-1; each class is spread evenly over the folds."""
    ranked = stratified_rank(df, label, row_id, seed)
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_class_rows")


def stratified_holdout(
    df: DataFrame, label: str, row_id: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add `is_test`: an exact share of each class, rounded per class."""
    ranked = stratified_rank(df, label, row_id, seed)
    return ranked.withColumn("is_test", F.col("_rank") <= F.round(F.col("_class_rows") * test_size)).drop(
        "_rank", "_class_rows"
    )
