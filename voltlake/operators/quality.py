"""Validation reports and threshold checks. Checks on one table share one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions.calendar import add_hours, hour_bucket, hours_between, trunc_ntz
from .timeline import CARRIED, bucket_window, hourly_calendar, with_known_edges


def count_true(names: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col(n)).alias(n) for n in names]


def flag_counts(df: DataFrame) -> DataFrame:
    """Rows and the true count of every `flag_*` column."""
    flags = [c for c in df.columns if c.startswith("flag_")]
    return df.agg(F.count(F.lit(1)).alias("total_linhas"), *count_true(flags))


def table_bounds(df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("linhas"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


def bronze_report(bronze: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Rows, distinct and extreme timestamps, and a count per flag, in one row."""
    flags = [c for c in bronze.columns if c.startswith("flag_")]
    return bronze.agg(
        F.count(F.lit(1)).alias("total_linhas"),
        F.count_distinct(ts).alias("timestamps_distintos"),
        F.min(ts).alias("min_ts"),
        F.max(ts).alias("max_ts"),
        *count_true(flags),
    )


def duplicate_sample(bronze: DataFrame, total: str, order: Sequence[str], n: int = 8) -> DataFrame:
    """First `n` rows that share their timestamp."""
    shared = bronze.where(F.col("flag_duplicate_timestamp"))
    return shared.orderBy(*order).limit(n).select("timestamp_utc", total, "duplicate_rank")


def monthly_coverage(gold: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Observed and expected hours per month, between the month's own first and last hour, and null counts."""
    expected = hours_between(F.min(ts), F.max(ts)) + 1
    observed = F.count(F.lit(1))
    return gold.groupBy(trunc_ntz("month", F.col(ts)).alias("mes")).agg(
        observed.alias("horas_observadas"),
        expected.alias("horas_esperadas_no_intervalo"),
        (expected - observed).alias("horas_em_falta_no_intervalo"),
        F.count_if(F.col("consumo_total_kwh").isNull()).alias("horas_sem_consumo"),
        F.count_if(F.col("producao_total_kwh").isNull()).alias("horas_sem_producao"),
        F.count_if(F.col("flag_missing_source")).alias("horas_com_fonte_em_falta"),
    )


def monthly_drift(gold: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Monthly sums, ratio of sums, flagged hours and hours read."""
    return gold.groupBy(trunc_ntz("month", F.col(ts)).alias("mes")).agg(
        F.sum("consumo_total_kwh").alias("consumo_kwh"),
        F.sum("producao_total_kwh").alias("producao_kwh"),
        F.sum("saldo_kwh").alias("saldo_kwh"),
        M.guarded_ratio(F.sum("producao_total_kwh"), F.sum("consumo_total_kwh")).alias("ratio_pc"),
        F.count_if(F.col("flag_defice")).alias("horas_defice"),
        F.count_if(F.col("flag_excedente")).alias("horas_excedente"),
        F.count(F.lit(1)).alias("horas_lidas"),
    )


SYNTHESIS_COLUMNS = (
    "consumo_total_kwh",
    "producao_total_kwh",
    "producao_dgm_kwh",
    "producao_pre_kwh",
    "saldo_kwh",
    "ratio_producao_consumo",
)


def synthesis_coverage(gold: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Rows above the last hour with both sources: their span and zero-or-null counts per column."""
    last_real = gold.where(~F.col("flag_missing_source")).agg(add_hours(hour_bucket(F.max(ts)), 1))
    flags = ("flag_defice", "flag_excedente", "flag_missing_source")
    later = gold.where(F.col("flag_missing_source") & (F.col(ts) >= last_real.scalar()))
    return later.agg(
        F.min(ts).alias("min_inserted_ts"),
        F.max(ts).alias("max_inserted_ts"),
        F.count(F.lit(1)).alias("rows_inserted"),
        *[F.count_if(F.coalesce(F.col(c), F.lit(0.0)) == 0).alias(f"zero_or_null_{c}") for c in SYNTHESIS_COLUMNS],
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in flags],
    )


@dataclass(frozen=True)
class Check:
    """An aggregate and its bound: `rule` "max" passes at or below the threshold, "min" at or above.

    Without a threshold the value is only recorded; that is for audits, `run_checks` wants one.
    """

    name: str
    observed: Column
    threshold: float | None
    rule: str = "max"

    def passes(self, value: float | None) -> bool:
        """As in `run_checks`: null never passes a bound."""
        if self.threshold is None:
            return True
        return value is not None and (value <= self.threshold if self.rule == "max" else value >= self.threshold)


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check with the observed value; all aggregates run in one pass. Null never passes."""
    row = df.agg(*[c.observed.cast("double").alias(f"_{i}") for i, c in enumerate(checks)])
    items = []
    for i, c in enumerate(checks):
        value, bound = F.col(f"_{i}"), F.lit(float(c.threshold))
        passed = value <= bound if c.rule == "max" else value >= bound
        items.append(
            F.struct(
                F.lit(c.name).alias("check"),
                value.alias("observed"),
                bound.alias("threshold"),
                M.is_true(passed).alias("passed"),
            )
        )
    return row.select(F.explode(F.array(*items)).alias("_c")).select("_c.*")


def share(condition: Column) -> Column:
    """Share of rows where the condition holds, null for an empty table."""
    return F.avg(M.is_true(condition).cast("double"))


def unique_key(df: DataFrame, key: Sequence[str], name: str = "unique_key") -> DataFrame:
    """Number of keys with more than one row, at most 0."""
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("_r"))
    return run_checks(repeated, [Check(name, F.max("_r"), 0)])


def non_negative(columns: Sequence[str]) -> list[Check]:
    return [Check(f"non_negative_{c}", F.count_if(F.col(c) < 0), 0) for c in columns]


def exclusive_flags(a: str = "flag_defice", b: str = "flag_excedente") -> Check:
    return Check("exclusive_flags", F.count_if(F.col(a) & F.col(b)), 0)


def hour_domain(hour: str = "market_hour") -> Check:
    return Check("hour_domain", F.count_if(M.bad_hour_flag(F.col(hour))), 0)


def null_share(columns: Sequence[str], threshold: float = 0.0) -> list[Check]:
    return [Check(f"null_share_{c}", share(F.col(c).isNull()), threshold) for c in columns]


def plausible_range(column: str, low: float = -500.0, high: float = 500.0) -> Check:
    return Check(f"plausible_{column}", F.count_if(~F.col(column).between(low, high)), 0)


def source_rows_per_hour(column: str = "source_rows", expected: int = 4) -> Check:
    return Check("incomplete_hours", F.count_if(F.col(column) != expected), 0)


def version_present(column: str) -> Check:
    return Check(f"version_present_{column}", F.count_if(F.col(column).isNull()), 0)


def freshness(as_of: datetime, max_hours: float, ts: str = "timestamp_utc") -> Check:
    """Hours from the newest row to `as_of`."""
    now = F.lit(as_of.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return Check("freshness_hours", F.timestamp_diff("SECOND", F.max(ts), now) / 3600.0, max_hours)


def completeness(df: DataFrame, threshold: float = 0.99, ts: str = "timestamp_utc", series: Sequence[str] = ()) -> DataFrame:
    """Hours present over hours between first and last, summed over the series."""
    spans = df.groupBy(*series).agg(
        F.count(F.lit(1)).alias("_seen"),
        (hours_between(hour_bucket(F.min(ts)), hour_bucket(F.max(ts))) + 1).alias("_expected"),
    )
    return run_checks(spans, [Check("completeness", F.try_divide(F.sum("_seen"), F.sum("_expected")), threshold, "min")])


def day_completeness(df: DataFrame, day: str, threshold: float = 0.995) -> DataFrame:
    """Days present over days between first and last."""
    expected = F.date_diff(F.max(day), F.min(day)) + 1
    return run_checks(df, [Check("completeness", F.try_divide(F.count(F.lit(1)), expected), threshold, "min")])


def join_rate(left: DataFrame, right: DataFrame, key: Sequence[str], threshold: float = 0.98) -> DataFrame:
    """Share of `left` hours that have a row in `right`."""
    matched = left.select(*key).join(right.select(*key).withColumn("_hit", F.lit(1)), list(key), "left")
    return run_checks(matched, [Check("join_rate", share(F.col("_hit").isNotNull()), threshold, "min")])


def one_to_one(left: DataFrame, right: DataFrame, joined: DataFrame, key: Sequence[str]) -> DataFrame:
    """Unique keys before and after a join."""
    parts = [unique_key(df, key, f"unique_{name}") for name, df in (("left", left), ("right", right), ("joined", joined))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def feature_drift(df: DataFrame, features: Sequence[str], grain: str = "month", ts: str = "timestamp_utc") -> DataFrame:
    """Mean and sample deviation per feature and period; one aggregate, then one row per feature."""
    stats = df.groupBy(trunc_ntz(grain, F.col(ts)).alias("periodo_inicio")).agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_samp(f).alias(f"_s_{f}") for f in features]
    )
    items = [
        F.struct(F.lit(f).alias("feature"), F.col(f"_m_{f}").alias("mean"), F.col(f"_s_{f}").alias("stddev"))
        for f in features
    ]
    return stats.select("periodo_inicio", F.explode(F.array(*items)).alias("_f")).select("periodo_inicio", "_f.*")


def training_ready(df: DataFrame, features: Sequence[str], ts: str = "timestamp_utc", series: Sequence[str] = ()) -> DataFrame:
    """Null feature cells and steps that are not exactly one hour."""
    w = bucket_window(series, ts)
    edged = with_known_edges(df.select(*series, ts, *features), [], series, ts).withColumn("_prev", F.lag(ts).over(w))
    own = edged.where(~F.col(CARRIED))
    nulls = F.aggregate(
        F.array(*[F.col(f).isNull().cast("int") for f in features]), F.lit(0), lambda a, x: a + x
    )
    step = F.timestamp_diff("SECOND", F.col("_prev"), F.col(ts))
    return run_checks(
        own,
        [
            Check("null_feature_cells", F.coalesce(F.sum(nulls), F.lit(0)), 0),
            Check("gaps", F.count_if(step != 3600), 0),
        ],
    )


def missing_hour_count(df: DataFrame, ts: str = "timestamp_utc", series: Sequence[str] = ()) -> DataFrame:
    """Calendar hours that have no row."""
    calendar = hourly_calendar(df, ts, series)
    return calendar.join(df.select(*series, ts), [*series, ts], "left_anti").agg(
        F.count(F.lit(1)).alias("horas_em_falta")
    )


def expect(report: DataFrame) -> DataFrame:
    """Return the report, or raise naming the checks that failed."""
    failed = [r["check"] for r in report.where(~F.col("passed")).collect()]  # one row per check
    if failed:
        raise ValueError(f"failed checks: {sorted(failed)}")
    return report


class FailedChecks(ValueError):
    """Raised by an audit; the message names the table and the checks that failed."""


class Audit:
    """Checks of one table, gathered by the job that writes it.

    `checks` are observed on the rows as they pass to the files, so they cost no second scan; they may not hold
    distinct aggregates. Writers observe them in the stage that writes, where a task that is run again counts
    once. With `key`, the written key columns alone are read again to count repeated keys. `limits` puts other
    thresholds on checks, by name. `results` holds (table, check, observed, threshold, passed) once settled.
    """

    def __init__(self, table: str, checks: Sequence[Check], key: Sequence[str] = (), limits: Mapping[str, float] | None = None):
        self.table, self.key, self.results = table, list(key), []
        self.checks = [replace(c, threshold=(limits or {}).get(c.name, c.threshold)) for c in checks]

    def watch(self, df: DataFrame) -> DataFrame:
        self._seen = Observation()
        return df.observe(self._seen, *[c.observed.cast("double").alias(f"c{i}") for i, c in enumerate(self.checks)])

    def settle(self, written: DataFrame) -> None:
        """Judge the rows just written; raises if a check fails."""
        seen = self._seen.get
        values = [(c, seen[f"c{i}"]) for i, c in enumerate(self.checks)]
        bound = [None if c.threshold is None else float(c.threshold) for c in self.checks]
        self.results = [(self.table, c.name, v, b, c.passes(v)) for (c, v), b in zip(values, bound, strict=True)]
        if self.key:
            row = unique_key(written, self.key).first()
            self.results.append((self.table, *row))
        failed = sorted(name for _, name, _, _, passed in self.results if not passed)
        if failed:
            raise FailedChecks(f"{self.table}: failed checks: {failed}")


def recorded(name: str, observed: Column) -> Check:
    return Check(name, observed, None)


def row_count() -> Check:
    return recorded("rows", F.count(F.lit(1)))


def flags_recorded(df: DataFrame) -> list[Check]:
    """The true count of every `flag_*` column."""
    return [recorded(c, F.count_if(F.col(c))) for c in df.columns if c.startswith("flag_")]


def hours_covered(ts: str = "timestamp_utc") -> Check:
    """Rows over hours between first and last, for a table of one row per hour."""
    return Check("completeness", F.try_divide(F.count(F.lit(1)), hours_between(F.min(ts), F.max(ts)) + 1), None, "min")
