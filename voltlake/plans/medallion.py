"""Bronze to silver to gold runs. Each stage is written and the next one reads the written table.

Every table is audited while it is written and takes the place of the old one only if its checks hold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gold as G
from ..operators import quality as Q
from ..operators.bronze import bronze_clean
from ..operators.silver import silver_15min, silver_hourly
from ..operators.timeline import backfill_missing_hours, project_forward
from ..schemas import CONSUMPTION_COMPONENTS, CONSUMPTION_TOTAL, PRODUCTION_COMPONENTS, PRODUCTION_TOTAL
from ..session import configure
from ..sources.readers import read_csv, read_price_csv
from ..sources.writers import append_new, exists, replace_partitions, with_year, write_parquet

BALANCE, MARKET = "balance", "market"
YEAR = ("ano_particao",)
HOUR = "timestamp_utc"


def market_checks(kind: str) -> list[Q.Check]:
    """Checks of the measure of `kind`; the price range is only recorded unless limits bound it."""
    if kind == "consumption":
        return [*Q.non_negative(["consumo_total"]), *Q.null_share(["consumo_total"], 0.01)]
    return [*Q.null_share(["market_price_pt"], 0.01), replace(Q.plausible_range("market_price_pt"), threshold=None)]


def _yearly(df: DataFrame) -> DataFrame:
    return df.withColumn(YEAR[0], F.year("timestamp_utc"))


def _written(df: DataFrame, path: str) -> DataFrame:
    """The table `df` was written to; the known schema also reads a table without rows."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store(df: DataFrame, path: str, partition_by: Sequence[str] = (), audit: Q.Audit | None = None) -> DataFrame:
    write_parquet(df, path, partition_by, audit)
    return _written(df, path)


def _store_day(df: DataFrame, path: str, day: str, audit: Q.Audit | None = None) -> DataFrame:
    replace_partitions(df, path, ["process_date"], [[day]], audit)
    return of_process_date(_written(df, path), day)


@dataclass
class Audits:
    """The audits of one run. `limits` maps a table name to thresholds by check name."""

    as_of: datetime
    limits: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    done: list[Q.Audit] = field(default_factory=list)

    def of(self, table: str, checks: Sequence[Q.Check], key: Sequence[str] = ()) -> Q.Audit:
        self.done.append(Q.Audit(table, [Q.row_count(), *checks], key, self.limits.get(table)))
        return self.done[-1]

    def bronze(self, table: str, df: DataFrame) -> Q.Audit:
        """Rows and flags; bronze keeps every row, so only `limits` bound them."""
        return self.of(table, Q.flags_recorded(df))

    def hourly(self, table: str, checks: Sequence[Q.Check]) -> Q.Audit:
        """One row per known hour; coverage and age are recorded unless `limits` bound them."""
        null_hours = Q.Check("null_hours", F.count_if(F.col(HOUR).isNull()), 0)
        age = replace(Q.freshness(self.as_of, 0), threshold=None)
        return self.of(table, [null_hours, Q.hours_covered(), age, *checks], [HOUR])

    def store(self, spark: SparkSession, base: str, run_id: str) -> None:
        """Put the results of this run into `base/quality/checks`, in the place of an earlier run of the name."""
        rows = [result for audit in self.done for result in audit.results]  # some ten rows a table
        report = spark.createDataFrame(rows, "table_name string, check string, observed double, threshold double, passed boolean")
        named = report.select("*", F.lit(run_id).alias("run_id"))
        replace_partitions(named, f"{base}/quality/checks", ["run_id"])


def run_balance(spark: SparkSession, base: str, run_id: str, as_of: datetime, audits: Audits | None = None) -> str:
    """Consumption and production CSV under `base/raw` to the hourly balance; returns the gold path."""
    audits = audits or Audits(as_of)
    sides = {
        "consumption": (CONSUMPTION_TOTAL, CONSUMPTION_COMPONENTS, "consumo_componentes_kwh"),
        "production": (PRODUCTION_TOTAL, PRODUCTION_COMPONENTS, "producao_componentes_kwh"),
    }
    silver = {}
    for kind, (total, components, sum_name) in sides.items():
        raw = read_csv(spark, f"{base}/raw/{kind}", positions=True)
        cleaned = bronze_clean(raw, kind, run_id, as_of, "A")
        bronze = _store(cleaned, f"{base}/bronze/{kind}_a", audit=audits.bronze(f"bronze_{kind}_a", cleaned))
        picked = silver_15min(bronze, total, list(components.values()), sum_name)
        audit = audits.of(f"silver_{kind}_15min", [*Q.non_negative([total]), *Q.null_share([HOUR, total])], [HOUR])
        silver[kind] = _store(_yearly(picked), f"{base}/silver/{kind}_15min", YEAR, audit)
    path = f"{base}/gold/balance_hourly"
    gold = with_year(G.gold_balance_hourly(silver["consumption"], silver["production"]))
    checks = [*Q.non_negative([CONSUMPTION_TOTAL, PRODUCTION_TOTAL]), Q.exclusive_flags(), *Q.flags_recorded(gold)]
    write_parquet(gold, path, ["year"], audits.hourly("gold_balance_hourly", checks))
    return path


def backfill_balance(spark: SparkSession, path: str, repeats: int = 1) -> None:
    """Append the missing hours; a further repeat finds none."""
    for _ in range(repeats):
        filled = backfill_missing_hours(spark.read.parquet(path).drop("year"))
        append_new(with_year(filled), path, ["timestamp_utc"], ["year"])


def extend_balance(spark: SparkSession, path: str, as_of: datetime) -> None:
    """Append projected hours up to `as_of`."""
    projected = project_forward(spark.read.parquet(path).drop("year"), as_of)
    append_new(with_year(projected), path, ["timestamp_utc"], ["year"])


def run_market(
    spark: SparkSession,
    base: str,
    run_id: str,
    as_of: datetime,
    source_tz: str = "Europe/Lisbon",
    raw: str = "raw",
    audits: Audits | None = None,
) -> str:
    """Consumption and price CSV under `base/raw` to the hourly market and load-feature tables; returns the market path.

    `raw` may hold all deliveries so far or only those of this run, which must deliver an hour whole. Bronze keeps
    one partition per process date. Silver and gold hold one row per hour over all runs, by year: the hours of a
    run replace those they have, and gold is computed anew from the first changed year on, its windows starting
    on the rows before. A run that is repeated leaves the same tables.
    """
    audits = audits or Audits(as_of)
    day = as_of.date().isoformat()
    raws = {
        "consumption": read_csv(spark, f"{base}/{raw}/consumption", positions=True),
        "price": read_price_csv(spark, f"{base}/{raw}/price"),
    }
    silver, changed = {}, []
    for kind, rows in raws.items():
        cleaned = bronze_clean(rows, kind, run_id, as_of, "B", source_tz)
        cleaned = cleaned.withColumn("process_date", F.lit(day).cast("date"))
        bronze = _store_day(cleaned, f"{base}/bronze/{kind}_b", day, audits.bronze(f"bronze_{kind}_b", cleaned))
        new = silver_hourly(bronze, kind, day)
        audit = audits.hourly(f"silver_{kind}_hourly", market_checks(kind))
        silver[kind] = _replace_hours(new, f"{base}/silver/{kind}_hourly", audit)
        changed.append(new.agg(F.min("timestamp_utc")).first()[0])
    market_path = f"{base}/gold/market_hourly"
    first = min((c for c in changed if c is not None), default=None)
    if first is not None:
        _refresh_gold(silver["consumption"], silver["price"], first, day, market_path, f"{base}/gold/load_features_hourly", audits)
    return market_path


def _replace_hours(new: DataFrame, path: str, audit: Q.Audit) -> DataFrame:
    """Put the hours of `new` into the table by year, in the place of those it has already."""
    years = [[r["year"]] for r in new.select("year").distinct().collect()]  # one row per year
    rows = new
    if years and exists(new, path):
        there = _written(new, path).where(F.col("year").isin([y for (y,) in years]))
        rows = there.join(new.select(HOUR), HOUR, "left_anti").unionByName(new)
    replace_partitions(rows, path, ["year"], audit=audit)
    return _written(new, path)


def _refresh_gold(
    consumption: DataFrame, price: DataFrame, first: datetime, day: str, market_path: str, features_path: str, audits: Audits
) -> None:
    """Market and load-feature rows of the years from that of the row before `first` on."""
    hours = consumption.select(HOUR, "year").join(price.select(HOUR, "year"), [HOUR, "year"])

    def before(instant: datetime, rows: int) -> list:
        return hours.where(F.col(HOUR) < F.lit(instant)).orderBy(F.desc(HOUR)).limit(rows).collect()

    # The row before the first change gets a new target, which is why its year counts as changed.
    start = datetime(min([first.year, *[r["year"] for r in before(first, 1)]]), 1, 1)
    since = min([start, *[r[HOUR] for r in before(start, G.MARKET_LAG_HOURS)]])

    def window(df: DataFrame) -> DataFrame:
        return df.where((F.col("year") >= since.year) & (F.col(HOUR) >= F.lit(since)))

    market = G.gold_market_hourly(window(consumption), window(price), day)
    last = hours.agg(F.max("year")).first()[0] or start.year
    years = [[y] for y in range(start.year, last + 1)]
    checks = [*market_checks("consumption"), *market_checks("price")]
    market = market.where(F.col("year") >= start.year)
    replace_partitions(market, market_path, ["year"], years, audits.hourly("gold_market_hourly", checks))
    rows = _written(market, market_path).where(F.col("year") >= start.year)
    features = G.gold_load_features_hourly(rows).withColumn("year", F.year(HOUR))
    replace_partitions(features, features_path, ["year"], years, audits.hourly("gold_load_features_hourly", []))


def of_process_date(df: DataFrame, process_date: str) -> DataFrame:
    """Rows of one run; the predicate prunes partitions."""
    return df.where(F.col("process_date") == F.lit(process_date).cast("date"))


def run_medallion(
    spark: SparkSession,
    base_path: str,
    as_of: datetime,
    pipelines: Sequence[str] = (BALANCE, MARKET),
    repeats: int = 1,
    run_id: str = "manual",
    project: bool = False,
    source_tz: str = "Europe/Lisbon",
    raw: str = "raw",
    limits: Mapping[str, Mapping[str, float]] | None = None,
) -> None:
    """Run the chosen pipelines; for the balance, backfill `repeats` times and optionally project to `as_of`.

    `raw` names the folder below `base_path` that the market run reads. The checks of all tables written go to
    `base_path/quality/checks` under `run_id`, also when one fails: the run then stops with `FailedChecks` and the
    table concerned stays as it was. `limits` sets thresholds by table and check, such as
    {"gold_balance_hourly": {"completeness": 0.99, "freshness_hours": 2}}.
    """
    configure(spark)
    unknown = set(pipelines) - {BALANCE, MARKET}
    if unknown:
        raise ValueError(f"unknown pipelines: {sorted(unknown)}")
    audits = Audits(as_of, limits or {})
    try:
        if BALANCE in pipelines:
            path = run_balance(spark, base_path, run_id, as_of, audits)
            backfill_balance(spark, path, repeats)
            if project:
                extend_balance(spark, path, as_of)
        if MARKET in pipelines:
            run_market(spark, base_path, run_id, as_of, source_tz, raw, audits)
    finally:
        audits.store(spark, base_path, run_id)
