"""Registry of catalogue queries: a Spark callable and, where SQL can say the same, its SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Parquet tables of one folder, opened on access."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, df)  # a second use reads no footers again
        return df


@dataclass(frozen=True)
class Query:
    name: str
    run: QueryFn
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register `fn(tables) -> DataFrame` under its own name."""

    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(configure(spark), folder))

        if key in CATALOGUE:
            raise ValueError(f"query registered twice: {key}")
        CATALOGUE[key] = Query(key, run, sql)
        return fn

    return register


def rounded(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """Round double columns, so sums compare equal whatever the order of addition."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    # Adding 0.0 turns a negative zero into zero.
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})
