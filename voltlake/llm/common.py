"""Shared pieces of the operators: worker set-up, text as bytes, staged tables, documented null rules.

Every operator reads only the columns it names, so further columns, clashing names among them, are left alone.
A null text counts as empty unless an operator says otherwise.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bytes of one Arrow batch. It bounds what a Python worker holds, whatever the length of a text.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and let local workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    return spark


def text_bytes(name: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty: Arrow hands it over without decoding."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"").cast("binary")).alias(name)


def documents_of(docs: DataFrame) -> DataFrame:
    """The two columns most operators read: `doc_id` and the text as bytes."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes())


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again.

    Cuts the lineage: what follows survives a lost executor without redoing it, and reads one fixed result.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def decode(raw: bytes) -> str:
    """Bytes of a text as a string; malformed bytes become U+FFFD."""
    return raw.decode("utf-8", "replace")


def slots(spark: SparkSession) -> int:
    """Width of a shuffle, which the session sets in proportion to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
