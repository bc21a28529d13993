"""Scans of the raw inputs: CSV in three shapes, Parquet, and row lineage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.parsing import add_parsed
from .records import join_quoted_lines

_BOM = "﻿"


class MissingColumnsError(ValueError):
    """A source lacks columns it must have."""


def normalise_names(df: DataFrame) -> DataFrame:
    """Header names without BOM and outer blanks, in lower case."""
    return df.toDF(*[c.replace(_BOM, "").strip().lower() for c in df.columns])


def snake_case_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def require_columns(df: DataFrame, required: Sequence[str], dataset: str) -> DataFrame:
    """Return `df`, or raise naming the missing columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"{dataset}: missing columns {missing}; present {df.columns}")
    return df


def require_rows(df: DataFrame, dataset: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{dataset}: no rows")
    return df


def source_contract(df: DataFrame, required: Sequence[str], dataset: str) -> DataFrame:
    """One row: the dataset, its missing columns (comma-separated) and whether it has rows. Reads one row at most."""
    missing = ",".join(c for c in required if c not in df.columns)
    found = df.limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows"))
    return found.select(F.lit(dataset).alias("dataset"), F.lit(missing).alias("missing"), "has_rows")


# Tasks a scan of small blocks has at least, if it has as many blocks.
_LEAST_TASKS = 64


@contextmanager
def blocks_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Scans that run inside cut files into blocks of `size`.

    However small the blocks are, no more tasks than a shuffle has read them: a task takes blocks that follow each
    other one by one, so their number costs neither tasks nor shuffle files.
    """
    tasks = max(_LEAST_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    settings = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.maxPartitionNum": str(tasks)}
    kept = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_csv(spark: SparkSession, path: str, positions: bool = False) -> DataFrame:
    """Comma-separated file with a header, every column text, names normalised.

    `positions` adds `source_file_name` and `row_pos` (see `with_source_order`).
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return normalise_names(with_source_order(raw)) if positions else normalise_names(raw)


def read_text_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """External CSV table: declared text columns, one header line skipped per file."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def _stays_open(open_: Column, piece: Column) -> Column:
    """Whether a cell is still open after a piece between two ";". A cell that starts with a quote is open while it holds
    an odd number of quotes; quotes further inside other cells are text."""
    odd = (F.length(piece) - F.length(F.replace(piece, F.lit('"'), F.lit("")))) % 2 == 1
    return F.when(open_, ~odd).otherwise(F.ltrim(piece).startswith('"') & odd)


def _cells(line: Column) -> Column:
    """Cells of a ";" record, unquoted and not yet trimmed; records without quotes take a plain split."""

    def add(state, piece):
        cells, open_ = state["cells"], state["open"]
        joined = F.concat(F.slice(cells, 1, F.size(cells) - 1), F.array(F.concat(F.element_at(cells, -1), F.lit(";"), piece)))
        longer = F.when(open_, joined).otherwise(F.concat(cells, F.array(piece)))
        return F.struct(longer.alias("cells"), _stays_open(open_, piece).alias("open"))

    def unquoted(cell):
        inside = cell.startswith('"') & cell.endswith('"') & (F.length(cell) > 1)
        return F.trim(F.replace(F.when(inside, F.substr(cell, F.lit(2), F.length(cell) - 2)).otherwise(cell), F.lit('""'), F.lit('"')))

    start = F.struct(F.array().cast("array<string>").alias("cells"), F.lit(False).alias("open"))
    quoted = F.aggregate(F.split(line, ";"), start, add, lambda state: state["cells"])
    return F.when(line.contains('"'), F.transform(quoted, lambda c: unquoted(F.trim(c)))).otherwise(F.split(line, ";"))


def read_price_csv(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = ("date", "hour", "portugal", "spain"),
    skip_lines: int | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """";"-separated price files as text columns `columns` plus `source_file_name` and `row_pos`.

    The header is the first line of each file that names every wanted column, in any order and case;
    with `skip_lines` it is the line after that many preamble lines. Lines up to the header, blank lines
    and lines too short to reach a wanted column are skipped. Raises when a file has no header.
    With `multi_line` quoted cells may hold line ends (see `join_quoted_lines`); files are split as without it.
    """
    text = spark.read.text(path, lineSep="\n") if multi_line else spark.read.text(path)
    lines = with_source_order(text.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}))
    lines = lines.withColumns({"value": F.replace(F.col("value"), F.lit(_BOM), F.lit("")), "_line": F.col("row_pos.line")})
    if multi_line:
        lines = join_quoted_lines(lines).withColumn("value", F.regexp_replace("value", "\r$", ""))
    names = F.transform(_cells(F.col("value")), lambda c: F.lower(F.trim(c)))
    if skip_lines is None:
        # Only lines that hold every wanted name are split and grouped.
        likely = reduce(lambda a, b: a & b, [F.contains(F.lower("value"), F.lit(c)) for c in columns])
        wanted = F.array(*[F.lit(c) for c in columns])
        headers = lines.where(likely).withColumn("_names", names).where(F.size(F.array_intersect("_names", wanted)) == len(columns))
    else:
        # A file's first lines are read by one task, so their positions are consecutive.
        starts = lines.groupBy("_file").agg((F.min("_line") + skip_lines).alias("_line"))
        headers = lines.join(starts, ["_file", "_line"]).withColumn("_names", names)
    headers = headers.groupBy("_file").agg(F.min("_line").alias("_header"), F.min_by("_names", "_line").alias("_names"))
    headers = headers.select("_file", "_header", *[F.array_position("_names", c).cast("int").alias(f"_at_{c}") for c in columns])
    least = F.least(*[F.col(f"_at_{c}") for c in columns])
    last = F.greatest(*[F.col(f"_at_{c}") for c in columns])
    error = F.raise_error(F.concat(F.lit("no header line in "), F.col("_file"))).cast("boolean")
    body = F.when(F.coalesce(least, F.lit(0)) > 0, F.col("_line") > F.col("_header")).otherwise(error)
    found = lines.join(F.broadcast(headers), "_file", "left").where(body)  # one row per file; lines stay where they are read
    return (
        add_parsed(found, {"cells": _cells(F.col("value"))})
        .where(F.size("cells") >= last)
        .select(
            *[F.trim(F.get(F.col("cells"), F.col(f"_at_{c}") - 1)).alias(c) for c in columns],
            "source_file_name",
            "row_pos",
        )
    )


def _file_order(files: str) -> Column:
    """Order of the files of a source: by path, or by the time of their last change and then by path."""
    at = {"name": F.lit(None).cast("timestamp"), "modified": F.col("_metadata.file_modification_time")}[files]
    return F.struct(at.alias("at"), F.col("_metadata.file_path").alias("path"))


def with_source_order(scan: DataFrame, files: str = "name") -> DataFrame:
    """Add `source_file_name` and `row_pos`, which orders rows by file (`files`: "name" or "modified"), then as the file does.

    Must be applied to the scan itself. Nothing is shuffled: the blocks of one file are handed to tasks in file
    order, so the task-local row ids keep that order within a file; between files they follow file sizes, which
    is why the file comes first.
    """
    place = F.struct(_file_order(files).alias("file"), F.monotonically_increasing_id().alias("line"))
    return scan.select("*", F.col("_metadata.file_name").alias("source_file_name"), place.alias("row_pos"))


def with_row_number(scan: DataFrame) -> DataFrame:
    """Add `source_file_name` and `row_num`, the 1-based row number within the source file.

    A row's number is its distance from its block's first row plus the rows in earlier blocks of the
    file; the block counts are joined back, so use it only where the dense number is wanted.
    """
    tagged = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_name").alias("source_file_name"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).withColumn("_id", F.monotonically_increasing_id())
    in_file = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        tagged.groupBy("_file", "_block")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(in_file), F.lit(0)))
    )
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return tagged.join(blocks, ["_file", "_block"]).select(*scan.columns, "source_file_name", number.alias("row_num"))


def source_position(df: DataFrame) -> Column:
    """Place of a row in its source."""
    return F.col("row_pos") if "row_pos" in df.columns else F.monotonically_increasing_id()


def with_lineage(
    df: DataFrame,
    run_id: str,
    ingest_ts: datetime,
    process_date: str | None = None,
    unit: str | None = None,
    accessed_on: str | None = None,
) -> DataFrame:
    """Constant lineage columns of one run; the instant is passed in so every stage agrees on it."""
    extra = {
        "run_id": F.lit(run_id),
        "ingest_ts_utc": F.lit(ingest_ts.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz"),
    }
    if process_date is not None:
        extra["process_date"] = F.lit(process_date).cast("date")
    if unit is not None:
        extra["unit_raw"] = F.lit(unit)
    if accessed_on is not None:
        extra["accessed_on_raw"] = F.lit(accessed_on)
    return df.withColumns(extra)


def numeric_table(df: DataFrame) -> DataFrame:
    """Names in snake case, all columns numeric; raises on any null or unparsable value."""
    table = snake_case_names(df)
    cast = table.select(*[F.col(c).cast("string").try_cast("double").alias(c) for c in table.columns])
    bad = cast.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cast.columns]).first().asDict()
    found = {c: n for c, n in bad.items() if n}
    if found:
        raise ValueError(f"null or non-numeric values: {found}")
    return cast


# Names under which a label column is looked for, in this order.
LABEL_NAMES = ("species", "target", "class", "label", "variety")


def label_column(df: DataFrame) -> str:
    """First column with a known label name, else the last column."""
    return next((c for c in LABEL_NAMES if c in df.columns), df.columns[-1])
