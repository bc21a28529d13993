"""Parquet and CSV sinks. A run that is repeated leaves the same table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quality import Audit

# Column order of the exported rollup.
EXPORT_COLUMNS = (
    "periodo",
    "consumo_total",
    "producao_total",
    "saldo",
    "ratio_producao_consumo",
    "defice_horas",
    "excedente_horas",
    "leituras",
)


def _files(df: DataFrame, path: str):
    """Hadoop's file system of `path` and a maker of its paths."""
    jvm = df.sparkSession._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), make


def exists(df: DataFrame, path: str) -> bool:
    """Whether `path` is there; `df` only names the session."""
    files, make = _files(df, path)
    return files.exists(make(path))


def _swap(df: DataFrame, new: str, path: str) -> None:
    """Put the finished dataset `new` in the place of `path`; the old one goes last."""
    files, make = _files(df, path)
    old = f"{path.rstrip('/')}.old"
    if files.exists(make(path)):
        files.delete(make(old), True)
        files.rename(make(path), make(old))
    elif not files.exists(make(path).getParent()):
        files.mkdirs(make(path).getParent())
    if not files.rename(make(new), make(path)):
        raise OSError(f"could not move {new} to {path}")
    files.delete(make(old), True)


def recover(df: DataFrame, path: str) -> None:
    """Bring back the old dataset if a run died in the middle of its swap."""
    files, make = _files(df, path)
    old = f"{path.rstrip('/')}.old"
    if files.exists(make(old)) and not files.exists(make(path)):
        files.rename(make(old), make(path))


@contextmanager
def _staged(df: DataFrame, path: str, partition_by: Sequence[str], audit: Audit | None) -> Iterator[str]:
    """Write `df` beside `path` and hand out the folder once `audit` accepts it; what is left of it goes at the end."""
    new = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    files, make = _files(df, path)
    try:
        rows = audit.watch(df) if audit else df
        (rows.write.partitionBy(*partition_by) if partition_by else rows.write).parquet(new)
        if audit:
            audit.settle(df.sparkSession.read.schema(df.schema).parquet(new))
        yield new
    finally:
        files.delete(make(new), True)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), audit: Audit | None = None) -> None:
    """Replace the dataset at `path`.

    Written beside it and swapped in when complete, so a run that dies, or whose `audit` fails, leaves the old
    table, and `df` may read from the table it replaces.
    """
    recover(df, path)
    with _staged(df, path, partition_by, audit) as new:
        _swap(df, new, path)


def replace_partitions(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str],
    covered: Sequence[Sequence[object]] = (),
    audit: Audit | None = None,
) -> None:
    """Replace the partitions present in `df`, and empty those of `covered` that `df` has no row for.

    `covered` lists the partition values a run accounts for. The rebalance clusters rows by partition value, so
    each task writes few files, and lets adaptive execution split a value that holds most rows over as many tasks
    as its size needs. Finished partitions are swapped in one by one, none of them if
    `audit` fails; `df` may read from the table.
    """
    files, make = _files(df, path)
    with _staged(df.hint("rebalance", *partition_by), path, partition_by, audit) as new:
        files.mkdirs(make(path))
        folders = [""]
        for _ in partition_by:
            folders = [
                f"{folder}/{s.getPath().getName()}"
                for folder in folders
                for s in files.listStatus(make(new + folder))
                if s.isDirectory() and "=" in s.getPath().getName()
            ]
        for folder in folders:
            _swap(df, new + folder, path + folder)
        for values in covered:
            folder = "".join(f"/{c}={v}" for c, v in zip(partition_by, values, strict=True))
            if folder not in folders:
                files.delete(make(path + folder), True)


def append_new(df: DataFrame, path: str, key: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Append the rows of `df` whose key is not in the table yet; a second run adds nothing.

    `partition_by` must be the table's own partitioning.
    """
    present = df.sparkSession.read.parquet(path).select(*key)
    new = df.join(present, list(key), "left_anti").select(*df.columns)
    writer = new.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def with_year(df: DataFrame, ts: str = "timestamp_utc", month: bool = False) -> DataFrame:
    """Partition columns `year` (and `month`) for silver and gold tables."""
    columns = {"year": F.year(ts)} | ({"month": F.month(ts)} if month else {})
    return df.withColumns(columns)


def export_csv(df: DataFrame, path: str, columns: Sequence[str] = EXPORT_COLUMNS) -> None:
    """Every cell quoted, nulls as empty cells, a header line, fixed column order, sorted by the first column."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    (
        df.orderBy(columns[0])
        .select(*text)
        .write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )
