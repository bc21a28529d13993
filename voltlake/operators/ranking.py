"""Duplicate counts, duplicate ranks and first-row picks that hold when one key has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import fan_out, reliable_checkpoint

# A key with more rows than this is ranked over many tasks.
HOT_ROWS = 1_000_000
# Rows without a key are never ranked in variant B, so they may be spread freely, over so many lanes at least.
_NULL_LANES = 1024
# Keys are counted together in so many buckets first.
_COUNT_BUCKETS = 1 << 14


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def rank_duplicates(
    df: DataFrame,
    key: str,
    value: str,
    position: str,
    null_key_is_group: bool = False,
    hot_rows: int = HOT_ROWS,
    count_col: str = "duplicate_count",
    rank_col: str = "duplicate_rank",
    flag_col: str = "flag_duplicate_timestamp",
) -> DataFrame:
    """Add the rows per key, whether there are several, and a 1-based rank; every row is kept.

    Rank order: rows whose value is neither zero nor null first, then larger values, nulls last, then
    source position. A null key has no count and no rank, unless `null_key_is_group`.

    One aggregate over hash buckets of the key column rules out keys with more than `hot_rows` rows; only keys of
    buckets with more rows than that are counted one by one. Ordinary keys take one window. Rows of hot keys are range-partitioned on the full rank order, so a hot key spans
    many tasks, and each task's local rank is shifted by the rows of that key in earlier tasks.
    """
    zero = (F.coalesce(F.col(value), F.lit(0.0)) == 0).cast("int")
    order = [zero, F.col(value).desc_nulls_last(), F.col(position)]
    known = F.lit(True) if null_key_is_group else F.col(key).isNotNull()

    groups = _hot_keys(df, key, known, hot_rows)
    hot = groups.agg(F.count(F.lit(1)).alias("keys"), F.sum("_n").alias("rows")).first() if groups else None

    if hot is None or hot["keys"] == 0:
        ranked = _rank_in_window(df, key, order, known, position)
    else:
        keys = groups.select(key)
        cold = df.join(keys, _same_key(df, keys, [key]), "left_anti")
        heavy = df.join(keys, _same_key(df, keys, [key]), "left_semi")
        ranked = _rank_in_window(cold, key, order, known, position).unionByName(
            _rank_over_ranges(heavy, key, order, hot["rows"], hot_rows)
        )
    return ranked.withColumnsRenamed({"_count": count_col, "_rank": rank_col}).withColumn(
        flag_col, F.col(count_col) > 1
    )


def _hot_keys(df: DataFrame, key: str, known: Column, hot_rows: int) -> DataFrame | None:
    """`known` keys with more than `hot_rows` rows and their counts `_n`; None if no bucket of keys has that many.

    The first count filters nothing, as a filter on a parsed key would parse it a second time.
    """
    rows, bucket = F.count_if(known).alias("_n"), F.pmod(F.xxhash64(key), F.lit(_COUNT_BUCKETS))
    full = df.groupBy(bucket.alias("_bucket")).agg(rows).where(F.col("_n") > hot_rows).collect()  # _COUNT_BUCKETS at most
    if not full:
        return None
    return df.where(known & bucket.isin([r["_bucket"] for r in full])).groupBy(key).agg(rows).where(F.col("_n") > hot_rows)


def _rank_in_window(df: DataFrame, key: str, order: list[Column], known: Column, position: str) -> DataFrame:
    lane = F.when(~known, F.pmod(F.xxhash64(position), F.lit(fan_out(df.sparkSession, _NULL_LANES))))
    group = W.partitionBy(key, lane)
    return df.withColumns(
        {
            "_count": F.when(known, F.count(F.lit(1)).over(group)),
            "_rank": F.when(known, F.row_number().over(group.orderBy(*order)).cast("long")),
        }
    )


def _rank_over_ranges(df: DataFrame, key: str, order: list[Column], n_rows: int, hot_rows: int) -> DataFrame:
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * n_rows // hot_rows + 1)
    # The partition numbers must not change between the two uses below, hence the checkpoint.
    ranged = reliable_checkpoint(
        df.repartitionByRange(ranges, F.col(key), *order).withColumn("_range", F.spark_partition_id())
    )
    earlier = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # A range boundary cuts at most one key, so this table has at most one row per key and range more than keys.
    shifts = (
        ranged.groupBy(key, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            key,
            "_range",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(W.partitionBy(key)).alias("_count"),
        )
    )
    local = ranged.withColumn("_local", F.row_number().over(W.partitionBy("_range", key).orderBy(*order)))
    joined = local.join(shifts, _same_key(local, shifts, [key, "_range"]))
    return joined.select(
        *[local[c] for c in df.columns],
        "_count",
        (F.col("_before") + F.col("_local")).alias("_rank"),
    )


def duplicate_counts(df: DataFrame, key: str, count_col: str = "duplicate_count") -> DataFrame:
    """Rows per key on every row, null where the key is null.

    The counts are combined map-side and joined back, so a frequent key is split by the skew join
    instead of being gathered in one window partition.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(count_col))
    # Null keys match nothing; a left join would send them all to one partition, so they pass by.
    keyed = df.where(F.col(key).isNotNull()).join(counts, key)
    unkeyed = df.where(F.col(key).isNull()).withColumn(count_col, F.lit(None).cast("long"))
    return keyed.select(*df.columns, count_col).unionByName(unkeyed)


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by `order`.

    A row-number filter lets every map task drop all but its best row per key before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_pick", rank).where(F.col("_pick") == 1).drop("_pick")


def last_write_wins(df: DataFrame, keys: Sequence[str], values: Sequence[str], position: str) -> DataFrame:
    """The values of the row with the highest position per key.

    A number as position keeps the buffers fixed-width, so the aggregate hashes; a composite position
    makes it sort, and then one buffer holding all values is sorted instead of one per value.
    """
    if dict(df.dtypes)[position].startswith("struct"):
        latest = df.groupBy(*keys).agg(F.max_by(F.struct(*values), position).alias("_v"))
        return latest.select(*keys, "_v.*")
    return df.groupBy(*keys).agg(*[F.max_by(v, position).alias(v) for v in values])
