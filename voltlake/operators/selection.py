"""Exact order statistics over any number of rows: ranges of values are narrowed by counting, nothing is sorted.

Doubles are taken as whole numbers in their own order, so a range is cut into equal parts of its bit patterns and a
single value is reached after a fixed number of rounds, whatever the spread. A round is one scan: tasks count the
parts of the open ranges of all columns, one small shuffle adds them up, and the driver sees only part counts.

Nulls and NaN are missing values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 512  # of a range, counted in one round


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned whole numbers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return (bits ^ (bits >> 63 & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


@dataclass
class Range:
    """Values of a column from `low` to `high`, both of them there, and how many they are."""

    low: float
    high: float
    n: int


def _starts(bounds: Sequence[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high = (ordered_bits(np.array(side, np.float64)) for side in zip(*bounds, strict=True))
    return low, high, (high - low) // np.uint64(PARTS) + np.uint64(1)


def _counter(open_ranges: list[list[tuple[float, float]]]):
    """Counts, least and greatest values of the parts of the open ranges, ascending for each column."""
    cuts = [_starts(r) if r else None for r in open_ranges]

    def run(batches):
        n = [np.zeros((len(r), PARTS), np.int64) for r in open_ranges]
        low = [np.full((len(r), PARTS), np.inf) for r in open_ranges]
        high = [np.full((len(r), PARTS), -np.inf) for r in open_ranges]
        for b in batches:
            for c, cut in enumerate(cuts):
                if cut is None:
                    continue
                x = b.column(c).drop_null().to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                bits = ordered_bits(x)
                at = np.searchsorted(cut[0], bits, side="right") - 1
                inside = (at >= 0) & (bits <= cut[1][np.maximum(at, 0)])
                at, bits, x = at[inside], bits[inside], x[inside]
                part = ((bits - cut[0][at]) // cut[2][at]).astype(np.int64)
                np.add.at(n[c], (at, part), 1)
                np.minimum.at(low[c], (at, part), x)
                np.maximum.at(high[c], (at, part), x)
        for c in range(len(cuts)):
            at, part = np.nonzero(n[c])
            columns = [np.full(len(at), c, np.int32), at.astype(np.int32), part.astype(np.int32), n[c][at, part], low[c][at, part], high[c][at, part]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["column", "range", "part", "n", "low", "high"])

    return run


def refine(df: DataFrame, columns: Sequence[str], wanted: Callable[[list[Range]], list[int]]) -> dict[str, list[Range]]:
    """Ranges that hold all values of each column, in order. `wanted` names those of a column to be cut further."""
    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    known = [F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")) for i in range(len(columns))]
    bounds = [e.alias(f"{k}{i}") for i, x in enumerate(known) for k, e in (("n", F.count(x)), ("lo", F.min(x)), ("hi", F.max(x)))]
    first = values.agg(*bounds).first()  # one row
    ranges = [[Range(first[f"lo{i}"], first[f"hi{i}"], first[f"n{i}"])] if first[f"n{i}"] else [] for i in range(len(columns))]
    while True:
        cut = [[k for k in wanted(r) if r[k].low < r[k].high] for r in ranges]
        if not any(cut):
            return dict(zip(columns, ranges, strict=True))
        counted = values.mapInArrow(_counter([[(r[k].low, r[k].high) for k in at] for r, at in zip(ranges, cut, strict=True)]), "column int, range int, part int, n bigint, low double, high double")
        rows = counted.groupBy("column", "range", "part").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
        parts: dict[tuple[int, int], list[Range]] = {}
        for r in sorted(rows, key=lambda r: r["part"]):
            parts.setdefault((r["column"], cut[r["column"]][r["range"]]), []).append(Range(r["low"], r["high"], r["n"]))
        ranges = [[p for k, whole in enumerate(r) for p in parts.get((c, k), [whole])] for c, r in enumerate(ranges)]


def _holder(ranges: list[Range], rank: int) -> tuple[int, int]:
    """The range with the value of a rank from 0, and the rank within it."""
    for k, r in enumerate(ranges):
        if rank < r.n:
            return k, rank
        rank -= r.n
    raise IndexError(rank)


def _middle(ranges: list[Range]) -> list[int]:
    n = sum(r.n for r in ranges)
    return [(n - 1) // 2, n // 2] if n else []


def _value(ranges: list[Range], rank: int) -> float | None:
    """The value of a rank if the ranges tell it: a range of one value, or an end of a range."""
    k, within = _holder(ranges, rank)
    r = ranges[k]
    return r.low if within == 0 or r.low == r.high else r.high if within == r.n - 1 else None


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """The median of each column, the mean of the two middle values if their number is even; null without values."""

    def open_(ranges: list[Range]) -> list[int]:
        return sorted({_holder(ranges, k)[0] for k in _middle(ranges) if _value(ranges, k) is None})

    out: dict[str, float | None] = {}
    for c, ranges in refine(df, columns, open_).items():
        middle = [_value(ranges, k) for k in _middle(ranges)]
        # Halved before they are added, two large values don't overflow.
        out[c] = None if not middle else middle[0] if middle[0] == middle[1] else middle[0] / 2 + middle[1] / 2
    return out


def split_candidates(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """At most `bins - 1` ascending thresholds a column that cut its rows as evenly as its values allow.

    Halfway between neighbouring values: between all of them if a column has no more than `bins`, otherwise where
    the running count passes a multiple of the rows of a bin.
    """

    def heavy(ranges: list[Range]) -> list[int]:
        share = sum(r.n for r in ranges) / bins
        few = len(ranges) <= bins
        return [k for k, r in enumerate(ranges) if r.n > share or few]

    out = {}
    for c, ranges in refine(df, columns, heavy).items():
        total, seen, cuts = sum(r.n for r in ranges), 0, []
        for r, after in zip(ranges, ranges[1:], strict=False):
            passed = (seen + r.n) * bins // total > seen * bins // total
            seen += r.n
            if passed or len(ranges) <= bins:
                cuts.append(_between(r.high, after.low))
        out[c] = cuts
    return out


def _between(a: float, b: float) -> float:
    """Halfway from a up to b, b left out."""
    middle = a / 2 + b / 2
    return middle if a <= middle < b and math.isfinite(middle) else a


def impute_and_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Add each column with its exact median in the place of missing values, less its mean, over its population deviation.

    A constant column keeps its scale; a column without values stays null.
    """
    medians = exact_medians(df, columns)
    filled = {c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(medians[c])) for c in columns}
    moments = df.agg(*[e.alias(f"{k}{i}") for i, c in enumerate(columns) for k, e in (("m", F.avg(filled[c])), ("s", F.stddev_pop(filled[c])))]).first()  # one row
    scaled = {f"{c}{suffix}": (filled[c] - F.lit(moments[f"m{i}"])) / F.lit(moments[f"s{i}"] or 1.0) for i, c in enumerate(columns)}
    return df.withColumns(scaled)
