"""Harmonic packing of token ids into sequences of a fixed capacity.

A document is its ids and an end id, cut into whole sequences and a remainder. The remainder is cut again, greedily,
into pieces whose lengths are the capacity divided by a whole number k (rounded down): the reciprocal-capacity
classes. Every bin of class k holds exactly capacity // length pieces, so each worker fills its own bins without
knowing the others, and a full bin wastes less than its piece length. What a worker has left over of a class (less
than one bin) is filled up across workers by the same count, from running totals of one row per worker and class;
what then remains is less than one bin per class, at most `capacity * (1 + log(capacity))` pieces in all whatever
the size of the data, and is packed first-fit in descending order.

Rules: null and empty texts give the end id alone; a document of n ids always covers 0..n without gap or overlap.
Rows without doc_id and repeated rows are packed as rows of their own. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import decode, documents_of, staged
from .tokenizers import byte_bpe_ids

END_ID = 1
PIECE = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary, "
    "worker int, size int, rank bigint"
)


def class_sizes(capacity: int) -> np.ndarray:
    """The piece lengths capacity // k, ascending."""
    return np.unique(capacity // np.arange(1, capacity + 1))


def cut(n: int, capacity: int, sizes: np.ndarray) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        out.append(int(sizes[np.searchsorted(sizes, rest, side="right") - 1]))
        rest -= out[-1]
    return out


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int, keep_ids: bool = False) -> DataFrame:
    """One row per piece with its worker, its class and its number among the worker's pieces of that class."""

    def run(batches):
        sizes = class_sizes(capacity)
        seen = dict.fromkeys(map(int, sizes), 0)
        worker = TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(byte_bpe_ids(tokenizer, decode(raw)), END_ID).astype("<u4").tobytes()
                start, n = 0, len(ids) // 4
                for length in cut(n, capacity, sizes):
                    piece = ids[4 * start : 4 * (start + length)]
                    rank = seen[length]
                    seen[length] = rank + 1
                    rows.append((doc, start, length, zlib.crc32(piece), n, piece if keep_ids else None, worker, length, rank))
                    start += length
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.int64()] * 5 + [pa.binary(), pa.int32(), pa.int32(), pa.int64()]
            names = [c.split()[0] for c in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return documents_of(docs).mapInArrow(run, PIECE)


def _first_fit(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins 0.. for the few pieces that fill no bin of their class, longest first."""
    rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], na_position="first")
    used: list[int] = []
    first, last = 0, 0
    bins, offsets = [], []
    for n in rows["length"]:
        first = first if n == last else 0  # bins too full for this length stay so for equal lengths
        last = n
        while first < len(used) and used[first] + n > capacity:
            first += 1
        if first == len(used):
            used.append(0)
        bins.append(first)
        offsets.append(used[first])
        used[first] += n
    return rows.assign(sequence_id=rows["sequence_id"] + np.array(bins, dtype="int64"), offset=np.array(offsets, dtype="int64"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Place every piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, its ids."""
    pieces = staged(cut_documents(docs, tokenizer, capacity, keep_ids), "pieces")
    per = F.expr(f"{capacity} div size")
    before = Window.partitionBy("size").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("size")
    counts = (
        pieces.groupBy("size", "worker")
        .count()
        .select("size", "worker", F.expr(f"count div ({capacity} div size)").alias("full"), (F.col("count") % per).alias("rest"))
        .withColumns(
            {
                "full_before": F.coalesce(F.sum("full").over(before), F.lit(0)),
                "rest_before": F.coalesce(F.sum("rest").over(before), F.lit(0)),
                "full_all": F.sum("full").over(whole),
                "rest_bins": F.expr(f"sum(rest) OVER (PARTITION BY size) div ({capacity} div size)"),
            }
        )
    )
    counts = staged(counts, "piece-counts")
    # One row per class, fewer than 2 * sqrt(capacity) of them: a window over all is bounded.
    ahead = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.groupBy("size").agg(F.max(F.col("full_all") + F.col("rest_bins")).alias("bins"))
    base = classes.select("size", F.coalesce(F.sum("bins").over(ahead), F.lit(0)).alias("base"))
    total = classes.agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("all_bins"))
    counts = counts.join(F.broadcast(base), "size").join(F.broadcast(total))

    own = F.col("full") * per
    left = F.col("rest_before") + F.col("rank") - own
    placed = pieces.join(counts, ["size", "worker"]).withColumns(
        {
            "number": F.when(F.col("rank") < own, F.col("full_before") * per + F.col("rank")).when(
                left < F.col("rest_bins") * per, F.col("full_all") * per + left
            )
        }
    )
    placed = placed.withColumns(
        {
            "sequence_id": F.expr(f"CASE WHEN number IS NULL THEN all_bins ELSE base + number div ({capacity} div size) END"),
            "offset": F.expr(f"number % ({capacity} div size) * size"),
        }
    )
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    placed = placed.select(*names)
    tail = placed.where("offset IS NULL")
    packed = tail.groupBy(F.col("length") * 0).applyInPandas(lambda rows: _first_fit(rows, capacity), tail.schema)
    return placed.where("offset IS NOT NULL").unionByName(packed)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences of `pack(..., keep_ids=True)`: sequence_id, n_tokens and ids as little-endian bytes."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # at most `capacity` pieces
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
    )
