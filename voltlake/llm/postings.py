"""Per-document word frequencies, joined with a value per distinct word without one row per document and word.

A batch of documents is a block. Its words are dealt to buckets by their hash; what a block has for a bucket is one
packed row: the distinct words and, for each, the documents of the block and the frequencies. All rows of a bucket
meet, so every distinct word is looked at once, where its value is found and multiplied into the frequencies. What
comes back is added up per block. A frequent word is one entry per block however many documents hold it, rows are
streamed, and the number of buckets follows the width of shuffles, so no task holds more than a bucket's words.

The input must be read from files or be otherwise repeatable, as a lost task reads its block again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slots

ROW = "bucket int, kind int, block bigint, words binary, body binary"
NAMES = [c.split()[0] for c in ROW.split(", ")]
TOTALS, ENTRIES, HEAD = 0, 1, 2  # kinds, in the order a bucket sees them


class _Numbers(dict):
    """Numbers words in the order they first come."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _packed(*parts: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.array([len(p.tobytes())], "<u4").tobytes() + p.tobytes() for p in parts), 1)


def _unpacked(raw: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(raw), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 4))
        at += 4 + n
    return out


def block_rows(block: int, buckets: int, texts: Sequence[Sequence[bytes]], weigh: np.ndarray | None = None) -> Iterator[tuple]:
    """Packed rows of a block of word lists; `weigh` marks the documents whose words also count towards the totals."""
    numbers = _Numbers()
    words = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in texts]
    if not numbers:
        return
    doc = np.repeat(np.arange(len(words), dtype=np.int64), [len(w) for w in words])
    key, freq = np.unique(np.concatenate(words) * len(words) + doc, return_counts=True)
    word, doc = key // len(words), key % len(words)
    distinct = list(numbers)
    bucket = np.fromiter(map(xxhash.xxh32_intdigest, distinct), np.int64, len(distinct)) % buckets
    order = np.argsort(bucket, kind="stable")
    first = np.searchsorted(word, np.arange(len(distinct) + 1))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        mine = order[cuts[b] : cuts[b + 1]]
        if not len(mine):
            continue
        text = [distinct[i] for i in mine]
        packed = zlib.compress(np.array([len(text), *map(len, text)], "<u4").tobytes() + b"".join(text), 1)
        counts = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        body = _packed(counts.astype("<u4"), doc[at].astype("<u4"), freq[at].astype("<u4"))
        yield b, ENTRIES, block, packed, body
        if weigh is not None:
            total = np.add.reduceat(freq[at] * weigh[doc[at]], np.concatenate([[0], np.cumsum(counts)[:-1]]))
            yield b, TOTALS, block, packed, _packed(total.astype("<u4"))


def words_of(packed: bytes) -> list[bytes]:
    raw = zlib.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    size = np.frombuffer(raw, "<u4", n, 4).tolist()
    out, at = [], 4 + 4 * n
    for k in size:
        out.append(raw[at : at + k])
        at += k
    return out


def totals_of(body: bytes) -> np.ndarray:
    return _unpacked(body, "<u4")[0]


def record(rows: Iterator[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], NAMES)


def blocks(docs: DataFrame, per_block: Callable[[pa.RecordBatch], tuple[Sequence[Sequence[bytes]], bytes, np.ndarray | None]]) -> DataFrame:
    """Packed rows of `docs`. `per_block` turns a batch into word lists, what to keep of the block, and the weights."""
    buckets = slots(docs.sparkSession)

    def run(batches):
        worker = TaskContext.get().partitionId()
        for n, b in enumerate(batches):
            texts, head, weigh = per_block(b)
            block = worker << 32 | n
            yield record(iter([(block % buckets, HEAD, block, b"", head)]))
            rows = list(block_rows(block, buckets, texts, weigh))
            if rows:
                yield record(iter(rows))

    return docs.mapInArrow(run, ROW)


def by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind")


def spread(body: bytes, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents of an entry row and, for each column of `values` (by word), a row of their sums of frequency times value."""
    counts, doc, freq = _unpacked(body, "<u4", "<u4", "<u4")
    docs, at = np.unique(doc, return_inverse=True)
    weights = np.repeat(values, counts, axis=0) * freq[:, None]
    return docs, np.stack([np.bincount(at, w, len(docs)) for w in weights.T])


def by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("block").sortWithinPartitions("block")


def head_of(columns: dict[str, pa.Array]) -> bytes:
    """What to keep of a block for its final rows."""
    kept = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kept.schema) as w:
        w.write_batch(kept)
    return sink.getvalue().to_pybytes()


def summed(t: pa.Table, columns: int) -> tuple[dict[str, pa.Array], np.ndarray]:
    """The kept columns of a block and the sums over its partial rows, one row of sums per column of values."""
    head = next(h for h in t.column("head").to_pylist() if h is not None)
    kept = pa.ipc.open_stream(head).read_all()
    total = np.zeros((columns, len(kept)))
    for docs, sums in zip(t.column("docs").to_pylist(), t.column("sums").to_pylist(), strict=True):
        if docs:
            docs = np.frombuffer(docs, "<u2")
            total[:, docs] += np.frombuffer(zlib.decompress(sums), "<f8").reshape(columns, len(docs))
    return {n: kept.column(n).combine_chunks() for n in kept.column_names}, total


def partial_row(block: int, body: bytes, values: np.ndarray) -> tuple:
    docs, sums = spread(body, values)
    return block, docs.astype("<u2").tobytes(), zlib.compress(sums.astype("<f8").tobytes(), 1), None


PARTIAL = "block bigint, docs binary, sums binary, head binary"


def partial(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["block", "docs", "sums", "head"])
