"""Token counts without tokens: pieces are counted once per distinct pre-token and joined to frequencies.

A text falls into pre-tokens whose pieces never cross their borders, so its count is the sum over its distinct
pre-tokens of frequency times pieces. The frequencies are packed postings; see `postings`.

Rules: null and empty texts have 0 tokens and 0 bytes. Malformed UTF-8 is counted as U+FFFD, n_bytes as it stands.
Repeated rows and rows without doc_id are counted as rows of their own; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import postings
from .common import decode, documents_of
from .piece_bpe import piece_model
from .set_join import _runs


def _block(path: str):
    def per_block(b: pa.RecordBatch):
        model = piece_model(path)
        raws = b.column(1).to_pylist()
        texts = [[p.encode() for p in model.parts(decode(raw))] for raw in raws]
        return texts, postings.head_of({"doc_id": b.column(0), "n_bytes": pa.array(map(len, raws), pa.int64())}), None

    return per_block


def _count(path: str):
    def run(batches):
        model, bucket, pieces = piece_model(path), None, {}
        for b in batches:
            out = []
            for key, kind, block, words, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == postings.HEAD:
                    out.append((block, b"", b"", body))
                    continue
                if key != bucket:
                    bucket, pieces = key, {}  # distinct pre-tokens of one bucket
                for w in (words := postings.words_of(words)):
                    if w not in pieces:
                        pieces[w] = len(model.encode_part(w.decode()))
                counts = np.fromiter(map(pieces.__getitem__, words), np.int64, len(words))
                out.append(postings.partial_row(block, body, counts[:, None]))
            if out:
                yield postings.partial(out)

    return run


def _add(limit: int):
    def run(batches):
        for t in _runs(batches, 1):
            kept, sums = postings.summed(t, 1)
            total = sums[0].astype(np.int64)
            cols = [*kept.values(), pa.array(total), pa.array(total > limit)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text, counted by a piece model."""
    rows = postings.by_bucket(postings.blocks(documents_of(docs), _block(path)))
    partial = postings.by_block(rows.mapInArrow(_count(path), postings.PARTIAL))
    return partial.mapInArrow(_add(limit), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
