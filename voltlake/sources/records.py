"""Records over several lines: ";" files whose quoted cells hold line ends, cut into records block by block."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_BLOCK = ["_file", "_block"]


def _line_ends(line: bytes) -> tuple[bool, bool]:
    """Whether a cell is open after a line, from a closed and from an open start. An open cell ends in a piece between
    two ";" with an odd number of quotes; a piece that starts with a quote opens one if that number is odd. Quotes
    further inside other cells are text."""
    closed, opened = False, True
    for piece in line.split(b";"):
        if piece.count(b'"') % 2:
            starts = piece.lstrip(b" ").startswith(b'"')
            closed, opened = not closed and starts, not opened and starts
    return closed, opened


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[int]]]:
    """The rows of one block each: first row, end, and the rows that hold a quote."""
    n, (files, blocks) = batch.num_rows, (batch.column(c) for c in _BLOCK)
    if n == 0:
        return
    block = blocks.to_numpy()
    other = pc.not_equal(files.slice(1), files.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero((block[1:] != block[:-1]) | other) + 1).tolist(), n]
    marks = np.flatnonzero(pc.fill_null(pc.match_substring(batch.column("value"), '"'), False).to_numpy(zero_copy_only=False))
    cuts = np.searchsorted(marks, edges).tolist()
    for (first, end), (a, b) in zip(pairwise(edges), pairwise(cuts), strict=True):
        yield first, end, marks[a:b].tolist()


def _key(batch: pa.RecordBatch, row: int) -> tuple[str, int]:
    return tuple(batch.column(c)[row].as_py() for c in _BLOCK)


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: whether a cell is open after it, from a closed and an open start, and whether a cell that is open
    at its start ends in it. A block's lines follow each other within a task."""
    key, closed, opened, ends = None, False, True, False
    done = []
    for batch in batches:
        values = batch.column("value").view(pa.binary())
        for first, _, marks in _runs(batch):
            if (now := _key(batch, first)) != key:
                done += [(*key, closed, opened, ends)] if key else []
                key, closed, opened, ends = now, False, True, False
            for line in values.take(pa.array(marks, pa.int64())).to_pylist():
                after = _line_ends(line)
                closed, opened = after[closed], after[opened]
                ends = ends or not opened
        if done:
            yield _rows(done)
            done = []
    if key:
        yield _rows([(*key, closed, opened, ends)])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = {"_file": pa.string(), "_block": pa.int64(), "_closed": pa.bool_(), "_opened": pa.bool_(), "_ends": pa.bool_()}
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))


def _records(batches: Iterator[pa.RecordBatch], cut: bool) -> Iterator[pa.RecordBatch]:
    """Records of blocks: those that lie within their block, or with `cut` the parts of the others, at most two a block.

    `_from` is the block where the record that is open at a block's start begins, null if none is. A record keeps
    the columns of its first line; a part has as `_from` the block where its record begins.
    """
    key, held = None, None  # held: the batch and row of the first line of a record that is open, its lines, its `_from` if cut
    for batch in batches:
        values = batch.column("value").view(pa.binary()).to_pylist()
        out = []  # (batch, row, text, `_from`)
        for first, end, marks in _runs(batch):
            if (now := _key(batch, first)) != key:
                if held and cut:
                    out.append((*held[:2], b"\n".join(held[2]), key[1] if held[3] is None else held[3]))
                key, start = now, batch.column("_from")[first].as_py()
                held = None if start is None else (batch, first, [], start)
            at = first
            for mark in marks:
                if not held:
                    out += [] if cut else [(batch, i, values[i], None) for i in range(at, mark)]
                    held, was_open = (batch, mark, [values[mark]], None), False
                else:
                    held[2].extend(values[at : mark + 1])
                    was_open = True
                if not _line_ends(values[mark])[was_open]:
                    if cut == (held[3] is not None):
                        out.append((*held[:2], b"\n".join(held[2]), held[3]))
                    held = None
                at = mark + 1
            if held:
                held[2].extend(values[at:end])
            elif not cut:
                out += [(batch, i, values[i], None) for i in range(at, end)]
        yield from _gathered(out, cut)
    if held and cut:
        yield from _gathered([(*held[:2], b"\n".join(held[2]), key[1] if held[3] is None else held[3])], cut)


def _gathered(out: list[tuple], cut: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose first lines come from one batch, put together."""
    edges = [0, *(i for i in range(1, len(out)) if out[i][0] is not out[i - 1][0]), len(out)]
    for a, b in pairwise(edges):
        if a == b:
            continue
        _, rows, texts, starts = zip(*out[a:b], strict=True)
        kept = out[a][0].take(pa.array(rows, pa.int64()))
        new = {"value": pa.array(texts, pa.binary()).view(pa.string())} | ({"_from": pa.array(starts, pa.int64())} if cut else {})
        names = [n for n in kept.schema.names if cut or n != "_from"]
        yield pa.record_batch([new.get(n, kept.column(n)) for n in names], names)


def _composed(changes: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """`changes` with `_map`, the composition of the changes of a group up to each row: the last change that sets the
    state (null if none did yet), and whether the swaps since turn it."""
    w = W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    swaps = changes.withColumn("_swaps", F.count_if(F.col("_change") == "swap").over(w))
    fixed = F.when(F.col("_change").isin("in", "out"), F.struct((F.col("_change") == "in").alias("open"), F.col("_swaps").alias("at")))
    last = swaps.withColumn("_set", F.last(fixed, ignorenulls=True).over(w))
    turned = (F.col("_swaps") - F.coalesce(F.col("_set.at"), F.lit(0))) % 2 == 1
    return last.withColumn("_map", F.struct(F.col("_set.open").alias("set"), turned.alias("turned"))).drop("_swaps", "_set")


def _applied(start: Column) -> Column:
    """The state that `_map` makes of the state `start`."""
    return F.coalesce(F.col("_map.set"), start) != F.coalesce(F.col("_map.turned"), F.lit(False))


def _open_blocks(lines: DataFrame) -> DataFrame:
    """Blocks that a record is open at the start of, with the block `_from` where that record begins.

    A block maps the state before it to the state after it; the maps are composed over the blocks of a file, one row
    each. Raises when a quote stays open at the end of a file.
    """
    marked = lines.select(*_BLOCK, F.when(F.col("value").contains('"'), F.col("value")).alias("value"))
    ends = marked.mapInArrow(_block_ends, "_file string, _block bigint, _closed boolean, _opened boolean, _ends boolean")
    change = F.when(F.col("_closed"), F.when(F.col("_opened"), "in").otherwise("swap")).when(~F.col("_opened"), "out")
    states = _composed(ends.select(*_BLOCK, "_ends", change.alias("_change")), ["_file"], "_block")
    states = states.withColumn("_open", _applied(F.lit(False)))
    in_file = W.partitionBy("_file").orderBy("_block")
    states = states.withColumns({"_before": F.coalesce(F.lag("_open").over(in_file), F.lit(False)), "_last": F.lead("_block").over(in_file).isNull()})
    begun = F.when(F.col("_open") & (~F.col("_before") | F.col("_ends")), F.col("_block"))
    begins = F.last(begun, ignorenulls=True).over(in_file.rowsBetween(W.unboundedPreceding, -1))
    unclosed = F.raise_error(F.concat(F.lit("a quote stays open in "), F.col("_file"))).cast("bigint")
    start = F.when(F.col("_last") & F.col("_open"), unclosed).when(F.col("_before"), begins)
    return states.select(*_BLOCK, start.alias("_from")).where("_from IS NOT NULL")


def join_quoted_lines(lines: DataFrame) -> DataFrame:
    """Lines (value, _file, _block, _line, ...) as records: a record goes on while a quoted cell is open.

    `lines` must come straight from the scan, so that a task has all lines of a block in order. A first pass finds
    which blocks a record is open at the start of (one row a block, sent to every task); a second one cuts the blocks
    into records where they are. Only the parts of records that blocks cut, two a block at most, are shuffled. A record
    keeps the other columns of its first line. Raises when a quote stays open at the end of a file, which would make
    the rest of it one record.
    """
    started = lines.join(F.broadcast(_open_blocks(lines)), _BLOCK, "left").select(*lines.columns, "_from")
    whole = started.mapInArrow(partial(_records, cut=False), lines.schema)
    parts = started.mapInArrow(partial(_records, cut=True), started.schema)
    rest = [c for c in lines.columns if c not in ("value", "_file")]
    pieces = F.sort_array(F.collect_list(F.struct("_line", "value")))
    joined = parts.groupBy("_file", "_from").agg(
        F.array_join(F.transform(pieces, lambda x: x["value"]), "\n").alias("value"), *[F.min_by(c, "_line").alias(c) for c in rest]
    )
    return whole.union(joined.select(*lines.columns))
