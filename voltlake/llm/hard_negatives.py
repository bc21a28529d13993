"""Hard negatives by threshold joins over an inverted index of whole-number vectors.

Every row is dealt by hash to a block of bounded bytes; anchors are sent to all blocks, never rows to all anchors. In a
block a join returns all rows whose inner product with an anchor reaches the anchor's threshold t:

* *Index.* Dimensions are ordered by their weight in the block and cut into runs. A row is listed under its leading
  runs only: once the norm of its suffix times the largest suffix norm of the anchors is below the least threshold,
  the suffix is omitted, and a row whose whole norm is too small is in no list. With rows ordered by the number of
  their runs, the list of a run is a prefix of the rows.
* *Accumulation.* Partial scores add up run by run. Half-way, and at the end of the lists, a pair is dropped if its
  partial score and the product of both remaining norms stay below t. The others are scored in full.
* *Lowering.* A search starts with a high threshold. Anchors whose windows (score ranges to fill with k rows) hold k
  rows at or above it are done; for the others it is lowered, down to the foot of the window.

The first block is searched by itself. The k-th score found there is a floor for the other blocks, where one search at
the floor is enough. Positives are one window over the rows of the anchor's label; each positive then opens a window
over the other labels. What a block returns is at most its k best rows of a window, so copies cost nothing.

Rules: rows without vec_id or label, and rows whose vector is null or holds a null or non-finite component (or one
that scaling makes infinite), take no part. Rows equal in id, label and vector are one row; rows that share only the
id are rows of their own. Vectors of different length are not compared. Inner products are exact; beyond the range of
a long they count as its ends. Ties go to the smaller vec_id. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, slots, staged

BLOCK_BYTES = 32 << 20  # of the vectors of a block, 8 bytes a component
BLOCK_ROWS = 2048  # smaller blocks are not made for the sake of more tasks
RUN = 16  # dimensions of a posting run
TILE = 1 << 21  # scores held at once
LOWERED = (0.25, 0.35, 0.45, 1.0)  # of the way from the top of a window to its foot
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
EXACT = float(1 << 53)


def _packed(v: np.ndarray) -> bytes:
    return b"s" + v.astype("<i2").tobytes() if (np.abs(v) < 32768).all() else b"d" + v.astype("<f8").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if raw[:1] == b"s" else "<f8", offset=1).astype(np.float64)


def _table(column: pa.Array) -> np.ndarray:
    return np.stack([_unpacked(v) for v in column.to_pylist()])


def _whole(scale: float):
    """Components as floor(scale * x); rows that take no part are left out."""

    def run(batches):
        for b in batches:
            keep, vec, dim = [], [], []
            for v in b.column(3).to_pylist():
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * np.array(v, np.float64)) if v is not None and None not in v else None
                keep.append(x is not None and bool(np.isfinite(x).all()))
                if keep[-1]:
                    vec.append(_packed(x))
                    dim.append(len(x))
            kept = b.select([0, 1, 2]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(dim, pa.int32()), pa.array(vec, pa.binary())], ["vec_id", "label", "anchor", "dim", "vec"])

    return run


def exact_products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the rows of x, exact, clipped to a long."""
    bound = np.sqrt((a * a).sum(axis=1)) * np.sqrt((x * x).sum(axis=1))
    out = np.zeros(len(a), np.int64)
    narrow = bound < EXACT
    out[narrow] = np.einsum("ij,ij->i", a[narrow], x[narrow]).astype(np.int64)
    for i in np.flatnonzero(~narrow):
        product = sum(int(p) * int(q) for p, q in zip(a[i].tolist(), x[i].tolist(), strict=True))
        out[i] = max(LOWEST, min(HIGHEST, product))
    return out


def _suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norms of what is left of each row from each run on; the last column is zero."""
    runs = -(-x.shape[1] // RUN)
    squares = np.stack([(x[:, c * RUN : (c + 1) * RUN] ** 2).sum(axis=1) for c in range(runs)] + [np.zeros(len(x))], axis=1)
    return np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])


class Block:
    """The rows of a block, ready to be indexed for the thresholds of some anchors."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.keys, self.labels = ids, keys, labels
        self.order = np.argsort(-(x * x).sum(axis=0), kind="stable")
        self.x = x[:, self.order]
        self.left = _suffix_norms(self.x)

    def above(self, a: np.ndarray, t: np.ndarray):
        """(i, j, score) of all pairs of anchors a and rows whose score is at least t[i], in pieces of bounded size.

        A bound that overflows prunes nothing: what is left is scored in exact whole numbers."""
        a = a[:, self.order]
        left = _suffix_norms(a)
        # Listed runs of each row: the suffix from there on can't reach the least threshold, whatever the anchor.
        most = left.max(axis=0) * (1 + 1e-9)
        omitted = self.left * most + 1e-9 < t.min()
        listed = np.where(omitted.any(axis=1), omitted.argmax(axis=1), self.left.shape[1] - 1)
        rows = np.argsort(-listed, kind="stable")
        rows = rows[: int((~omitted[:, 0]).sum())]
        if not len(rows):
            return
        x, cut = self.x[rows], listed[rows]
        runs = self.left.shape[1] - 1
        in_list = [int((cut > c).sum()) for c in range(runs)]
        step = max(1, TILE // len(rows))
        for first in range(0, len(a), step):
            part = slice(first, first + step)
            p, lefts, floor = a[part], left[part], t[part, None]
            slack = 1 + 1e-9 * lefts[:, :1] * self.left[rows, 0].max()
            score = np.zeros((len(p), len(rows)))
            open_pairs, done = None, 0
            for c in range(runs):
                if not in_list[c]:
                    break
                run = slice(c * RUN, (c + 1) * RUN)
                score[:, : in_list[c]] += p[:, run] @ x[: in_list[c], run].T
                done = c + 1
                if c + 1 == runs // 2:
                    seen = np.minimum(cut, done)
                    open_pairs = ~(score + lefts[:, seen] * self.left[rows, seen] < floor - slack)
                    if open_pairs.mean() < 0.125:
                        break
            seen = np.minimum(cut, done)
            near = ~(score + lefts[:, seen] * self.left[rows, seen] < floor - slack)
            i, j = np.nonzero(near if open_pairs is None else near & open_pairs)
            for k in range(0, len(i), piece := max(1, TILE // max(1, x.shape[1]))):
                at, row = i[k : k + piece], j[k : k + piece]
                exact = exact_products(p[at], x[row])
                good = exact >= t[part][at]
                yield at[good] + first, rows[row[good]], exact[good]


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each group: higher scores, then smaller ids."""
    order = np.lexsort((keys, ids, -score.astype(object) if (score == LOWEST).any() else -score, group))
    g = group[order]
    start = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1] if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))
    return order[rank < k]


class Anchors:
    """Anchors of a batch with the windows each of them has to fill."""

    def __init__(self, b: pa.RecordBatch):
        self.ids, self.keys = b.column("vec_id").to_numpy(), b.column("key").to_numpy()
        self.labels = np.array(b.column("label").to_pylist(), object)
        self.a = _table(b.column("vec"))
        feet, tops = b.column("feet").to_pylist(), b.column("tops").to_pylist()
        width = max(map(len, feet))
        self.feet = np.array([f + [HIGHEST] * (width - len(f)) for f in feet], np.int64).reshape(len(feet), width)
        self.tops = np.array([f + [LOWEST] * (width - len(f)) for f in tops], np.int64).reshape(len(feet), width)

    def search(self, block: Block, same: bool, k: int, lowered: tuple[float, ...]):
        """(anchor, window, row, score): of each window the k best rows of the block."""
        upper = np.sqrt((self.a**2).sum(axis=1)) * (block.left[:, 0].max() + 1)
        top = np.minimum(self.tops, upper[:, None])
        foot = np.maximum(self.feet, -upper[:, None] - 1)
        wanted = self.tops >= self.feet
        for way in lowered:
            at = np.flatnonzero(wanted.any(axis=1))
            if not len(at):
                return
            t = np.where(wanted[at], np.maximum(foot[at], top[at] - (top[at] - foot[at]) * way), np.inf).min(axis=1)
            if way == 1.0:
                t = np.where(wanted[at], foot[at], np.inf).min(axis=1)
            kept = [[] for _ in range(4)]
            for i, j, score in block.above(self.a[at], t):
                i = at[i]
                mine = (block.labels[j] == self.labels[i]) == same
                mine &= ~((block.ids[j] == self.ids[i]) & (block.keys[j] == self.keys[i]))
                i, j, score = i[mine], j[mine], score[mine]
                for w in range(wanted.shape[1]):
                    inside = wanted[i, w] & (score >= self.feet[i, w]) & (score <= self.tops[i, w])
                    gi, gj, gs = i[inside], j[inside], score[inside]
                    b = _best(gi, gs, block.ids[gj], block.keys[gj], k)
                    for column, values in zip(kept, (gi[b], np.full(len(b), w), gj[b], gs[b]), strict=True):
                        column.append(values)
            if not kept[0]:
                i = w = j = score = np.zeros(0, np.int64)
            else:
                i, w, j, score = map(np.concatenate, kept)
            b = _best(i * wanted.shape[1] + w, score, block.ids[j], block.keys[j], k)
            i, w, j, score = i[b], w[b], j[b], score[b]
            full = np.bincount(i * wanted.shape[1] + w, minlength=wanted.size).reshape(wanted.shape) >= k
            final = full | (way == 1.0)
            ready = final[i, w]
            yield i[ready], w[ready], j[ready], score[ready]
            wanted &= ~final


FOUND = "vec_id bigint, key bigint, slot int, other bigint, other_key bigint, score bigint"
SENT = ["block", "side", "vec_id", "key", "label", "vec", "feet", "tops"]


def _by_block(batches):
    """(block, side, record batch) for each stretch of equal block and side."""
    for b in batches:
        place = list(zip(b.column("block").to_pylist(), b.column("side").to_pylist(), strict=True))
        first = 0
        for n in range(1, len(place) + 1):
            if n == len(place) or place[n] != place[first]:
                yield *place[first], b.slice(first, n - first)
                first = n


def _search(same: bool, k: int, lowered: tuple[float, ...]):
    def run(batches):
        current, rows, block = None, [], None
        for name, side, part in _by_block(batches):
            if name != current:
                current, rows, block = name, [], None
            if side == 0:
                rows.append(part)
                continue
            if not rows and block is None:
                continue
            if block is None:
                t = pa.Table.from_batches(rows).combine_chunks()
                rows = []
                labels = np.array(t.column("label").to_pylist(), object)
                block = Block(t.column("vec_id").to_numpy(), t.column("key").to_numpy(), labels, _table(t.column("vec")))
            anchors = Anchors(part)
            with np.errstate(over="ignore", invalid="ignore"):
                found = list(anchors.search(block, same, k, lowered))
            for i, w, j, score in found:
                columns = [anchors.ids[i], anchors.keys[i], w.astype(np.int32), block.ids[j], block.keys[j], score]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in FOUND.split(", ")])

    return run


def _joined(rows: DataFrame, anchors: DataFrame, blocks: Column, same: bool, k: int, lowered: tuple[float, ...]) -> DataFrame:
    """Best rows by window, of the blocks that `blocks` gives for an anchor."""
    none = F.lit(None).cast("array<bigint>")
    spread = anchors.withColumn("n", F.explode(blocks))
    name = F.concat_ws(":", "dim", "n").alias("block")
    left = rows.select(name, F.lit(0).alias("side"), "vec_id", "key", "label", "vec", none.alias("feet"), none.alias("tops"))
    right = spread.select(name, F.lit(1).alias("side"), "vec_id", "key", "label", "vec", "feet", "tops")
    work = left.unionByName(right).repartition("block").sortWithinPartitions("block", "side")
    return work.select(SENT).mapInArrow(_search(same, k, lowered), FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("vec_id", "key", "slot").orderBy(F.desc("score"), "other", "other_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _windows(rows: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """The k best rows of every window: the first block alone, then the others from the floor that it gives."""
    first = _top(_joined(rows.where("n = 0"), anchors, F.array(F.lit(0)), same, k, LOWERED), k)
    first = staged(first, "first-block")
    floors = first.where(F.col("rank") == k).groupBy("vec_id", "key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("floor"))
    rest = anchors.join(floors, ["vec_id", "key"], "left")
    raised = F.transform("feet", lambda foot, i: F.greatest(foot, F.try_element_at("floor", i)))
    rest = rest.where("blocks > 1").withColumn("feet", F.when(F.col("floor").isNull(), F.col("feet")).otherwise(raised)).drop("floor")
    others = _joined(rows.where("n > 0"), rest, F.sequence(F.lit(1), F.col("blocks") - 1), same, k, (1.0,))
    return staged(_top(first.drop("rank").unionByName(others), k), "windows")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: float = 256.0, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per anchor and positive the best `negatives` rows of other labels with a score of `least` to `most` percent of
    the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. `vectors` has vec_id,
    label and embedding; `is_anchor` is a condition on them."""
    prepare(vectors.sparkSession)
    read = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    whole = read.mapInArrow(_whole(scale), "vec_id bigint, label string, anchor boolean, dim int, vec binary")
    whole = staged(whole.dropDuplicates(["vec_id", "label", "vec", "anchor"]), "whole-vectors")
    # Blocks of one vector length: as many as their bytes ask for, or as the shuffle is wide if rows suffice.
    size = F.ceil(F.col("rows") * F.greatest("dim", F.lit(1)) * 8 / block_bytes)
    wide = F.least(F.lit(slots(vectors.sparkSession)), F.ceil(F.col("rows") / BLOCK_ROWS))
    blocks = whole.groupBy("dim").agg(F.count(F.lit(1)).alias("rows")).select("dim", F.greatest(size, wide).cast("int").alias("blocks"))
    rows = whole.withColumn("key", F.xxhash64("vec_id", "label", "vec")).join(blocks, "dim")
    rows = rows.withColumn("n", F.pmod(F.hash("vec_id", "label", "vec"), "blocks"))
    anchors = rows.where("anchor").drop("anchor", "n")
    own = anchors.withColumns({"feet": F.array(F.lit(LOWEST).cast("bigint")), "tops": F.array(F.lit(HIGHEST))})
    near = _windows(rows, own, True, positives)
    chosen = near.groupBy("vec_id", "key").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "score"))).alias("chosen"))
    # Window bounds in decimals, which no long leaves; a bound beyond a long is one of its ends.
    percent = lambda p: F.col("score").cast("decimal(19,0)") * p / 100
    bounds = near.select("vec_id", "key", "rank", F.ceil(percent(least)).alias("foot"), F.floor(percent(most)).alias("top"))
    lo, hi = (F.lit(x).cast("decimal(22,0)") for x in (LOWEST, HIGHEST))
    clip = lambda c: F.least(F.greatest(F.col(c).cast("decimal(22,0)"), lo), hi).cast("bigint").alias(c)
    bounds = bounds.select("vec_id", "key", "rank", clip("foot"), clip("top"))
    bounds = bounds.groupBy("vec_id", "key").agg(F.sort_array(F.collect_list(F.struct("rank", "foot", "top"))).alias("w"))
    open_ = anchors.join(bounds, ["vec_id", "key"]).withColumns({"feet": F.col("w.foot"), "tops": F.col("w.top")}).drop("w")
    found = _windows(rows, open_, False, negatives)
    out = found.join(chosen, ["vec_id", "key"]).withColumn("positive", F.element_at("chosen", F.col("slot") + 1))
    return out.select(
        F.col("vec_id").alias("anchor_id"),
        F.col("positive.other").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"),
        F.col("positive.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
