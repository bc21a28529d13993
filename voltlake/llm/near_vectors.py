"""Exact cosine near-dedup of embeddings by dual traversal of cover trees.

Cosine 0.93 of unit vectors is a distance, so balls can be bounded. The vectors of a label are divided level by
level: a net of radius r is drawn from a bounded sample of a cell that is too large, every row goes to its nearest
net point, and r halves. Each cell knows its centre and covering radius. Pairs of cells are traversed top-down from
the roots, and a pair is dropped when its centres lie further apart than both radii and the link distance. Only the
surviving pairs of bounded leaf cells meet in a task, which builds cover trees over both sides and traverses them
in the same way, comparing vectors only in the leaves, or linking two nodes whole when even their furthest
points are near enough.

Equal vectors of a label are one point with a weight. A task returns one row per point: the weight it links to and
the smallest point it is connected with, so no pairs are written however large a group of copies is.

Rules: rows with a null label, or whose vector is null, empty, zero or holds a null or non-finite component, link
with nothing and are their own component. Vectors of different length are not compared. Rows without vec_id have a
null component and add no links. Repeated rows are vectors of their own, and so are rows that share an id and no more.
Vectors of any finite size link by their direction. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, staged
from .graph import components
from .set_join import _runs

CELL_BYTES = 8 << 20  # vectors of a leaf cell at most, unless halving the radius no longer divides it
SAMPLE, NET = 256, 32  # rows of a cell that a net is drawn from, and points of a net, at most
LEAF = 192  # points of a leaf of a local tree, compared by one matrix product
SLACK = 1e-9


def _units(batches):
    """Group (label and length), unit vector; null where a row can't link."""
    for b in batches:
        out = []
        for v in b.column(2).to_pylist():
            x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
            largest = float(np.abs(x).max()) if len(x) and np.isfinite(x).all() else 0.0
            if largest > 0:
                # Scaled by a power of two first: exact, and the norm neither over- nor underflows.
                x = np.ldexp(x, -math.frexp(largest)[1])
                out.append((x / np.sqrt(x @ x)).tobytes())
            else:
                out.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])


def _vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float64)


def _table(column) -> np.ndarray:
    return np.stack([_vector(v) for v in column.to_pylist()])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between unit vectors, which centres are too."""
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def net(x: np.ndarray, radius: float, most: int) -> list[int]:
    """Rows further than `radius` from every row chosen before, in order."""
    near = np.full(len(x), np.inf)
    out: list[int] = []
    for i in range(len(x)):
        if near[i] > radius:
            out.append(i)
            if len(out) == most:
                break
            near = np.minimum(near, distances(x, x[i : i + 1])[:, 0])
    return out


class Node:
    """Points within `radius` of the point `centre`, and the nodes of half its level's radius below it."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, centre: int, level: float):
        self.rows, self.centre = rows, x[centre]
        self.radius = float(distances(x[rows], self.centre[None]).max())
        self.below: list[Node] = []
        while len(rows) > LEAF and level > SLACK:
            chosen = net(x[rows], level, len(rows) // 3)
            if 1 < len(chosen) < len(rows) // 3:
                nearest = distances(x[rows], x[rows[chosen]]).argmin(axis=1)
                self.below = [Node(x, rows[nearest == k], int(rows[c]), level / 2) for k, c in enumerate(chosen) if (nearest == k).any()]
            if len(chosen) > 1:
                break
            level /= 2


class Links:
    """Weight linked to each point and a union-find over the points of a task."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, ids: np.ndarray, cosine: float):
        self.x, self.weight, self.ids, self.cosine = x, weight, ids, cosine
        self.limit = float(np.sqrt(2 - 2 * cosine))
        self.linked = np.zeros(len(x), np.int64)
        self.root = np.arange(len(x))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            i, j = (i, j) if self.ids[i] < self.ids[j] else (j, i)
            self.root[j] = i

    def add(self, a: np.ndarray, b: np.ndarray, near: np.ndarray, same: bool) -> None:
        """Links of the points a with the points b where `near`; `same` if a and b are the same points."""
        self.linked[a] += near @ self.weight[b]
        if not same:
            self.linked[b] += near.T @ self.weight[a]
        for i in np.flatnonzero(near.any(axis=1)):
            first = self.find(a[i])
            for j in np.unique(self.root[b[near[i]]]):
                self.union(first, j)
                first = self.find(first)

    def traverse(self, p: Node, q: Node) -> None:
        gap = float(distances(p.centre[None], q.centre[None])[0, 0])
        if gap > p.radius + q.radius + self.limit + SLACK:
            return
        whole = gap + p.radius + q.radius < self.limit - SLACK
        if whole or not (p.below or q.below):
            near = np.ones((len(p.rows), len(q.rows)), bool) if whole else self.x[p.rows] @ self.x[q.rows].T >= self.cosine
            if p is q:
                np.fill_diagonal(near, False)
            self.add(p.rows, q.rows, near, p is q)
            return
        left, right = p.below or [p], q.below or [q]
        for i, a in enumerate(left):
            for b in left[i:] if p is q else right:
                self.traverse(a, b)


def _join(cosine: float):
    """Weight linked and smallest point connected, for the points of one pair of cells."""

    def run(batches):
        for t in _runs(batches, 2):
            ids, weight, x = t.column("rep").to_numpy(), t.column("weight").to_numpy(), _table(t.column("vec"))
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            cell = np.array(t.column("cell").to_pylist())
            links = Links(x, weight, ids, cosine)
            sides = [np.flatnonzero(cell == c) for c in dict.fromkeys((i, j))]
            if all(map(len, sides)):
                nodes = [Node(x, rows, int(rows[0]), 1.0) for rows in sides]
                links.traverse(nodes[0], nodes[-1])
            at = np.flatnonzero(links.linked)
            if len(at):
                root = ids[[links.find(k) for k in at]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(root), pa.array(links.linked[at])], ["rep", "other", "linked"])

    return run


def _nets(radius: float):
    def run(rows):
        x = _table(rows.column("vec"))
        chosen = net(x, radius, NET)
        return pa.table({"cell": rows.column("cell").slice(0, 1), "centres": [[x[c].tobytes() for c in chosen]]}, schema=pa.schema([("cell", pa.string()), ("centres", pa.list_(pa.binary()))]))

    return run


def _assign(batches):
    """The child cell of every row: the nearest net point of its cell."""
    for b in batches:
        cells = []
        for cell, raw, centres in zip(b.column("cell").to_pylist(), b.column("vec").to_pylist(), b.column("centres").to_pylist(), strict=True):
            best = 0
            if len(centres) > 1:
                best = int((np.stack([_vector(c) for c in centres]) @ _vector(raw)).argmax())
            cells.append(f"{cell}.{best}")
        yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("weight"), b.column("vec"), pa.array(cells, pa.string())], ["rep", "weight", "vec", "cell"])


def _radii(batches):
    for b in batches:
        x, c = b.column("vec").to_pylist(), b.column("centre").to_pylist()
        far = [float(distances(_vector(v)[None], _vector(w)[None])[0, 0]) for v, w in zip(x, c, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("centre"), pa.array(far, pa.float64())], ["cell", "centre", "far"])


def _near_cells(limit: float):
    def run(batches):
        for b in batches:
            keep = []
            for x, y, r, s in zip(*(b.column(c).to_pylist() for c in ("x", "y", "r", "s")), strict=True):
                keep.append(float(distances(_vector(x)[None], _vector(y)[None])[0, 0]) <= r + s + limit + SLACK)
            yield b.select(["i", "j"]).filter(pa.array(keep, pa.bool_()))

    return run


POINTS = "rep bigint, weight bigint, vec binary, cell string"


def _divide(points: DataFrame, cell_rows: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """Points with their leaf cells, and the table (cell, child) of every level."""
    levels, radius = [], 1.0
    while True:
        sizes = points.groupBy("cell").agg(F.count(F.lit(1)).alias("count"), F.sum(F.length("vec")).alias("bytes"))
        large = F.col("count") > cell_rows if cell_rows else F.col("bytes") > CELL_BYTES
        counts = staged(sizes.where(large & (F.col("count") > 1)), "large-cells")
        if radius < SLACK or counts.isEmpty():
            return points, levels
        by_hash = Window.partitionBy("cell").orderBy(F.xxhash64("rep"))
        sample = points.join(counts.select("cell"), "cell").withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= SAMPLE)
        nets = staged(sample.select("cell", "vec").groupBy("cell").applyInArrow(_nets(radius), "cell string, centres array<binary>"), "nets")
        # Cells small enough keep one child, so that all leaves lie at one depth.
        joined = points.join(nets, "cell", "left").withColumn("centres", F.coalesce("centres", F.array().cast("array<binary>")))
        divided = staged(joined.select("rep", "weight", "vec", "cell", "centres").mapInArrow(_assign, POINTS), "cells")
        levels.append(divided.select(F.regexp_replace("cell", r"\.\d+$", "").alias("cell"), F.col("cell").alias("child")).distinct())
        points, radius = divided, radius / 2


def _balls(points: DataFrame, depth: int, up: int) -> DataFrame:
    """cell, centre and covering radius of the cells `up` levels above the leaves."""
    cell = F.regexp_replace("cell", r"(\.\d+){%d}$" % up, "") if up else F.col("cell")
    rows = points.select(cell.alias("cell"), "vec", "rep")
    centres = rows.groupBy("cell").agg(F.min_by("vec", "rep").alias("centre"))
    far = rows.join(centres, "cell").select("cell", "centre", "vec").mapInArrow(_radii, "cell string, centre binary, far double")
    return far.groupBy("cell").agg(F.first("centre").alias("centre"), F.max("far").alias("radius"))


def _cell_pairs(points: DataFrame, levels: list[DataFrame], limit: float) -> DataFrame:
    """Pairs (i, j) of leaf cells, i = j among them, that may hold a link: the dual traversal over whole cells."""
    root = points.select(F.substring_index("cell", ".", 1).alias("i")).distinct()
    pairs = root.select("i", F.col("i").alias("j"))
    for k, level in enumerate(levels):
        down = pairs.join(level.select(F.col("cell").alias("i"), F.col("child").alias("ci")), "i")
        down = down.join(level.select(F.col("cell").alias("j"), F.col("child").alias("cj")), "j")
        down = down.select(F.least("ci", "cj").alias("i"), F.greatest("ci", "cj").alias("j")).distinct()
        ball = staged(_balls(points, len(levels), len(levels) - 1 - k), "balls")
        down = down.join(ball.select(F.col("cell").alias("i"), F.col("centre").alias("x"), F.col("radius").alias("r")), "i")
        down = down.join(ball.select(F.col("cell").alias("j"), F.col("centre").alias("y"), F.col("radius").alias("s")), "j")
        pairs = staged(down.select("i", "j", "x", "y", "r", "s").mapInArrow(_near_cells(limit), "i string, j string"), "cell-pairs")
    return pairs


def near_vectors(vectors: DataFrame, cosine: float = 0.93, cell_rows: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label).

    `cell_rows` bounds cells by rows instead of bytes."""
    spark: SparkSession = prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = staged(rows.mapInArrow(_units, "vec_id bigint, label string, vec binary"), "units")
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
    points = units.where(able).groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    # Numbered as they are written: several points may bear the same smallest id.
    points = staged(points.withColumn("rep", F.monotonically_increasing_id()), "points")
    member = units.where(able).join(points.hint("merge"), ["label", "vec"]).select("vec_id", "rep", "least", "weight")
    # A label is hashed, so that no character of it can look like a path.
    root = F.sha2(F.concat_ws(":", F.length("vec").cast("string"), "label"), 256)
    leaves, levels = _divide(points.select("rep", "weight", "vec", root.alias("cell")), cell_rows)
    pairs = _cell_pairs(leaves, levels, float(np.sqrt(2 - 2 * cosine)))
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("cell"))
    work = sides.join(leaves, "cell").select("i", "j", "cell", "rep", "weight", "vec").repartition("i", "j").sortWithinPartitions("i", "j")
    found = staged(work.mapInArrow(_join(cosine), "rep bigint, other bigint, linked bigint"), "vector-links")
    named = components(found.select("rep", "other"), "rep", "other").withColumnRenamed("node", "rep")
    smallest = named.join(points.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("component_id"))
    named = staged(named.join(smallest, "component").select("rep", "component_id"), "named")
    linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    done = member.join(linked, "rep", "left").join(named, "rep", "left")
    done = done.select("vec_id", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    alone = units.where(~able).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
