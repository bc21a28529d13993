"""Decision trees and forests grown level by level from counts.

Rows are coded once: a byte per feature for its place among at most `BINS - 1` thresholds. A level is one scan for all
trees: tasks count (node, feature, place, class) in arrays, a shuffle by node adds them up, the best split is chosen
where a node's counts meet, and one row a node comes to the driver. All counts are whole numbers, so the trees are
the same whatever the partitioning.

Rules: a node is split if it is impure, lies above the greatest depth, has at least `min_split` rows, and a split
leaves `min_leaf` on both sides. The best split has the greatest fall in impurity; falls that agree to nine decimals are
ties, which go to the first feature and then to the lowest threshold. A row goes left if its value is at most the
threshold. Rows with a missing feature or label are left out; scored rows with one have no prediction. In a forest, a
row counts in a tree as often as a Poisson draw from a hash of its id says, and a node chooses among features drawn
by a hash of tree and node.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from .selection import split_candidates

BINS = 32
COUNT_BYTES = 48 << 20  # of the counts a task holds; more nodes than fit are counted in further scans
GOLDEN, M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# Shares of a Poisson variable of mean one at most 0, 1, 2, ...
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 20)]))


@dataclass(frozen=True)
class Settings:
    criterion: str = "gini"  # gini, entropy or log_loss, which is entropy by another name
    max_depth: int = 8
    min_split: int = 2
    min_leaf: int = 1
    bootstrap: bool = False
    features: int | None = None  # drawn for a node; None is all
    seed: int = 0


@dataclass
class Tree:
    """Splits by node number, 1 at the root and 2k, 2k + 1 below k; class counts of every node."""

    settings: Settings
    split: dict[int, tuple[int, int]] = field(default_factory=dict)  # feature and place
    counts: dict[int, np.ndarray] = field(default_factory=dict)
    gain: dict[int, float] = field(default_factory=dict)

    def nodes_of(self, codes: np.ndarray) -> np.ndarray:
        """The deepest node each row reaches."""
        node = np.ones(len(codes), np.int64)
        if not self.split:
            return node
        size = max(self.split) + 1
        feature, place = np.full(size, -1), np.zeros(size, np.int64)
        for k, (f, p) in self.split.items():
            feature[k], place[k] = f, p
        at = np.arange(len(codes))
        while len(at):
            at = at[node[at] < size]
            at = at[feature[node[at]] >= 0]
            k = node[at]
            node[at] = 2 * k + (codes[at, feature[k]] > place[k])
        return node


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + GOLDEN
        x = (x ^ x >> np.uint64(30)) * M1
        x = (x ^ x >> np.uint64(27)) * M2
    return x ^ x >> np.uint64(31)


def draws(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row counts in a tree: Poisson of mean one, from the hash of its id."""
    salt = mix(np.array([seed], np.uint64) << np.uint64(32) | np.uint64(tree))
    u = (mix(ids.view(np.uint64) ^ salt) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(POISSON, u, side="right")


def drawn_features(settings: Settings, tree: int, node: int, width: int) -> np.ndarray:
    """The features a node chooses among, ascending."""
    if settings.features is None or settings.features >= width:
        return np.arange(width)
    salt = np.uint64(settings.seed) << np.uint64(48) ^ np.uint64(tree) << np.uint64(28) ^ np.uint64(node) << np.uint64(8)
    return np.sort(np.argsort(mix(mix(np.arange(width, dtype=np.uint64)) ^ salt), kind="stable")[: settings.features])


def impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity times rows, over the last axis."""
    n = counts.sum(axis=-1, keepdims=True)
    share = counts / np.maximum(n, 1)
    if criterion == "gini":
        return (n[..., 0]) * (1 - (share**2).sum(axis=-1))
    return -(counts * np.log2(np.where(share > 0, share, 1))).sum(axis=-1)


def best_split(counts: np.ndarray, features: np.ndarray, settings: Settings) -> tuple[int, int, float, np.ndarray] | None:
    """Feature, place, fall in impurity and class counts of the left side, from counts (feature, place, class)."""
    left = counts.cumsum(axis=1)[:, :-1]
    total = counts[0].sum(axis=0)
    right = total - left
    fits = (left.sum(axis=-1) >= max(1, settings.min_leaf)) & (right.sum(axis=-1) >= max(1, settings.min_leaf))
    if not fits.any():
        return None
    fall = impurity(total, settings.criterion) - impurity(left, settings.criterion) - impurity(right, settings.criterion)
    fall = np.where(fits, np.round(fall / total.sum(), 9), -np.inf)
    f, p = np.unravel_index(fall.argmax(), fall.shape)  # the first of equal ones
    return int(features[f]), int(p), float(fall[f, p]), left[f, p]


def _coded(cuts: list[np.ndarray], classes: list):
    """Codes of a row's features, its class and the hash of its id."""
    number = {c: i for i, c in enumerate(classes)}

    def run(batches):
        for b in batches:
            codes = codes_of(b, cuts)
            rows = [r.tobytes() for r in codes]
            label = [number[x] for x in b.column("label").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(label, pa.int32()), b.column("id")], ["codes", "label", "id"])

    return run


def codes_of(b: pa.RecordBatch, cuts: list[np.ndarray]) -> np.ndarray:
    columns = [np.searchsorted(cut, b.column(f"f{i}").to_numpy(zero_copy_only=False), side="left") for i, cut in enumerate(cuts)]
    return np.stack(columns, axis=1).astype(np.uint8) if columns else np.zeros((b.num_rows, 0), np.uint8)


def _packed(counts: np.ndarray) -> bytes:
    """Cells that aren't zero: most are in a node of few rows."""
    at = np.flatnonzero(counts)
    return at.astype("<u4").tobytes() + counts[at].astype("<i8").tobytes()


def _add_packed(total: np.ndarray, raw: bytes) -> None:
    n = len(raw) // 12
    total[np.frombuffer(raw, "<u4", n)] += np.frombuffer(raw, "<i8", n, 4 * n)


def _counts(trees: dict[int, Tree], open_: dict[int, list[int]], places: int, width: int, classes: int):
    """Counts of the open nodes, one row a node and task."""

    def run(batches):
        total, chosen, slot = {}, {}, {}
        for t, nodes in open_.items():
            chosen[t] = np.stack([drawn_features(trees[t].settings, t, k, width) for k in nodes])
            total[t] = np.zeros(len(nodes) * chosen[t].shape[1] * places * classes, np.int64)
            slot[t] = np.full(max(nodes) + 1, -1)
            slot[t][nodes] = np.arange(len(nodes))
        for b in batches:
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, width)
            label, ids = b.column("label").to_numpy(), b.column("id").to_numpy()
            for t in open_:
                node = trees[t].nodes_of(codes)
                at = np.where(node < len(slot[t]), slot[t][np.minimum(node, len(slot[t]) - 1)], -1)
                weight = draws(ids, trees[t].settings.seed, t) if trees[t].settings.bootstrap else None
                rows = np.flatnonzero((at >= 0) & (weight > 0) if weight is not None else at >= 0)
                m = chosen[t].shape[1]
                place = codes[rows[:, None], chosen[t][at[rows]]]
                cell = ((at[rows, None] * m + np.arange(m)) * places + place) * classes + label[rows, None]
                w = None if weight is None else np.repeat(weight[rows], m)
                total[t] += np.bincount(cell.ravel(), w, len(total[t])).astype(np.int64)
        for t, nodes in open_.items():
            rows = [(k, _packed(part)) for k, part in zip(nodes, total[t].reshape(len(nodes), -1), strict=True) if part.any()]
            if rows:
                node, packed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(rows), pa.int32()), pa.array(node, pa.int64()), pa.array(packed, pa.binary())], ["tree", "node", "counts"])

    return run


def _chosen(trees: dict[int, Tree], places: int, width: int, classes: int):
    """The best split of each node, whose rows come one after another and are added as they come."""

    names = ["tree", "node", "feature", "place", "fall", "left", "total"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def done(t, k, features, counts) -> tuple:
        counts = counts.reshape(len(features), places, classes)
        best = best_split(counts, features, trees[t].settings)
        f, p, fall, left = best or (-1, 0, 0.0, np.zeros(classes, np.int64))
        return t, k, f, p, fall, left.tolist(), counts[0].sum(axis=0).tolist()

    def batch(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        key, features, total, rows = None, None, None, []
        for b in batches:
            for t, k, raw in zip(*(b.column(c).to_pylist() for c in ("tree", "node", "counts")), strict=True):
                if (t, k) != key:
                    if key is not None:
                        rows.append(done(*key, features, total))
                    if len(rows) >= 1000:
                        yield batch(rows)
                        rows = []
                    key, features = (t, k), drawn_features(trees[t].settings, t, k, width)
                    total = np.zeros(len(features) * places * classes, np.int64)
                _add_packed(total, raw)
        if key is not None:
            yield batch([*rows, done(*key, features, total)])

    return run


def _groups(open_: dict[int, list[int]], trees: dict[int, Tree], cell_bytes: int, width: int) -> Iterator[dict[int, list[int]]]:
    """Open nodes in groups whose counts fit a task."""
    group, size = {}, 0
    for t, nodes in open_.items():
        per_node = cell_bytes * min(width, trees[t].settings.features or width)
        for k in nodes:
            if size + per_node > COUNT_BYTES and group:
                yield group
                group, size = {}, 0
            group.setdefault(t, []).append(k)
            size += per_node
    if group:
        yield group


@dataclass
class Forest:
    """Trees over the same features; a single tree is a forest of one."""

    features: list[str]
    classes: list
    cuts: list[np.ndarray]
    trees: list[Tree]

    def predictions(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The columns `keep`, `tree` and `prediction`: a row for every row without missing features and every tree."""
        known = _complete(df, self.features).select(*keep, *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.features)])
        shared = df.sparkSession.sparkContext.broadcast(self)
        kinds = ", ".join(f"`{c}` {t}" for c, t in known.select(*keep).dtypes)

        def run(batches):
            forest = shared.value
            for b in batches:
                codes = codes_of(b, forest.cuts)
                best = np.stack([Forest(forest.features, forest.classes, forest.cuts, [t]).probabilities(codes).argmax(axis=1) for t in forest.trees], axis=1)
                found = pa.array([[float(forest.classes[k]) for k in row] for row in best.tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), found], [*keep, "found"])

        scored = known.mapInArrow(run, f"{kinds}, found array<double>")
        return scored.select(*keep, F.posexplode("found").alias("tree", "prediction"))

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Mean over the trees of the class shares of the leaves the rows fall in."""
        out = np.zeros((len(codes), len(self.classes)))
        for tree in self.trees:
            node = tree.nodes_of(codes)
            kinds, at = np.unique(node, return_inverse=True)
            share = np.stack([tree.counts[k] / tree.counts[k].sum() for k in kinds.tolist()]) if len(kinds) else np.zeros((0, len(self.classes)))
            out += share[at]
        return out / len(self.trees)

    def split_rows(self) -> list[tuple]:
        """(tree, node, feature, threshold, rows, fall) of every split."""
        return [
            (t, k, self.features[f], float(self.cuts[f][p]), int(tree.counts[k].sum()), tree.gain[k])
            for t, tree in enumerate(self.trees)
            for k, (f, p) in sorted(tree.split.items())
        ]

    def score(self, df: DataFrame, label_type: str = "double") -> DataFrame:
        """`df` with `prediction`, the likeliest class (the first of equal ones), and `probability`, a list by class."""
        schema = f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, prediction {label_type}, probability array<double>"
        known = df.select("*", *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(self.features)])
        shared = df.sparkSession.sparkContext.broadcast(self)  # trees of bounded depth
        names, width = df.columns, len(df.columns)
        kind = pa.float64() if label_type == "double" else None

        def run(batches):
            forest = shared.value
            for b in batches:
                values = np.stack([b.column(f"f{i}").to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(forest.features))], axis=1)
                whole = ~np.isnan(values).any(axis=1)
                p = forest.probabilities(codes_of(b, forest.cuts))
                best = p.argmax(axis=1)
                predicted = pa.array([forest.classes[k] if ok else None for k, ok in zip(best.tolist(), whole.tolist(), strict=True)], kind)
                shares = pa.array([row if ok else None for row, ok in zip(p.tolist(), whole.tolist(), strict=True)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), predicted, shares], [*names, "prediction", "probability"])

        return known.mapInArrow(run, schema)


def _complete(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    ok = F.col(label).isNotNull() if label else F.lit(True)
    for c in features:
        ok &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(ok)


def grow(df: DataFrame, features: Sequence[str], label: str, settings: Sequence[Settings], row_id: str | None = None, bins: int = BINS) -> Forest:
    """All trees of `settings` over one table, grown together. Trees that draw rows need `row_id`.

    The driver keeps the trees; `label` has few classes.
    """
    spark: SparkSession = df.sparkSession
    rows = _complete(df, features, label)
    candidates = split_candidates(rows, features, bins)
    cuts = [np.array(candidates[c], np.float64) for c in features]
    counted = rows.groupBy(label).count().collect()  # one row per class
    classes = sorted(r[label] for r in counted)
    if not classes:
        raise ValueError("no rows to learn from")
    whole = np.array([next(r["count"] for r in counted if r[label] == c) for c in classes], np.int64)
    ids = F.xxhash64(row_id) if row_id else F.lit(0).cast("bigint")
    read = rows.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)], F.col(label).alias("label"), ids.alias("id"))
    path = new_folder(spark, "coded-rows")
    read.mapInArrow(_coded(cuts, classes), "codes binary, label int, id bigint").write.parquet(path)
    coded = spark.read.schema("codes binary, label int, id bigint").parquet(path)

    trees = {i: Tree(s) for i, s in enumerate(settings)}
    places, width = max([len(c) for c in cuts], default=0) + 1, len(cuts)
    for t in trees.values():
        if not t.settings.bootstrap:
            t.counts[1] = whole
    open_ = {i: [1] for i, t in trees.items() if t.settings.bootstrap or _open(t, 1)}
    while open_:
        splits = []
        for group in _groups(open_, trees, places * len(classes) * 8, width):
            counts = coded.mapInArrow(_counts(trees, group, places, width, len(classes)), "tree int, node bigint, counts binary")
            together = counts.repartition("tree", "node").sortWithinPartitions("tree", "node")
            found = together.mapInArrow(_chosen(trees, places, width, len(classes)), "tree int, node bigint, feature int, place int, fall double, left array<bigint>, total array<bigint>")
            splits += found.collect()  # one row per open node
        deeper: dict[int, list[int]] = {}
        for s in sorted(splits, key=lambda s: (s["tree"], s["node"])):
            tree, k = trees[s["tree"]], s["node"]
            tree.counts.setdefault(k, np.array(s["total"], np.int64))
            if s["feature"] < 0 or not _open(tree, k):
                continue
            tree.split[k], tree.gain[k] = (s["feature"], s["place"]), s["fall"]
            left = np.array(s["left"], np.int64)
            for child, n in ((2 * k, left), (2 * k + 1, tree.counts[k] - left)):
                tree.counts[child] = n
                if _open(tree, child):
                    deeper.setdefault(s["tree"], []).append(child)
        open_ = deeper
    for t in trees.values():
        t.counts.setdefault(1, whole)  # a draw without rows
    return Forest(list(features), classes, cuts, list(trees.values()))


def _open(tree: Tree, k: int) -> bool:
    """Whether node k may be split."""
    n = tree.counts[k]
    return k.bit_length() <= tree.settings.max_depth and int(n.sum()) >= max(2, tree.settings.min_split) and int((n > 0).sum()) > 1


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    """Nodes, thresholds and classes as three small tables."""
    nodes = [
        (t, k, *tree.split.get(k, (None, None)), tree.gain.get(k), n.tolist())
        for t, tree in enumerate(forest.trees)
        for k, n in sorted(tree.counts.items())
    ]
    spark.createDataFrame(nodes, "tree int, node bigint, feature int, place int, fall double, counts array<bigint>").write.mode("overwrite").parquet(f"{path}/nodes")
    cuts = [(i, f, c.tolist()) for i, (f, c) in enumerate(zip(forest.features, forest.cuts, strict=True))]
    spark.createDataFrame(cuts, "number int, feature string, cuts array<double>").write.mode("overwrite").parquet(f"{path}/features")
    spark.createDataFrame([(i, float(c)) for i, c in enumerate(forest.classes)], "number int, class double").write.mode("overwrite").parquet(f"{path}/classes")


def load_forest(spark: SparkSession, path: str) -> Forest:
    """A saved forest, for scoring: classes come back as numbers, the settings of its trees do not."""
    features = spark.read.parquet(f"{path}/features").orderBy("number").collect()
    classes = [r["class"] for r in spark.read.parquet(f"{path}/classes").orderBy("number").collect()]
    trees: dict[int, Tree] = {}
    for r in spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").collect():
        tree = trees.setdefault(r["tree"], Tree(Settings()))
        tree.counts[r["node"]] = np.array(r["counts"], np.int64)
        if r["feature"] is not None:
            tree.split[r["node"]], tree.gain[r["node"]] = (r["feature"], r["place"]), r["fall"]
    return Forest([r["feature"] for r in features], classes, [np.array(r["cuts"]) for r in features], list(trees.values()))
