"""L2 logistic regression by Newton steps, all folds of a cross-validation in one pass a step.

The loss is half the squared coefficients plus C times the summed log loss over standardised features (population
deviation); the intercept carries no penalty. A step needs X'WX and X'r of each model, which tasks sum in arrays and one
small shuffle adds up; the systems, as large as the features, are solved on the driver. The standardisation of a
training fold comes from moments kept per fold: the total less the fold's own.

With two classes a model has one coefficient vector, with more one a class (softmax). Rows with a missing feature or
label are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import _complete


@dataclass
class Logistic:
    """Mean and scale of the features, and coefficients, the intercept last, one row per modelled class."""

    classes: list
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.beta.T
        return class_shares(z)


def class_shares(z: np.ndarray) -> np.ndarray:
    """Probabilities from the scores of one modelled class or of all."""
    if z.shape[1] == 1:
        p = 0.5 * (1 + np.tanh(z / 2))
        return np.c_[1 - p, p]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _matrix(b: pa.RecordBatch, width: int) -> np.ndarray:
    return np.stack([b.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(width)], axis=1)


def _sums(width: int, per_batch):
    """One row of sums per model and task."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for model, values in per_batch(b, _matrix(b, width)):
                total[model] = total.get(model, 0) + values
        for model, values in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([values.tolist()], pa.list_(pa.float64()))], ["model", "sums"])

    return run


def _added(rows: DataFrame, run) -> dict[int, np.ndarray]:
    """Sums by model: one row a model on the driver, each as wide as a model's system."""
    parts = rows.mapInArrow(run, "model int, sums array<double>").select("model", F.posexplode("sums").alias("at", "x"))
    summed = parts.groupBy("model", "at").agg(F.sum("x").alias("x")).collect()
    out: dict[int, dict[int, float]] = {}
    for r in summed:
        out.setdefault(r["model"], {})[r["at"]] = r["x"]
    return {m: np.array([values[i] for i in range(len(values))]) for m, values in out.items()}


def fit_folds(
    df: DataFrame, features: Sequence[str], label: str, fold: str | None = None, c: float = 1.0, max_iter: int = 100, tolerance: float = 1e-10
) -> dict[int | None, Logistic]:
    """A model per fold, trained on the rows of the other folds; without `fold`, one model of all rows under None."""
    known = _complete(df, features, label)
    number = F.col(fold).cast("int") if fold else F.lit(-1)
    read = known.select(*[F.col(x).cast("double").alias(f"f{i}") for i, x in enumerate(features)], F.col(label).alias("label"), number.alias("fold"))
    rows = read.persist()
    try:
        return _fit(rows, len(features), c, max_iter, tolerance, bool(fold))
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, width: int, c: float, max_iter: int, tolerance: float, folds: bool) -> dict[int | None, Logistic]:
    counted = rows.groupBy("fold", "label").count().collect()  # folds x classes
    classes = sorted({r["label"] for r in counted})
    if len(classes) < 2:
        raise ValueError("two classes are needed")
    names = sorted({r["fold"] for r in counted})
    n = {k: sum(r["count"] for r in counted if r["fold"] == k) for k in names}
    # Moments about the mean of everything, which keeps large values from cancelling.
    centre = _added(rows, _sums(width, lambda b, x: [(0, x.sum(axis=0))]))[0] / sum(n.values())

    def moments(b, x):
        fold = b.column("fold").to_numpy()
        for k in np.unique(fold).tolist():
            d = x[fold == k] - centre
            yield k, np.r_[d.sum(axis=0), (d * d).sum(axis=0)]

    own = _added(rows, _sums(width, moments))
    total, size = sum(own.values()), sum(n.values())
    place = {x: i for i, x in enumerate(classes)}
    scores = 1 if len(classes) == 2 else len(classes)
    models: dict[int, Logistic] = {}
    for k in names:
        kept, m = (total - own[k], size - n[k]) if folds else (total, size)
        if m == 0:
            raise ValueError("a fold holds every row")
        mean = kept[:width] / m
        deviation = np.sqrt(np.maximum(kept[width:] / m - mean**2, 0))
        models[k] = Logistic(classes, centre + mean, np.where(deviation > 1e-12 * (1 + np.abs(mean)), deviation, 1.0), np.zeros((scores, width + 1)))
    open_ = set(names)
    for _ in range(max_iter):
        if not open_:
            break
        current = {k: models[k] for k in open_}

        def step(b, x, current=current):
            fold, label = b.column("fold").to_numpy(), b.column("label").to_pylist()
            y = np.zeros((len(x), len(classes)))
            y[np.arange(len(x)), [place[v] for v in label]] = 1
            for k, model in current.items():
                mine = fold != k if folds else np.ones(len(x), bool)
                if mine.any():
                    yield k, system(model, x[mine], y[mine])

        sums = _added(rows, _sums(width, step))
        for k in sorted(open_):
            if newton_step(models[k], sums[k], c) < tolerance:
                open_.discard(k)
    return models if folds else {None: models[names[0]]}


def system(model: Logistic, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the summed log loss, flattened; the loss at the end."""
    z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    p = class_shares(z @ model.beta.T)
    loss = -np.log(np.maximum((p * y).sum(axis=1), 1e-300)).sum()
    if len(model.beta) == 1:
        q, r = p[:, 1], p[:, 1] - y[:, 1]
        return np.r_[z.T @ r, ((z * (q * (1 - q))[:, None]).T @ z).ravel(), loss]
    m, d = len(model.beta), z.shape[1]
    hessian = np.zeros((m, d, m, d))
    for a in range(m):
        for b in range(a, m):
            w = p[:, a] * ((a == b) - p[:, b])
            hessian[a, :, b] = hessian[b, :, a] = (z * w[:, None]).T @ z
    return np.r_[((p - y).T @ z).ravel(), hessian.ravel(), loss]


def newton_step(model: Logistic, sums: np.ndarray, c: float) -> float:
    """Move the model by one step; the largest change. Long steps are shortened, for the loss is steep far out."""
    size = model.beta.size
    penalty = np.ones_like(model.beta)
    penalty[:, -1] = 0
    gradient = c * sums[:size] + (penalty * model.beta).ravel()
    hessian = c * sums[size : size + size * size].reshape(size, size) + np.diag(penalty.ravel())
    # With a score for every class the intercepts are only known up to a common shift; the least solution is taken.
    move = np.linalg.lstsq(hessian, gradient, rcond=1e-13)[0].reshape(model.beta.shape)
    length = np.abs(move).max()
    model.beta = model.beta - move * min(1.0, 4.0 / length if length else 1.0)
    return float(length)


def predict_folds(df: DataFrame, features: Sequence[str], models: dict[int | None, Logistic], fold: str | None = None) -> DataFrame:
    """`df` with `prediction` and `probability` by class, each row by the model of its fold. Null with a missing feature."""
    sample = next(iter(models.values())).classes[0]
    kind, arrow = ("string", pa.string()) if isinstance(sample, str) else ("double", pa.float64())
    schema = f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, prediction {kind}, probability array<double>"
    number = F.col(fold).cast("int") if fold else F.lit(None).cast("int")
    read = df.select("*", *[F.col(x).cast("double").alias(f"f{i}") for i, x in enumerate(features)], number.alias("_model"))
    width, names, columns = len(features), df.columns, len(df.columns)

    def run(batches):
        for b in batches:
            x, which = _matrix(b, width).astype(np.float64), b.column("_model").to_pylist()
            known = ~np.isnan(x).any(axis=1)
            best, shares = [None] * len(x), [None] * len(x)
            for k, model in models.items():
                rows = np.flatnonzero(known & np.array([w == k for w in which], bool))
                if len(rows):
                    p = model.probabilities(x[rows])
                    for row, share in zip(rows.tolist(), p, strict=True):
                        best[row], shares[row] = model.classes[int(share.argmax())], share.tolist()
            best = [float(v) if v is not None and kind == "double" else v for v in best]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(columns)), pa.array(best, arrow), pa.array(shares, pa.list_(pa.float64()))], [*names, "prediction", "probability"])

    return read.mapInArrow(run, schema)
