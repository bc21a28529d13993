"""Trees, forests, logistic regression and medians against plain fits of the same rows."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.operators import features as X
from voltlake.operators import logistic as L
from voltlake.operators import ml
from voltlake.operators import selection as S
from voltlake.operators import trees as T


def numbers(kind, n, rng):
    return {
        "ties": [float(rng.randrange(5)) for _ in range(n)],
        "spread": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(n)],
        "odd": [rng.choice([0.0, -0.0, float("inf"), -float("inf"), 1e308, -1e308, 5e-324, None, float("nan")]) for _ in range(n)],
        "even": [rng.gauss(5, 2) for _ in range(n)],
        "none": [None] * n,
    }[kind]


@pytest.mark.parametrize("n", [1, 2, 7, 500, 1001])
def test_medians_are_exact(spark, n):
    rng = random.Random(n)
    columns = {k: numbers(k, n, rng) for k in ("ties", "spread", "odd", "even", "none")}
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{k} double" for k in columns)).repartition(4)
    got = S.exact_medians(df, list(columns))
    for k, values in columns.items():
        known = sorted(v for v in values if v is not None and v == v)
        want = statistics.median(known) if known else None
        middle = {known[(len(known) - 1) // 2], known[len(known) // 2]} if known else set()
        assert got[k] == want or (middle == {float("inf"), -float("inf")} and got[k] != got[k]) or (middle and abs(want or 0) == float("inf") and got[k] in (want, *middle)), (k, got[k], want)


def test_candidates_lie_between_all_values_or_cut_evenly(spark):
    rng = random.Random(2)
    rows = [(float(i % 6), rng.random() ** 9, 1.0) for i in range(3000)]
    got = S.split_candidates(spark.createDataFrame(rows, "few double, skew double, one double"), ["few", "skew", "one"], 16)
    assert got["few"] == [0.5, 1.5, 2.5, 3.5, 4.5] and got["one"] == []
    places = np.searchsorted(got["skew"], [r[1] for r in rows])
    assert len(got["skew"]) <= 15 and np.bincount(places).max() <= 2.1 * 3000 / 16


def test_scaling_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (None, 2.0, None), (4.0, None, None), (4.0, 2.0, None)], "a double, b double, c double")
    rows = S.impute_and_scale(df, ["a", "b", "c"]).collect()
    assert sorted(r.a_z for r in rows) == pytest.approx(sorted((v - 3.25) / np.std([1, 4, 4, 4]) for v in (1, 4, 4, 4)))
    assert [r.b_z for r in rows] == [0.0] * 4 and [r.c_z for r in rows] == [None] * 4


# A grower that knows nothing of codes, counts or levels.


def plain_impurity(labels, weights, criterion):
    n = sum(weights)
    shares = [sum(w for y, w in zip(labels, weights) if y == c) / n for c in set(labels)]
    return 1 - sum(p * p for p in shares) if criterion == "gini" else -sum(p * np.log2(p) for p in shares if p)


def plain_tree(x, y, w, cuts, settings, tree=0, node=1, out=None):
    out = {} if out is None else out
    keep = [i for i in range(len(y)) if w[i]]
    n = sum(w[i] for i in keep)
    if node.bit_length() > settings.max_depth or n < max(2, settings.min_split) or len({y[i] for i in keep}) < 2:
        return out
    best = None
    for f in T.drawn_features(settings, tree, node, len(cuts)).tolist():
        for cut in cuts[f]:
            sides = [[i for i in keep if (x[i][f] <= cut) == left] for left in (True, False)]
            sizes = [sum(w[i] for i in s) for s in sides]
            if min(sizes) < max(1, settings.min_leaf):
                continue
            below = sum(m / n * plain_impurity([y[i] for i in s], [w[i] for i in s], settings.criterion) for s, m in zip(sides, sizes))
            fall = round(plain_impurity([y[i] for i in keep], [w[i] for i in keep], settings.criterion) - below, 9)
            if best is None or fall > best[0]:
                best = fall, f, cut, sides
    if best:
        out[node] = best[1], best[2], n
        for child, side in zip((2 * node, 2 * node + 1), best[3]):
            plain_tree(x, y, [w[i] if i in set(side) else 0 for i in range(len(y))], cuts, settings, tree, child, out)
    return out


def table(spark, n, seed, classes=3):
    rng = random.Random(seed)
    rows = [(i, float(rng.randrange(9)), rng.gauss(0, 1), float(i % 2), int(rng.random() * classes * 0.999)) for i in range(n)]
    rows = [(i, a, b, c, (y + (a > 4) + (b > 0.3)) % classes) for i, a, b, c, y in rows]
    return rows, spark.createDataFrame(rows, "id bigint, a double, b double, c double, y int")


def splits(forest, tree):
    return {k: (forest.features.index(f), cut, n) for t, k, f, cut, n, _ in forest.split_rows() if t == tree}


def test_grid_trees_equal_a_plain_grower(spark):
    rows, df = table(spark, 150, 1)
    grid = [ml.tree_settings(g) for g in ml.TREE_GRID] + [T.Settings("gini", 6, 40), T.Settings("gini", 6, 2, 20), T.Settings("entropy", 5, 2, 7)]
    forest = T.grow(df, ["a", "b", "c"], "y", grid, bins=16)
    x, y = [r[1:4] for r in rows], [r[4] for r in rows]
    for t, settings in enumerate(grid):
        assert splits(forest, t) == plain_tree(x, y, [1] * len(y), [c.tolist() for c in forest.cuts], settings)
    # The bound on a split and on its leaves are different things.
    assert splits(forest, 8) != splits(forest, 9)


def test_forest_is_that_of_its_draws_whatever_the_partitioning(spark):
    rows, df = table(spark, 120, 3, classes=2)
    settings = [T.Settings("gini", 4, 2, 3, True, 2, 7)] * 5
    forest = T.grow(df, ["a", "b", "c"], "y", settings, "id", bins=8)
    again = T.grow(df.repartition(7).orderBy(F.rand(1)), ["a", "b", "c"], "y", settings, "id", bins=8)
    assert forest.split_rows() == again.split_rows()
    ids = np.array([r[0] for r in df.select(F.xxhash64("id")).collect()], np.int64)
    x, y = [r[1:4] for r in rows], [r[4] for r in rows]
    for t in range(5):
        w = T.draws(ids, 7, t).tolist()
        assert 0.6 < np.mean(w) < 1.4 and splits(forest, t) == plain_tree(x, y, w, [c.tolist() for c in forest.cuts], settings[0], t)
    # Scores are the mean shares of the leaves; a row with a gap has none.
    scored = forest.score(df.unionByName(spark.createDataFrame([(999, None, 0.0, 0.0, 0)], df.schema)))
    got = {r.id: (r.prediction, r.probability) for r in scored.collect()}
    assert got[999] == (None, None)
    for i, a, b, c, _ in rows[:40]:
        shares = []
        for t, tree in enumerate(forest.trees):
            node, w = 1, T.draws(ids, 7, t).tolist()
            inside = list(range(len(y)))
            while node in tree.split:
                f, p = tree.split[node]
                cut = forest.cuts[f][p]
                left = (a, b, c)[f] <= cut
                inside = [j for j in inside if (x[j][f] <= cut) == left]
                node = 2 * node + (not left)
            shares.append(sum(w[j] for j in inside if y[j] == 1) / sum(w[j] for j in inside))
        assert got[i][1][1] == pytest.approx(np.mean(shares))
        assert got[i][0] == float(got[i][1][1] > 0.5)


def test_saved_forest_scores_alike(spark, tmp_path):
    _, df = table(spark, 80, 5)
    forest = T.grow(df, ["a", "b", "c"], "y", [T.Settings(max_depth=3)] * 2)
    T.save_forest(spark, forest, str(tmp_path / "f"))
    loaded = T.load_forest(spark, str(tmp_path / "f"))
    rows = lambda f: sorted((r.id, r.prediction, tuple(r.probability)) for r in f.score(df).collect())
    assert rows(loaded) == rows(forest) and loaded.split_rows() == forest.split_rows()


def test_trees_of_odd_tables(spark):
    one = spark.createDataFrame([(1.0, 0), (2.0, 0), (None, 1), (3.0, None)], "a double, y int")
    forest = T.grow(one, ["a"], "y", [T.Settings()])
    assert forest.split_rows() == [] and {r.prediction for r in forest.score(one.where("a IS NOT NULL")).collect()} == {0.0}
    with pytest.raises(ValueError, match="no rows"):
        T.grow(one.limit(0), ["a"], "y", [T.Settings()])


# Logistic regression


def plain_logistic(x, y, classes, c=1.0):
    """Gradient descent with small steps until nothing moves, on the same loss."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = np.c_[(x - mean) / np.where(scale > 0, scale, 1), np.ones(len(x))]
    m = 1 if len(classes) == 2 else len(classes)
    target = np.array([[float(v == k) for k in classes] for v in y])
    beta, last = np.zeros((m, z.shape[1])), np.inf
    rate = 1.0 / (c * 0.5 * np.linalg.norm(z, 2) ** 2 + 1)
    momentum = beta.copy()
    for i in range(60_000):
        p = L.class_shares(z @ momentum.T)
        r = (p - target) if m > 1 else (p[:, 1:] - target[:, 1:])
        g = c * r.T @ z + np.c_[momentum[:, :-1], np.zeros(m)]
        new = momentum - rate * g
        momentum = new + i / (i + 3) * (new - beta)
        beta = new
        if np.abs(g).max() < 1e-10 or last < 1e-13:
            break
    return beta


@pytest.mark.parametrize("classes", [2, 3])
def test_folds_fit_like_a_plain_regression(spark, classes):
    rows, df = table(spark, 240, 9, classes)
    df = df.withColumn("fold", (F.col("id") % 4).cast("int")).withColumn("a", F.col("a") * 1000 + 1e6)
    models = L.fit_folds(df, ["a", "b", "c"], "y", "fold")
    x = np.array([(r[1] * 1000 + 1e6, *r[2:4]) for r in rows])
    for k, model in models.items():
        mine = [i for i, r in enumerate(rows) if r[0] % 4 != k]
        want = plain_logistic(x[mine], [rows[i][4] for i in mine], model.classes)
        assert np.allclose(model.mean, x[mine].mean(axis=0)) and np.allclose(model.scale, x[mine].std(axis=0))
        assert np.abs(model.beta[:, :-1] - want[:, :-1]).max() < 1e-6
        shift = model.beta[:, -1] - want[:, -1]
        assert np.abs(shift - shift.mean()).max() < 1e-6 if classes > 2 else np.abs(shift).max() < 1e-6
    predicted = L.predict_folds(df, ["a", "b", "c"], models, "fold").collect()
    for r in predicted[:50]:
        p = models[r.fold].probabilities(np.array([[r.a, r.b, r.c]]))[0]
        assert r.probability == pytest.approx(p.tolist()) and r.prediction == float(models[r.fold].classes[int(p.argmax())])


def test_separable_and_constant_features_settle(spark):
    df = spark.createDataFrame([(float(i), 3.0, int(i > 9), None if i == 4 else 1.0) for i in range(20)], "x double, k double, y int, g double")
    model = L.fit_folds(df, ["x", "k", "g"], "y")[None]
    assert np.isfinite(model.beta).all() and model.scale[1] == 1.0
    assert {r.prediction == r.y for r in L.predict_folds(df, ["x", "k", "g"], {None: model}).where("g IS NOT NULL").collect()} == {True}
    with pytest.raises(ValueError, match="two classes"):
        L.fit_folds(df.where("y = 1"), ["x"], "y")
