"""Model training and scoring on feature tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as K
from .features import TARGET, deficit_features, feature_names, latest_features, stratified_folds, stratified_holdout, temporal_split
from .logistic import fit_folds, predict_folds
from .trees import Forest, Settings, grow, load_forest, save_forest

# The forest of the deficit model.
FOREST = {"trees": 300, "max_depth": 8, "min_leaf": 3}

# The tree grid.
TREE_GRID = (
    {"criterion": "gini", "max_depth": 2, "min_samples_split": 2},
    {"criterion": "gini", "max_depth": 3, "min_samples_split": 2},
    {"criterion": "gini", "max_depth": 4, "min_samples_split": 2},
    {"criterion": "entropy", "max_depth": 2, "min_samples_split": 2},
    {"criterion": "entropy", "max_depth": 3, "min_samples_split": 2},
    {"criterion": "entropy", "max_depth": 4, "min_samples_split": 2},
    {"criterion": "log_loss", "max_depth": 3, "min_samples_split": 2},
    {"criterion": "log_loss", "max_depth": 4, "min_samples_split": 4},
)

BINARY_METRICS = (
    "accuracy",
    "balanced_accuracy",
    "precision",
    "recall",
    "f1",
    "roc_auc",
    "average_precision",
)


def preparation(features: Sequence[str], impute: bool = True) -> list:
    """Spark ML stages of imputation by an approximate median and standardisation by the sample deviation into `features`.

    `selection.impute_and_scale` does the same with exact medians and the population deviation.
    """
    filled = [f"{f}__filled" for f in features] if impute else list(features)
    stages = [VectorAssembler(inputCols=filled, outputCol="raw_features"),
              StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]
    if impute:
        stages.insert(0, Imputer(strategy="median", inputCols=list(features), outputCols=filled))
    return stages


def forest_settings(features: int, seed: int = 42, trees: int = FOREST["trees"], depth: int = FOREST["max_depth"], leaf: int = FOREST["min_leaf"]) -> list[Settings]:
    """The trees of the deficit forest; a node chooses among the root of the number of features."""
    one = Settings("gini", depth, 2, leaf, bootstrap=True, features=max(1, math.isqrt(features)), seed=seed)
    return [one] * trees


def tree_settings(config: Mapping[str, object]) -> Settings:
    """The tree of one grid entry."""
    return Settings(config["criterion"], config["max_depth"], config["min_samples_split"])


def score(forest: Forest, df: DataFrame) -> DataFrame:
    """Add `prediction` and `score`, the probability of class 1."""
    scored = forest.score(df)
    if 1 in forest.classes:
        return scored.withColumn("score", F.get("probability", F.lit(forest.classes.index(1)))).drop("probability")
    return scored.withColumn("score", F.lit(0.0)).drop("probability")


def evaluate_binary(predictions: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """All of `BINARY_METRICS`, one row per group of `by`."""
    counted = K.binary_metrics(predictions, label, "prediction", by)
    ranked = K.ranking_metrics(predictions, label, "score", by)
    joined = counted.join(ranked, list(by)) if by else counted.crossJoin(F.broadcast(ranked))
    return joined.select(*by, *BINARY_METRICS)


def train_deficit_model(
    gold: DataFrame, test_ratio: float = 0.2, seed: int = 42, time_aware: bool = False,
    series: Sequence[str] = (), **forest,
) -> tuple[Forest, DataFrame]:
    """Fit the deficit forest on the earlier rows; return the model and its metrics on the later ones.

    Trees split on order alone, so features need no scaling; rows with gaps are not in the table.
    """
    table = temporal_split(deficit_features(gold, time_aware=time_aware, series=series), test_ratio=test_ratio).persist()
    try:
        names = feature_names()
        sides = table.groupBy("is_test").count().collect()  # two rows
        if len(sides) < 2:
            raise ValueError("the split leaves one side without rows")
        id_ = "_row"
        keyed = table.withColumn(id_, F.concat_ws("|", *[F.col(c).cast("string") for c in [*series, "timestamp_utc"]]))
        model = grow(keyed.where(~F.col("is_test")), names, TARGET, forest_settings(len(names), seed, **forest), id_)
        values = evaluate_binary(score(model, table.where("is_test")), TARGET).first()
    finally:
        table.unpersist()
    schema = ", ".join(f"{m} double" for m in BINARY_METRICS)  # a metric is null where one class is absent
    return model, gold.sparkSession.createDataFrame([tuple(values[m] for m in BINARY_METRICS)], schema)


def predict_next_hour(model: Forest, gold: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Class and probability of a deficit in the hour after the newest one.

    With `series`, one row per series; a series that lacks rows or features has no class and no probability.
    """
    latest = latest_features(gold, series=series)
    predicted = {
        "timestamp_referencia_utc": F.col("timestamp_utc"),
        "pred_flag_defice_t_plus_1": F.col("prediction").cast("int"),
        "prob_defice_t_plus_1": F.col("score"),
    }
    if not series:
        return score(model, latest).select(*[e.alias(n) for n, e in predicted.items()])
    # Rows that are not ready pass the forest with zeros, so that series are read once; their result is dropped.
    ready = F.col("ready")
    scored = score(model, latest.fillna(0.0, feature_names()))
    kept = {n: e if n == "timestamp_referencia_utc" else F.when(ready, e) for n, e in predicted.items()}
    return scored.select(*series, *[e.alias(n) for n, e in kept.items()], "rows_seen", "ready")


def _settled(few_rows: DataFrame, cached: DataFrame) -> DataFrame:
    """A metrics table of a few rows, computed now so that the cached training table can be released."""
    try:
        return few_rows.sparkSession.createDataFrame(few_rows.collect(), few_rows.schema)
    finally:
        cached.unpersist()


def cross_validate(
    df: DataFrame, features: Sequence[str], label: str, row_id: str, k: int = 5, seed: int = 42,
    c: float = 1.0, max_iter: int = 1000,
) -> DataFrame:
    """Metrics per fold of a stratified k-fold logistic regression of a 0/1 label.

    All folds are fitted together, one pass a Newton step, and evaluated in one grouped aggregate.
    """
    folded = stratified_folds(df, label, row_id, k, seed).select(row_id, label, *features, "fold").persist()
    models = fit_folds(folded, features, label, "fold", c, max_iter)
    predicted = predict_folds(folded, features, models, "fold").where("prediction IS NOT NULL")
    predictions = predicted.select("fold", label, "prediction", F.get("probability", F.lit(1)).alias("score"))
    return _settled(evaluate_binary(predictions, label, ["fold"]), folded)


def grid_search_trees(
    df: DataFrame, features: Sequence[str], label: str, row_id: str, grid: Sequence[Mapping[str, object]] = TREE_GRID,
    test_size: float = 0.2, seed: int = 42,
) -> DataFrame:
    """Hold-out metrics of every tree configuration, one row each. All of them grow together."""
    split = stratified_holdout(df, label, row_id, test_size, seed).select(label, *features, "is_test").persist()
    forest = grow(split.where(~F.col("is_test")), features, label, [tree_settings(g) for g in grid])
    test = split.where("is_test")
    predictions = forest.predictions(split.where("is_test"), [label]).withColumnRenamed("tree", "config").persist()
    measured = K.multiclass_metrics(predictions, label, "prediction", ["config"])
    configs = df.sparkSession.createDataFrame(
        [(i, g["criterion"], g["max_depth"], g["min_samples_split"]) for i, g in enumerate(grid)],
        "config int, criterion string, max_depth int, min_samples_split int",
    )
    named = measured.join(F.broadcast(configs), "config").drop("config")  # one row per configuration
    try:
        return _settled(named, split)
    finally:
        predictions.unpersist()


def split_tables(df: DataFrame, features: Sequence[str], label: str, grid: Sequence[Mapping[str, object]] = TREE_GRID) -> DataFrame:
    """Every split of every configuration: criterion, max_depth, min_samples_split, node, feature, threshold, rows."""
    forest = grow(df, features, label, [tree_settings(g) for g in grid])
    rows = [(grid[t]["criterion"], grid[t]["max_depth"], grid[t]["min_samples_split"], node, *rest) for t, node, *rest, _ in forest.split_rows()]
    return df.sparkSession.createDataFrame(
        rows, "criterion string, max_depth int, min_samples_split int, node bigint, feature string, threshold double, rows bigint"
    )


def refit_best_tree(df: DataFrame, features: Sequence[str], label: str, results: DataFrame) -> tuple[Forest, dict]:
    """Fit the best configuration on every row."""
    best = K.best_configuration(results).first().asDict()
    return grow(df, features, label, [tree_settings(best)]), best


def save_model(model: Forest, metrics: DataFrame, path: str) -> None:
    """Persist a fitted forest, which names its features, with its metrics."""
    save_forest(metrics.sparkSession, model, f"{path}/model")
    metrics.write.mode("overwrite").json(f"{path}/metrics")


def load_model(spark, path: str) -> tuple[Forest, DataFrame]:
    """The forest and its metrics."""
    return load_forest(spark, f"{path}/model"), spark.read.json(f"{path}/metrics")
