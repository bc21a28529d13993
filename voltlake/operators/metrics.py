"""Classification metrics as aggregates over prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import fan_out

# Score ranges used to cut the running counts, at least; any number gives the same result.
SCORE_RANGES = 256


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall and F1 of class 1; 0 where undefined."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(y & p).cast("double").alias("tp"),
        F.count_if(~y & p).cast("double").alias("fp"),
        F.count_if(y & ~p).cast("double").alias("fn"),
        F.count_if(~y & ~p).cast("double").alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return counts.select(
        *by,
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ((recall + _ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per observed (label, prediction) pair."""
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class that occurs as label or prediction.

    Each row adds to its label's support, its prediction's total and, if equal, the hits; the pairs are
    counted first, so the unfolding below works on class pairs only.
    """
    pairs = df.groupBy(*by, F.col(label).alias("_y"), F.col(prediction).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sides = pairs.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("_y").cast("double").alias("class"), F.col("_n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                         F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(F.lit(0)).cast("long").alias("hits")),
                F.struct(F.col("_p").cast("double").alias("class"), F.lit(0).cast("long").alias("support"), F.col("_n").alias("predicted"),
                         F.lit(0).cast("long").alias("hits")),
            )
        ).alias("_s"),
    ).select(*by, "_s.*")
    totals = sides.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("_predicted"), F.sum("hits").alias("_hits")
    )
    precision = _ratio(F.col("_hits").cast("double"), F.col("_predicted"))
    recall = _ratio(F.col("_hits").cast("double"), F.col("support"))
    return totals.select(
        *by,
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
        "support",
    )


def multiclass_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy, macro and support-weighted precision, recall and F1."""
    report = class_report(df, label, prediction, by)
    support = F.col("support").cast("double")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * support), F.sum(support))

    return report.groupBy(*by).agg(
        # Weighting recall by support counts the hits, so it equals the accuracy.
        weighted("recall").alias("accuracy"),
        F.avg(F.when(support > 0, F.col("recall"))).alias("balanced_accuracy"),
        *[F.avg(c).alias(f"{c}_macro") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")],
    )


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """`roc_auc` (ties count half) and `average_precision` (step sum) of a score; exact.

    Rows are first counted per distinct score. The running counts from the highest score down are cut at
    score quantiles fixed beforehand, so each window holds one score range of one group.
    """
    scored = df.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")
    )
    ranges = fan_out(df.sparkSession, SCORE_RANGES)
    probabilities = [i / ranges for i in range(1, ranges)]
    splits = sorted(set(df.select(F.col(score).cast("double").alias("_s")).approxQuantile("_s", probabilities, min(0.001, 0.25 / ranges))))
    bounds = F.array(*[F.lit(x) for x in splits]) if splits else F.array().cast("array<double>")
    ranged = scored.withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col("_s"))))
    above = W.partitionBy(*by).orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranged.groupBy(*by, "_range").agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    ranges = ranges.select(
        *by,
        "_range",
        F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_pos_before"),
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_neg_before"),
    )
    down = W.partitionBy(*by, "_range").orderBy(F.col("_s").desc()).rowsBetween(W.unboundedPreceding, 0)
    curve = ranged.join(ranges, [*by, "_range"]).select(
        *by,
        "_pos",
        "_neg",
        (F.col("_pos_before") + F.sum("_pos").over(down)).alias("_tp"),
        (F.col("_neg_before") + F.sum("_neg").over(down)).alias("_fp"),
    )
    ahead = F.col("_tp") - F.col("_pos")
    totals = curve.groupBy(*by).agg(
        F.sum("_pos").cast("double").alias("_P"),
        F.sum("_neg").cast("double").alias("_N"),
        F.sum(F.col("_neg") * (ahead + F.col("_pos") / 2.0)).alias("_area"),
        F.sum(F.col("_pos") * F.try_divide(F.col("_tp").cast("double"), F.col("_tp") + F.col("_fp"))).alias("_step"),
    )
    return totals.select(
        *by,
        F.try_divide(F.col("_area"), F.col("_P") * F.col("_N")).alias("roc_auc"),
        _ratio(F.col("_step"), F.col("_P")).alias("average_precision"),
    )


def fold_summary(per_fold: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each metric across folds."""
    return per_fold.agg(
        F.count(F.lit(1)).alias("n_folds"),
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in metrics],
    )


def best_configuration(results: DataFrame) -> DataFrame:
    """Highest F1, then accuracy, then the shallowest tree, then the smallest split."""
    return results.orderBy(
        F.col("f1_macro").desc(), F.col("accuracy").desc(), F.col("max_depth"), F.col("min_samples_split")
    ).limit(1)
