"""Catalogue: training rows, splits, metrics and models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import metrics as K
from ..operators import ml
from ..operators import selection as S
from ..operators import timeline as T
from ..session import new_folder
from .inputs import GOLD_S, SERIES, balance, balance_by_series
from .registry import query, rounded

# ---- splits ----


@query(
    f"""WITH {GOLD_S}, o AS (SELECT timestamp_utc, row_number() OVER (ORDER BY timestamp_utc) AS i, count(*) OVER () AS n FROM gold_s),
    cut AS (SELECT min(timestamp_utc) AS cutoff FROM o WHERE i > floor(n * (1 - 0.2::DOUBLE)))
    SELECT g.series, g.timestamp_utc, g.timestamp_utc >= cut.cutoff AS is_test FROM gold_s g CROSS JOIN cut"""
)
def temporal_split(t):
    return X.temporal_split(balance_by_series(t), test_ratio=0.2).select("series", "timestamp_utc", "is_test")


_SHUFFLED = """sh AS (SELECT {id} AS id, {label} AS label, row_number() OVER (PARTITION BY {label} ORDER BY md5('42:' || CAST({id} AS VARCHAR)), {id}) AS r,
  count(*) OVER (PARTITION BY {label}) AS n FROM {table})"""


@query(f"WITH {_SHUFFLED.format(id='doc_id', label='quality', table='labels')} SELECT id AS doc_id, label AS quality, CAST((r - 1) % 5 AS INTEGER) AS fold FROM sh")
def stratified_folds(t):
    return X.stratified_folds(t.labels.select("doc_id", "quality"), "quality", "doc_id")


@query(f"WITH {_SHUFFLED.format(id='event_id', label='event_type', table='events')} SELECT id AS event_id, label AS event_type, r <= round(n * 0.2::DOUBLE) AS is_test FROM sh")
def stratified_holdout(t):
    return X.stratified_holdout(t.events.select("event_id", "event_type"), "event_type", "event_id")


# ---- metrics on fixed scores ----


def _scored(t):
    s = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    score = (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("score")
    return s.select("doc_id", F.col("quality").alias("label"), score).withColumn(
        "prediction", (F.col("score") >= 0.5).cast("int")
    )


_SCORED = """sc AS (SELECT doc_id, quality AS label, n_chars / (n_chars + 2000.0::DOUBLE) AS score,
  CAST(n_chars / (n_chars + 2000.0::DOUBLE) >= 0.5 AS INTEGER) AS prediction FROM labels JOIN documents USING (doc_id))"""
_CONFUSION = """cf AS (SELECT {by}CAST(count(*) FILTER (label = 1 AND prediction = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (label = 0 AND prediction = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (label = 1 AND prediction = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (label = 0 AND prediction = 0) AS DOUBLE) AS tn FROM {table} GROUP BY ALL),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(tn / nullif(tn + fp, 0), 0) AS spec FROM cf),
bm AS (SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, (r + spec) / 2 AS balanced_accuracy, p AS "precision", r AS recall, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM pr)"""
_BM = ["accuracy", "balanced_accuracy", '"precision"', "recall", "f1"]
_BM_OUT = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _BM)


@query(f"WITH {_SCORED}, {_CONFUSION.format(by='', table='sc')} SELECT {_BM_OUT} FROM bm")
def binary_metrics(t):
    return rounded(K.binary_metrics(_scored(t)))


@query(
    f"""WITH {_SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM sc GROUP BY score),
    w AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g)
    SELECT round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) + 0.0 AS roc_auc,
      round(sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / sum(pos), 6) + 0.0 AS average_precision FROM w"""
)
def ranking_metrics(t):
    return rounded(K.ranking_metrics(_scored(t)))


def _classes(t):
    return t.embeddings.select("vec_id", "label", (F.col("vec_id") % 10).cast("int").alias("prediction"))


_CLASSES = """cl AS (SELECT vec_id, label, CAST(vec_id % 10 AS INTEGER) AS prediction FROM embeddings),
ks AS (SELECT label AS k FROM cl UNION SELECT prediction FROM cl),
rp AS (SELECT CAST(k AS DOUBLE) AS class, count(*) FILTER (label = k) AS support, count(*) FILTER (prediction = k) AS predicted,
  count(*) FILTER (label = k AND prediction = k) AS hits FROM ks CROSS JOIN cl GROUP BY 1),
rr AS (SELECT class, support, coalesce(CAST(hits AS DOUBLE) / nullif(predicted, 0), 0) AS p, coalesce(CAST(hits AS DOUBLE) / nullif(support, 0), 0) AS r FROM rp),
rf AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM rr)"""


@query(f"WITH {_CLASSES} SELECT label, prediction, count(*) AS n FROM cl GROUP BY ALL")
def confusion_matrix(t):
    return K.confusion_matrix(_classes(t))


@query(f'WITH {_CLASSES} SELECT class, support, round(p, 6) + 0.0 AS "precision", round(r, 6) + 0.0 AS recall, round(f, 6) + 0.0 AS f1 FROM rf')
def class_report(t):
    return rounded(K.class_report(_classes(t)))


@query(
    f"""WITH {_CLASSES} SELECT round((SELECT avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END) FROM cl), 6) + 0.0 AS accuracy,
      round(avg(r) FILTER (support > 0), 6) + 0.0 AS balanced_accuracy, round(avg(p), 6) + 0.0 AS precision_macro, round(avg(r), 6) + 0.0 AS recall_macro,
      round(avg(f), 6) + 0.0 AS f1_macro, round(sum(p * support) / sum(support), 6) + 0.0 AS precision_weighted,
      round(sum(r * support) / sum(support), 6) + 0.0 AS recall_weighted, round(sum(f * support) / sum(support), 6) + 0.0 AS f1_weighted FROM rf"""
)
def multiclass_metrics(t):
    return rounded(K.multiclass_metrics(_classes(t)))


@query(
    f"""WITH {_SCORED}, {_SHUFFLED.format(id='doc_id', label='label', table='sc')}, fs AS (SELECT sc.*, CAST((r - 1) % 5 AS INTEGER) AS fold FROM sc JOIN sh ON sh.id = sc.doc_id),
    {_CONFUSION.format(by='fold, ', table='fs')}
    SELECT count(*) AS n_folds, {', '.join(f'round(avg({c}), 6) + 0.0 AS {c.strip(chr(34))}_mean' for c in _BM)},
      {', '.join(f'round(stddev_pop({c}), 6) + 0.0 AS {c.strip(chr(34))}_std' for c in _BM)} FROM bm"""
)
def fold_metric_summary(t):
    folded = X.stratified_folds(_scored(t), "label", "doc_id")
    names = ["accuracy", "balanced_accuracy", "precision", "recall", "f1"]
    return rounded(K.fold_summary(K.binary_metrics(folded, by=["fold"]), names))


@query(
    """SELECT CAST(l_linenumber AS INTEGER) AS max_depth, CAST(2 AS INTEGER) AS min_samples_split, round(avg(l_discount), 2) + 0.0 AS f1_macro, round(avg(l_tax), 6) + 0.0 AS accuracy
    FROM lineitem GROUP BY 1 ORDER BY f1_macro DESC, accuracy DESC, max_depth LIMIT 1"""
)
def best_configuration(t):
    results = t.lineitem.groupBy(F.col("l_linenumber").cast("int").alias("max_depth")).agg(
        F.avg("l_discount").alias("f1_macro"), F.avg("l_tax").alias("accuracy")
    )
    ready = rounded(rounded(results, ["f1_macro"], 2), ["accuracy"]).withColumn("min_samples_split", F.lit(2))
    return K.best_configuration(ready)


@query(
    """SELECT event_id, round((value - avg(value) OVER ()) / stddev_samp(value) OVER (), 6) + 0.0 AS value_z,
      round((user_id - avg(user_id) OVER ()) / stddev_samp(user_id) OVER (), 6) + 0.0 AS user_z FROM events"""
)
def standardised_features(t):
    rows = t.events.select("event_id", "value", F.col("user_id").cast("double").alias("user"))
    model = Pipeline(stages=ml.preparation(["value", "user"])).fit(rows)
    z = vector_to_array(F.col("features"))
    return rounded(model.transform(rows).select("event_id", z[0].alias("value_z"), z[1].alias("user_z")))


def _gappy(t):
    """Readings with gaps, an odd and an even number of values, and a column of many ties."""
    return t.events.select(
        "event_id",
        F.expr("CASE WHEN event_id % 7 <> 0 THEN value END").alias("reading"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN cast(user_id AS double) END").alias("user"),
        F.expr("CASE WHEN event_id % 11 <> 5 THEN cast(user_id % 4 AS double) END").alias("tied"),
    )


_GAPPY = """gp AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS reading, CASE WHEN event_id % 3 = 0 THEN user_id::DOUBLE END AS "user",
  CASE WHEN event_id % 11 <> 5 THEN (user_id % 4)::DOUBLE END AS tied FROM events),
md AS (SELECT median(reading) AS reading, median("user") AS "user", median(tied) AS tied FROM gp)"""


@query(f"""WITH {_GAPPY}, fl AS (SELECT event_id, coalesce(gp.reading, md.reading) AS reading, coalesce(gp."user", md."user") AS "user", coalesce(gp.tied, md.tied) AS tied FROM gp CROSS JOIN md)
SELECT event_id, {', '.join(f'round(("{c}" - avg("{c}") OVER ()) / stddev_pop("{c}") OVER (), 6) + 0.0 AS {c}_z' for c in ('reading', 'user', 'tied'))} FROM fl""")
def median_imputed_features(t):
    scaled = S.impute_and_scale(_gappy(t), ["reading", "user", "tied"])
    return rounded(scaled.select("event_id", "reading_z", "user_z", "tied_z"))


@query(f"WITH {_GAPPY} SELECT 'reading' AS name, reading AS median FROM md UNION ALL SELECT 'user', \"user\" FROM md UNION ALL SELECT 'tied', tied FROM md")
def exact_column_medians(t):
    medians = S.exact_medians(_gappy(t), ["reading", "user", "tied"])
    return t.spark.createDataFrame(list(medians.items()), "name string, median double")


TREE_FEATURES = ["length", "words", "lines", "toxic"]


def _coarse_documents(t):
    words = F.size(F.split("text", " "))
    lines = F.size(F.split("text", "\n"))
    docs = t.documents.select("doc_id", *[F.least(F.floor(x / n), F.lit(30)).cast("double").alias(c) for c, x, n in
                              (("length", F.col("n_chars"), 400), ("words", words, 50), ("lines", lines, 3))])
    return t.labels.join(docs, "doc_id").select("doc_id", "quality", F.col("toxic").cast("double").alias("toxic"), "length", "words", "lines")


def _split_tables_sql() -> str:
    """All configurations level by level: counts below each threshold, the best fall in impurity, rows sent on."""
    grid = ", ".join(f"({i}, '{g['criterion']}', {g['max_depth']}, {g['min_samples_split']})" for i, g in enumerate(ml.TREE_GRID))
    entropy = lambda n, a, b: " - ".join(f"(CASE WHEN {x} > 0 THEN {x} * log2({x}::DOUBLE / {n}) ELSE 0 END)" for x in (a, b))
    gini = lambda n, a, b: f"{n} * (1 - ((({a})::DOUBLE / ({n})) ** 2 + (({b})::DOUBLE / ({n})) ** 2))"
    impurity = lambda n, a, b: f"(CASE WHEN criterion = 'gini' THEN {gini(n, a, b)} ELSE - {entropy(n, a, b)} END)"
    ctes = [
        f"grid AS (SELECT * FROM (VALUES {grid}) g(config, criterion, max_depth, min_samples_split))",
        """rows_ AS (SELECT l.doc_id, quality, toxic::DOUBLE AS toxic, least(floor(n_chars / 400), 30)::DOUBLE AS length, least(floor(len(string_split(text, ' ')) / 50), 30)::DOUBLE AS words,
          least(floor(len(string_split(text, chr(10))) / 3), 30)::DOUBLE AS lines FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE text IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL)""",
        "long_ AS (" + " UNION ALL ".join(f"SELECT doc_id, quality, {i} AS f, '{c}' AS feature, {c} AS x FROM rows_" for i, c in enumerate(TREE_FEATURES)) + ")",
        "cut_ AS (SELECT f, v, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS cut FROM (SELECT DISTINCT f, x AS v FROM long_))",
        "a0 AS (SELECT config, doc_id, quality, 1::BIGINT AS node FROM grid CROSS JOIN rows_)",
    ]
    depth = max(g["max_depth"] for g in ml.TREE_GRID)
    for d in range(depth):
        ctes += [
            f"n{d} AS (SELECT config, node, count(*) AS n, sum(quality)::BIGINT AS ones FROM a{d} GROUP BY ALL)",
            f"o{d} AS (SELECT n{d}.*, criterion FROM n{d} JOIN grid USING (config) WHERE {d} < max_depth AND n >= min_samples_split AND ones > 0 AND ones < n)",
            f"v{d} AS (SELECT config, node, f, feature, x, count(*) AS c, sum(l.quality)::BIGINT AS k FROM a{d} JOIN o{d} USING (config, node) JOIN long_ l USING (doc_id) GROUP BY ALL)",
            f"""l{d} AS (SELECT config, node, f, feature, cut, n, ones, criterion, coalesce(sum(c) FILTER (x <= cut), 0)::BIGINT AS ln, coalesce(sum(k) FILTER (x <= cut), 0)::BIGINT AS lo
              FROM v{d} JOIN cut_ USING (f) JOIN o{d} USING (config, node) WHERE cut IS NOT NULL GROUP BY ALL)""",
            f"""s{d} AS (SELECT * FROM (SELECT *, round(({impurity('n', 'ones', '(n - ones)')} - {impurity('ln', 'lo', '(ln - lo)')} - {impurity('(n - ln)', '(ones - lo)', '(n - ln - ones + lo)')}) / n, 9) AS fall
              FROM l{d} WHERE ln > 0 AND ln < n) QUALIFY row_number() OVER (PARTITION BY config, node ORDER BY fall DESC, f, cut) = 1)""",
            f"a{d + 1} AS (SELECT a.config, a.doc_id, a.quality, 2 * a.node + (l.x > s.cut)::BIGINT AS node FROM a{d} a JOIN s{d} s USING (config, node) JOIN long_ l ON l.doc_id = a.doc_id AND l.f = s.f)",
        ]
    union = " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(depth))
    return f"WITH {', '.join(c.replace(' AS (', ' AS MATERIALIZED (', 1) for c in ctes)} SELECT g.criterion, max_depth, min_samples_split, node, feature, cut AS threshold, n AS rows FROM ({union}) s JOIN grid g USING (config)"


@query(_split_tables_sql())
def tree_split_tables(t):
    """The splits of all eight configurations over coarse document measures."""
    return ml.split_tables(_coarse_documents(t), TREE_FEATURES, "quality")


# ---- models whose fits SQL can't follow; tests hold them against plain fits of the same data ----


def _without_gaps(t):
    """The balance with hours that lack a source backfilled as absent ones, so that a lag of 24 rows is one of 24 hours."""
    known = balance(t).where(~F.col("flag_missing_source") & F.col("ratio_producao_consumo").isNotNull())
    return known.unionByName(T.backfill_missing_hours(known))


@query()
def deficit_forest_metrics(t):
    return ml.train_deficit_model(_without_gaps(t))[1]


@query()
def next_hour_prediction(t):
    """Train, persist, reload and score the newest hour."""
    gold = _without_gaps(t)
    model, measured = ml.train_deficit_model(gold)
    path = new_folder(t.spark, "model")
    ml.save_model(model, measured, path)
    return ml.predict_next_hour(ml.load_model(t.spark, path)[0], gold)


def _series_filled(t):
    gold = balance_by_series(t)
    return gold.unionByName(T.backfill_missing_hours(gold, SERIES, "week"))


@query()
def deficit_forest_metrics_by_series(t):
    """Training rows of ten backfilled series together; lags by hour."""
    return ml.train_deficit_model(_series_filled(t), time_aware=True, series=SERIES)[1]


@query()
def next_hour_prediction_by_series(t):
    """One forest for all series, and the next hour of each; series that lack features are reported without a class."""
    gold = _series_filled(t)
    model, _ = ml.train_deficit_model(gold, time_aware=True, series=SERIES)
    return ml.predict_next_hour(model, gold, SERIES)


def _document_features(t):
    words = F.size(F.split("text", r"\s+")).cast("double").alias("words")
    lines = F.size(F.split("text", "\n")).cast("double").alias("lines")
    docs = t.documents.select("doc_id", F.col("n_chars").cast("double").alias("chars"), words, lines)
    return t.labels.join(docs, "doc_id").select("doc_id", "quality", F.col("toxic").cast("double").alias("toxic"), "chars", "words", "lines")


@query()
def cross_validated_logistic(t):
    return ml.cross_validate(_document_features(t), ["toxic", "chars", "words", "lines"], "quality", "doc_id")


@query()
def cross_validation_summary(t):
    per_fold = ml.cross_validate(_document_features(t), ["toxic", "chars", "words", "lines"], "quality", "doc_id")
    return K.fold_summary(per_fold, ml.BINARY_METRICS)


def _vector_columns(t):
    width = t.embeddings.select(F.size("embedding")).first()[0]
    names = [f"x{i}" for i in range(width)]
    return t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@query()
def tree_grid_search(t):
    table, names = _vector_columns(t)
    return ml.grid_search_trees(table, names, "label", "vec_id")


@query()
def best_tree_refit(t):
    """The best configuration, fitted on every row and scored on them."""
    table, names = _vector_columns(t)
    model, best = ml.refit_best_tree(table, names, "label", ml.grid_search_trees(table, names, "label", "vec_id"))
    measured = K.multiclass_metrics(model.score(table).where("prediction IS NOT NULL"), "label", "prediction")
    return measured.withColumns({k: F.lit(best[k]) for k in ("criterion", "max_depth", "min_samples_split")})
