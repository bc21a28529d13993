from datetime import datetime, timedelta

from functools import reduce

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voltlake.operators import gold as G
from voltlake.operators import quality as Q
from voltlake.operators import serving as S
from voltlake.operators import timeline as T
from voltlake.operators import ml
from voltlake.operators.features import deficit_features, latest_features

H0 = datetime(2024, 1, 1)


def hour(n):
    return H0 + timedelta(hours=n)


def gold_rows(spark, cons, prod):
    """Gold table from {hour: value} maps."""
    c = spark.createDataFrame([(hour(h), v) for h, v in cons.items()], "timestamp_utc timestamp_ntz, consumo_total_kwh double")
    p = spark.createDataFrame(
        [(hour(h), v, v, 0.0) for h, v in prod.items()],
        "timestamp_utc timestamp_ntz, producao_total_kwh double, producao_dgm_kwh double, producao_pre_kwh double")
    return G.gold_balance_hourly(c, p)


def test_balance_flags(spark):
    gold = gold_rows(spark, {0: 5.0, 2: 5.0, 3: 5.0, 4: 5.0, 5: 0.0}, {1: 1.0, 2: 4.0, 3: 5.0, 4: 6.0, 5: 2.0})
    rows = {r["timestamp_utc"].hour: r for r in gold.collect()}
    assert [rows[h]["flag_missing_source"] for h in range(6)] == [True, True, False, False, False, False]
    assert [rows[h]["flag_defice"] for h in range(6)] == [False, False, True, False, False, False]
    assert [rows[h]["flag_excedente"] for h in range(6)] == [False, False, False, False, True, True]
    assert rows[5]["ratio_producao_consumo"] is None and rows[4]["ratio_producao_consumo"] == 1.2
    assert rows[0]["saldo_kwh"] is None


def test_balance_is_one_shuffle(spark):
    plan = gold_rows(spark, {0: 1.0}, {0: 1.0})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_backfill(spark):
    gold = gold_rows(spark, {0: 10.0, 2: 20.0, 3: 8.0, 7: None}, {0: 1.0, 2: 3.0, 3: None, 7: 9.0})
    out = {r["timestamp_utc"].hour: r for r in T.backfill_missing_hours(gold, bucket="hour").collect()}
    assert sorted(out) == [1, 4, 5, 6]
    assert out[1]["consumo_total_kwh"] == 15.0 and out[1]["producao_total_kwh"] == 2.0
    # No later consumption is known, and the null production of hour 3 is skipped, not filled.
    assert all(out[h]["consumo_total_kwh"] == 8.0 and out[h]["producao_total_kwh"] == 6.0 for h in (4, 5, 6))
    assert all(r["flag_missing_source"] for r in out.values())


def test_backfill_twice_is_a_no_op_and_keeps_rows(spark):
    gold = gold_rows(spark, {h: float(h % 5) for h in range(0, 2000, 3)}, {h: float(h % 7) for h in range(1, 2000, 4)})
    whole = gold.unionByName(T.backfill_missing_hours(gold))
    assert T.backfill_missing_hours(whole).count() == 0
    assert T.missing_hours(whole).count() == 0
    assert whole.where(~F.col("flag_missing_source")).count() == gold.where(~F.col("flag_missing_source")).count()
    assert whole.count() == whole.select("timestamp_utc").distinct().count()


@pytest.fixture(scope="module")
def sparse(spark):
    """Two series over five months, with gaps, nulls and empty months."""
    return spark.range(0, 3600, 1).where("id % 7 <> 3 AND NOT id BETWEEN 700 AND 2300").select(
        (F.col("id") % 2).alias("s"),
        (F.lit(H0).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("timestamp_utc"),
        F.expr("CASE WHEN id % 5 = 0 THEN NULL ELSE id * 13 % 101 END").cast("double").alias("v"),
    ).persist()


def _same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


@pytest.mark.parametrize("series", [[], ["s"]])
@pytest.mark.parametrize("bucket", ["month", "week", "day", "hour"])
def test_bucketed_windows_equal_global_ones(sparse, series, bucket):
    order = W.partitionBy(*series).orderBy("timestamp_utc")
    expected = sparse.select(
        "s", "timestamp_utc",
        F.lag("v", 1).over(order).alias("v_lag_1"), F.lag("v", 24).over(order).alias("v_lag_24"), F.lead("v", 1).over(order).alias("nxt"),
        F.last("v", True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("prev_v"),
        F.first("v", True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("next_v"))
    lags = T.add_lags(sparse, ["v"], [1, 24], series, bucket=bucket)
    _same(lags.select("s", "timestamp_utc", "v_lag_1", "v_lag_24"), expected)
    _same(T.add_lead(sparse, "v", "nxt", series=series, bucket=bucket).select("s", "timestamp_utc", "nxt"), expected)
    known = T.neighbour_known_values(sparse, ["v"], series, bucket=bucket)
    _same(known.select("s", "timestamp_utc", "prev_v", "next_v"), expected)


def test_rolling_mean_starts_after_a_full_day(spark):
    gold = gold_rows(spark, {h: float(h) for h in range(30)}, {0: 1.0})
    rows = {r["timestamp_utc"]: r["m"] for r in T.add_rolling_means(gold, {"m": "consumo_total_kwh"}).collect()}
    assert rows[hour(22)] is None and rows[hour(23)] == sum(range(24)) / 24 and rows[hour(29)] == sum(range(6, 30)) / 24


def test_projection(spark):
    gold = gold_rows(spark, {0: 40.0, 1: 0.0}, {0: 70.0, 1: 0.0})
    assert T.project_forward(gold, hour(1)).count() == 0
    out = T.project_forward(gold, hour(30)).collect()
    assert len(out) == 29 and min(r["timestamp_utc"] for r in out) == hour(2)
    assert all(r["flag_excedente"] and not r["flag_defice"] and r["producao_total_kwh"] >= r["consumo_total_kwh"] * 1.03 for r in out)
    assert all(r["consumo_total_kwh"] == 100.0 for r in out)  # the newest positive value, 40, is below the floor
    assert T.project_forward(gold.limit(0), hour(30)).count() == 0


def test_projection_defaults(spark):
    gold = gold_rows(spark, {0: 0.0}, {0: 0.0})
    first = T.project_forward(gold, hour(24), noise=False).where(F.hour("timestamp_utc") == 0).first()
    assert 50000 < first["consumo_total_kwh"] < 51000


def _price(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "date string, hour string, portugal string, row_pos long")


def test_last_price_row_wins_and_v1_is_kept_on_a_tie(spark):
    cons = spark.createDataFrame([(hour(h), 2.0) for h in range(1, 3)], "timestamp_utc timestamp_ntz, consumo_mwh double")
    raw = _price(spark, [("2024-01-01", "2", "10"), ("2024-01-01", "2", "11,5"), ("2024-01-01", "3", "x")])
    rows = G.gold_cost_hourly(cons, raw).collect()
    assert [(r["timestamp_utc"], r["preco_eur_mwh"], r["custo_estimado_eur"], r["price_parser_version"]) for r in rows] == [
        (hour(1), 11.5, 23.0, "v1_hour_minus_1")]


def test_v2_is_taken_when_it_overlaps_more(spark):
    cons = spark.createDataFrame([(hour(h), 1.0) for h in (1, 2)], "timestamp_utc timestamp_ntz, consumo_mwh double")
    raw = _price(spark, [("2024-01-01", "1", "10"), ("2024-01-01", "2", "20")])
    rows = G.gold_cost_hourly(cons, raw).collect()
    assert {r["price_parser_version"] for r in rows} == {"v2_hour_direct"} and len(rows) == 2


def test_rollup_sums_equal_hourly_sums(spark):
    gold = gold_rows(spark, {h: float(h) for h in range(100)}, {h: 50.0 for h in range(5, 120)})
    total = gold.agg(F.sum("consumo_total_kwh"), F.sum("saldo_kwh")).first()
    daily = S.balance_rollup(gold, "day").agg(F.sum("consumo_total_kwh"), F.sum("saldo_kwh"), F.sum("leituras")).first()
    assert tuple(daily)[:2] == tuple(total) and daily[2] == 120


def test_empty_cost_overview_is_zero(spark):
    empty = spark.createDataFrame([], "timestamp_utc timestamp_ntz, consumo_mwh double, preco_eur_mwh double")
    row = S.cost_overview(empty).first()
    assert (row["registos"], row["consumo_total_mwh"], row["preco_medio_ponderado_eur_mwh"], row["inicio"]) == (0, 0.0, 0.0, None)


def test_latest_features_equal_training_features(spark):
    gold = gold_rows(spark, {h: float(h % 9 + 1) for h in range(60)}, {h: float(h % 11) for h in range(60)})
    newest = latest_features(gold).first()
    assert newest["timestamp_utc"] == hour(59) and newest["consumo_total_kwh_lag_24"] == float(35 % 9 + 1)
    trained = deficit_features(gold)
    assert trained.count() == 60 - 24 - 1
    assert trained.where(F.col("timestamp_utc") == hour(58)).first()["consumo_total_kwh_lag_1"] == float(57 % 9 + 1)
    with pytest.raises(ValueError, match="25 hours"):
        latest_features(gold.limit(10))


def test_latest_features_by_series(spark):
    hours = {"a": range(60), "b": range(7, 40), "c": range(12), "d": range(40)}
    parts = [gold_rows(spark, {h: float(h % 9 + 1) for h in of}, {h: float(h % 11) for h in of}).withColumn("s", F.lit(s)) for s, of in hours.items()]
    gold = reduce(lambda a, b: a.unionByName(b), parts)
    gold = gold.withColumn("saldo_kwh", F.when((F.col("s") != "d") | (F.col("timestamp_utc") != F.lit(hour(38))), F.col("saldo_kwh")))
    latest = latest_features(gold, series=["s"])
    rows = {r["s"]: r.asDict() for r in latest.collect()}
    assert {s: (r["rows_seen"], r["ready"]) for s, r in rows.items()} == {"a": (25, True), "b": (25, True), "c": (12, False), "d": (25, False)}
    for s in ("a", "b"):
        alone = latest_features(gold.where(F.col("s") == s).drop("s")).first().asDict()
        assert {k: rows[s][k] for k in alone} == alone
    assert rows["d"]["saldo_kwh_lag_1"] is None and rows["c"]["timestamp_utc"] == hour(11)
    assert "WindowGroupLimit" in latest._jdf.queryExecution().executedPlan().toString()
    assert latest_features(gold.limit(0), series=["s"]).count() == 0
    model = ml.train_deficit_model(gold.where("s = 'a'"), series=["s"], trees=5)[0]
    predicted = {r["s"]: r for r in ml.predict_next_hour(model, gold, ["s"]).collect()}
    assert {s for s, r in predicted.items() if r["prob_defice_t_plus_1"] is None} == {"c", "d"}
    alone = ml.predict_next_hour(model, gold.where("s = 'a'").drop("s")).first()
    assert predicted["a"]["prob_defice_t_plus_1"] == alone["prob_defice_t_plus_1"]


def test_each_check_can_fail(spark):
    gold = gold_rows(spark, {0: -1.0, 1: 3.0}, {0: 600.0, 1: 1.0})
    both = gold.unionByName(gold).withColumn("flag_excedente", F.lit(True)).withColumn("versao", F.lit(None).cast("string"))
    report = Q.run_checks(
        both,
        [*Q.non_negative(["consumo_total_kwh"]), Q.exclusive_flags(), Q.freshness(hour(10), 2), *Q.null_share(["versao"]),
         Q.plausible_range("saldo_kwh"), Q.version_present("versao")])
    assert [r["passed"] for r in report.collect()] == [False] * 6
    assert not Q.unique_key(both, ["timestamp_utc"]).first()["passed"]
    sparse = gold_rows(spark, {0: 1.0, 5: 1.0}, {0: 1.0})
    assert Q.completeness(sparse).first()["observed"] == 2 / 6
    assert not Q.join_rate(sparse, sparse.limit(1), ["timestamp_utc"]).first()["passed"]
    assert not Q.training_ready(sparse, ["consumo_total_kwh"]).where("check = 'gaps'").first()["passed"]
    hours = spark.createDataFrame([(26, 3)], "market_hour int, source_rows int")
    assert [r["passed"] for r in Q.run_checks(hours, [Q.hour_domain(), Q.source_rows_per_hour()]).collect()] == [False, False]
    days = spark.sql("SELECT explode(array(DATE'2024-01-01', DATE'2024-01-05')) AS d")
    assert not Q.day_completeness(days, "d").first()["passed"]
    with pytest.raises(ValueError, match="exclusive_flags"):
        Q.expect(report)
