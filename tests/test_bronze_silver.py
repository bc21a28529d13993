from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voltlake.operators import bronze as B
from voltlake.operators import ranking
from voltlake.operators.ranking import duplicate_counts, rank_duplicates
from voltlake.operators.silver import silver_15min
from voltlake.sources.readers import MissingColumnsError

AT = datetime(2024, 2, 1)


def raw_rows(spark, rows):
    """(datahora, date, total) rows in file order."""
    data = [(d, "1", "1", "2024", day, "00:00", "1", "1", "1", "1", total, i) for i, (d, day, total) in enumerate(rows)]
    return spark.createDataFrame(
        data,
        "datahora string, dia string, mes string, ano string, date string, time string, bt string, mt string, at string,"
        " mat string, total string, row_pos long",
    )


T0 = "2024-01-01T00:00:00+00:00"


@pytest.mark.parametrize("variant", ["A", "B"])
def test_duplicate_ranks(spark, variant):
    raw = raw_rows(spark, [(T0, "2024-01-01", x) for x in ("0", None, "5", "5", "9")])
    out = B.bronze_clean(raw, "consumption", "r", AT, variant)
    ranks = {(r["consumo_total_kwh"], r["duplicate_rank"]) for r in out.collect()}
    assert ranks == {(9.0, 1), (5.0, 2), (5.0, 3), (0.0, 4), (None, 5)}
    assert {r["duplicate_count"] for r in out.collect()} == {5}


def test_zero_flag_differs_by_variant(spark):
    raw = raw_rows(spark, [(T0, "2024-01-01", "0"), (T0, "2024-01-01", None), (T0, "2024-01-01", "3")])
    flags = {
        v: {r["consumo_total_kwh"]: r["flag_zero_row"] for r in B.bronze_clean(raw, "consumption", "r", AT, v).collect()} for v in "AB"
    }
    assert flags["A"] == {0.0: True, None: True, 3.0: False}
    assert flags["B"] == {0.0: True, None: False, 3.0: False}


def test_unreadable_key(spark):
    raw = raw_rows(spark, [("x", "2024-01-01", "1"), ("x", "2024-01-01", "2"), ("y", "2024-01-01", "3")])
    a = {r["consumo_total_kwh"]: (r["duplicate_count"], r["duplicate_rank"]) for r in B.bronze_clean(raw, "consumption", "r", AT, "A").collect()}
    assert a == {1.0: (2, 2), 2.0: (2, 1), 3.0: (1, 1)}
    b = B.bronze_clean(raw, "consumption", "r", AT, "B").collect()
    assert all(r["duplicate_count"] is None and r["duplicate_rank"] is None and r["flag_bad_timestamp"] for r in b)


def test_date_mismatch(spark):
    raw = raw_rows(spark, [("2024-01-01T00:30:00+01:00", "2024-01-01", "1"), (T0, "2024-01-01", "1"), ("bad", "2024-01-01", "1")])
    out = B.bronze_clean(raw, "consumption", "r", AT, "B")
    assert sorted((r["datahora_raw"], r["flag_date_mismatch"]) for r in out.collect()) == [
        ("2024-01-01T00:00:00+00:00", False), ("2024-01-01T00:30:00+01:00", True), ("bad", False)]


def test_missing_column_is_named(spark):
    with pytest.raises(MissingColumnsError, match="total"):
        B.bronze_clean(raw_rows(spark, []).drop("total"), "consumption", "r", AT)


def test_price_flags(spark):
    raw = spark.createDataFrame(
        [("2024-01-01", "1", "0", "1", 0), ("2024-01-01", "26", "x", "1", 1), ("lixo", "2", "5", "", 2)],
        "date string, hour string, portugal string, spain string, row_pos long",
    )
    rows = {r["date_raw"] + "/" + str(r["market_hour"]): r for r in B.bronze_clean(raw, "price", "r", AT).collect()}
    first, late, bad = rows["2024-01-01/1"], rows["2024-01-01/26"], rows["lixo/2"]
    assert first["flag_zero_preco_pt"] and not first["flag_bad_hour"] and first["timestamp_utc"] == datetime(2024, 1, 1)
    assert late["flag_bad_hour"] and late["flag_bad_preco_pt"]
    assert bad["flag_bad_date"] and bad["flag_bad_timestamp"] and bad["flag_bad_preco_es"]


def _skewed(spark):
    """One key with a third of the rows, null keys, zeros, nulls and many equal values."""
    return spark.range(6000).select(
        F.col("id").alias("pos"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 400) END").alias("key"),
        F.expr("CASE WHEN id % 5 = 0 THEN 0.0 WHEN id % 11 = 0 THEN NULL ELSE id * 31 % 17 END").cast("double").alias("v"),
    )


@pytest.mark.parametrize("null_group", [True, False])
def test_hot_keys_rank_like_small_ones(spark, null_group):
    df = _skewed(spark)
    plain = rank_duplicates(df, "key", "v", "pos", null_group, hot_rows=10**9)
    spread = rank_duplicates(df, "key", "v", "pos", null_group, hot_rows=100)
    columns = ["pos", "duplicate_count", "duplicate_rank", "flag_duplicate_timestamp"]
    assert sorted(map(tuple, plain.select(columns).collect())) == sorted(map(tuple, spread.select(columns).collect()))


def test_keys_that_share_a_bucket_are_counted_apart(spark, monkeypatch):
    """All keys in one bucket with more rows than the limit: one key has more than it in the first case, none in the second."""
    monkeypatch.setattr(ranking, "_COUNT_BUCKETS", 1)
    df = _skewed(spark)
    assert {r["key"]: r["_n"] for r in ranking._hot_keys(df, "key", F.lit(True), 500).collect()} == {"hot": 2000, None: 572}
    assert ranking._hot_keys(df, "key", F.lit(True), 5000).count() == 0
    assert ranking._hot_keys(df, "key", F.lit(True), 6000) is None
    ranked = rank_duplicates(df, "key", "v", "pos", hot_rows=5000)
    assert ranked.where("key = 'hot'").agg(F.max("duplicate_rank")).first()[0] == 2000


def test_duplicate_counts(spark):
    df = _skewed(spark)
    counts = {r["pos"]: r["duplicate_count"] for r in duplicate_counts(df, "key").collect()}
    assert len(counts) == 6000 and counts[0] == 2000 and counts[7] is None


def test_component_tolerance_and_one_row_per_key(spark):
    rows = [("2024-01-01T00:00:00Z", "2024-01-01", "4.001"), ("2024-01-01T00:15:00Z", "2024-01-01", "4.0011"),
            ("2024-01-01T00:00:00Z", "2024-01-01", "0"), ("2024-01-01T00:30:00Z", "2024-01-01", None)]
    bronze = B.bronze_clean(raw_rows(spark, rows), "consumption", "r", AT, "A")
    parts = ["consumo_bt_kwh", "consumo_mt_kwh", "consumo_at_kwh", "consumo_mat_kwh"]
    out = {r["timestamp_utc"].minute: r for r in silver_15min(bronze, "consumo_total_kwh", parts, "soma", tol=0.00100001).collect()}
    assert sorted(out) == [0, 15]
    assert out[0]["consumo_total_kwh"] == 4.001 and not out[0]["flag_component_sum_mismatch"]
    assert out[15]["flag_component_sum_mismatch"]


def test_silver_pick_limits_rows_before_the_shuffle(spark):
    bronze = B.bronze_clean(raw_rows(spark, [(T0, "2024-01-01", "1")]), "consumption", "r", AT, "A")
    plan = silver_15min(bronze, "consumo_total_kwh", ["consumo_bt_kwh"], "soma")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
