import csv
import io
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voltlake.operators import features as X
from voltlake.operators import metrics as K
from voltlake.operators import ml
from voltlake.operators import quality as Q
from voltlake.operators.bronze import bronze_clean
from voltlake.operators.quality import FailedChecks
from voltlake.plans import medallion
from voltlake.plans.catalogue import CATALOGUE
from voltlake.sources import readers as R
from voltlake.sources import writers as Wr

AT = datetime(2024, 2, 1, 12)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_header_is_normalised(spark, tmp_path):
    path = write(tmp_path / "a.csv", "﻿DataHora, TOTAL \n2024-01-01T00:00:00Z,1\n")
    df = R.read_csv(spark, path, positions=True)
    assert df.columns == ["datahora", "total", "source_file_name", "row_pos"]
    assert df.first()["source_file_name"] == "a.csv"


PRICE = "title\nunit;EUR\n\n{more}Spain;Date; HOUR ;Portugal;\n1;2024-01-01;1;10\n2;2024-01-01\n\n3;2024-01-01;2;\"1;5\"\n"


def test_price_header_is_found_in_each_file(spark, tmp_path):
    write(tmp_path / "p" / "a.csv", PRICE.format(more=""))
    write(tmp_path / "p" / "b.csv", PRICE.format(more="x\ny\n").replace("Spain;Date; HOUR ;Portugal;", "spain;hour;date;portugal").replace("2024-01-01;1;", "1;2024-01-01;"))
    rows = R.read_price_csv(spark, str(tmp_path / "p")).collect()
    assert sorted((r["source_file_name"], r["date"], r["hour"], r["portugal"]) for r in rows) == [
        ("a.csv", "2024-01-01", "1", "10"), ("a.csv", "2024-01-01", "2", "1;5"), ("b.csv", "2", "2024-01-01", "1;5"), ("b.csv", "2024-01-01", "1", "10")]


def test_price_lines_stay_where_they_are_read(spark, tmp_path):
    """Headers go to the lines, and hours are parsed in generated code before the one window's shuffle."""
    write(tmp_path / "p" / "a.csv", "Date;Hour;Portugal;Spain\n" + "".join(f"02/01/2024; {h} ;{h};{h}\n" for h in range(1, 25)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = R.read_price_csv(spark, str(tmp_path / "p"))
        bronze = bronze_clean(raw, "price", "r", AT, "B", "UTC")
        plan = bronze._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert plan.count("Generate ") == raw._jdf.queryExecution().executedPlan().toString().count("Generate ") == 1
        assert sorted(r["timestamp_utc"] for r in bronze.collect()) == [datetime(2024, 1, 2, h) for h in range(24)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_price_file_without_header_raises(spark, tmp_path):
    path = write(tmp_path / "p.csv", "a;b\n1;2\n")
    with pytest.raises(Exception, match="no header line"):
        R.read_price_csv(spark, path).collect()


def test_records_over_lines_and_blocks(spark, tmp_path):
    """Quoted line ends, quotes and ";" in files cut into many blocks, against a plain CSV reader."""
    rng, alphabet, want = random.Random(5), ["x", ";", '"', "\n", "\r\n", " y", '"";"', "long " * 9], []
    for name in ("a", "b"):
        lines = io.StringIO()
        out = csv.writer(lines, delimiter=";", lineterminator="\r\n" if name == "a" else "\n")
        out.writerow(["id", "note"] if name == "a" else ["note", "other", "id"])
        for i in range(3000):
            note = "z" + "".join(rng.choices(alphabet, k=rng.randint(0, 6))) + "z" if i % 3 else f"plain {i}"
            out.writerow([i, note] if name == "a" else [note, 'mid "quote"' if i % 2 else "", i])
            want.append((f"{name}.csv", str(i), note))
        # One record over several blocks, and cells whose quotes are text.
        lines.write('9001;"' + "line; \n" * 3000 + 'end"\n9002;5" pipe\n' if name == "a" else '"' + "\n" * 9000 + '";;9001\n5" pipe;;9002\n')
        want.append((f"{name}.csv", "9001", ("line; \n" * 3000 + "end") if name == "a" else "\n" * 9000))
        want.append((f"{name}.csv", "9002", '5" pipe'))
        (tmp_path / f"{name}.csv").write_bytes(lines.getvalue().encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4096", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = R.read_price_csv(spark, str(tmp_path), ("id", "note"), multi_line=True).collect()
            assert sorted((r["source_file_name"], r["id"], r["note"]) for r in rows) == sorted(want)
            order = [int(r["id"]) for r in sorted(rows, key=lambda r: r["row_pos"]) if r["source_file_name"] == "a.csv"]
            assert order == [*range(3000), 9001, 9002]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("size", ["90", "128m"])
@pytest.mark.parametrize("batch", ["3", "10000"])
def test_records_where_a_task_reads_many_blocks(spark, tmp_path, size, batch):
    """Many blocks a task, batches that end within blocks, and bytes that are no UTF-8."""
    rng, want = random.Random(7), []
    for name in ("a", "b", "c"):
        rows = [[f"{name}{i}", "z" + "".join(rng.choices(["x", ";", '"', "\n", '"\n"', ";\"", "y" * 90], k=rng.randint(0, 5))) + "z"] for i in range(150)]
        lines = io.StringIO()
        out = csv.writer(lines, delimiter=";", lineterminator="\n", quoting=csv.QUOTE_ALL if name == "a" else csv.QUOTE_MINIMAL)
        out.writerows([["id", "note"], *rows])
        end = b'"c\xff";"\n\xff\n"\n' if name == "c" else b""
        (tmp_path / f"{name}.csv").write_bytes(lines.getvalue().encode() + end)
        want += [(i, note.encode()) for i, note in rows]
    want.append((None, "\n\ufffd\n".encode()))  # as Spark shows it
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        with R.blocks_of(spark, size):
            read = R.read_price_csv(spark, str(tmp_path), ("id", "note"), multi_line=True)
            rows = read.select(F.when(F.col("id").rlike("^[abc][0-9]+$"), F.col("id")).alias("id"), F.col("note").cast("binary").alias("note")).collect()
    finally:
        spark.conf.set(key, old)
    strip = lambda rows: sorted((i or "", bytes(note).strip(b" ")) for i, note in rows)
    assert strip(map(tuple, rows)) == strip(want)


def test_records_are_cut_without_shuffling_lines(spark, tmp_path):
    """Only block rows and parts of records may be dealt out again, whatever the optimizer thinks of sizes."""
    path = write(tmp_path / "p.csv", "id;note\n" + "".join(f'{i};"a\nb"\n' for i in range(500)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with R.blocks_of(spark, "256"):
            rows = R.read_price_csv(spark, path, ("id", "note"), multi_line=True)
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
            assert rows.where(F.col("note") == "a\nb").count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_quote_that_stays_open_raises(spark, tmp_path):
    path = write(tmp_path / "p.csv", 'id;note\n1;"a\n2;b\n')
    with pytest.raises(Exception, match="a quote stays open"):
        R.read_price_csv(spark, path, ("id", "note"), multi_line=True).collect()


def test_source_order_over_many_blocks(spark, tmp_path):
    path = write(tmp_path / "big.csv", "id\n" + "\n".join(str(i) for i in range(20000)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        ordered = R.read_csv(spark, path, positions=True)
        assert ordered.rdd.getNumPartitions() > 4
        assert [int(r["id"]) for r in ordered.orderBy("row_pos").collect()] == list(range(20000))
        numbered = R.with_row_number(spark.read.option("header", True).csv(path))
        assert numbered.where(F.col("row_num") != F.col("id").cast("long") + 1).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_small_blocks_share_tasks(spark, tmp_path):
    """Blocks stay as small as asked for and rows in order, but many blocks make no more tasks than a few."""
    path = write(tmp_path / "big.csv", "id\n" + "\n".join(str(i) for i in range(200000)) + "\n")
    with R.blocks_of(spark, "8192"):
        ordered = R.read_csv(spark, path, positions=True).withColumn("block", F.col("_metadata.file_block_start"))
        assert ordered.select("block").distinct().count() > 100
        assert ordered.rdd.getNumPartitions() <= 65
        assert [int(r["id"]) for r in ordered.orderBy("row_pos").select("id").collect()] == list(range(200000))
    assert spark.conf.get("spark.sql.files.maxPartitionNum", None) is None


def test_order_over_files_has_no_task_per_block(spark, tmp_path):
    """250,000 rows are some 150 blocks of 64k in seven files."""
    rows = spark.range(250000).select(F.expr("id div 5 AS l_orderkey"), F.expr("CAST(1 + (id * 31) % 7 AS int) AS l_linenumber"))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sparkContext.setJobGroup("order", "order_over_files")
    try:
        assert CATALOGUE["order_over_files"].run(spark, str(tmp_path)).where("differing <> 0").count() == 0
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("order") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 7 <= max(s.numTasks for s in stages if s) <= 65


def test_numeric_table_rejects_nulls(spark):
    with pytest.raises(ValueError, match="a_b"):
        R.numeric_table(spark.createDataFrame([("1", "x")], "`Ok` string, `A B` string"))
    assert R.label_column(spark.createDataFrame([(1, 2, 3)], "a int, class int, b int")) == "class"
    with pytest.raises(ValueError, match="no rows"):
        R.require_rows(spark.range(0), "t")


def test_append_adds_only_new_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    Wr.write_parquet(spark.range(5), path)
    for _ in range(2):
        Wr.append_new(spark.range(3, 8), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(8))


def test_partition_replacement_keeps_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    days = spark.sql("SELECT id, DATE'2024-01-01' + CAST(id % 2 AS INT) AS process_date FROM range(10)")
    Wr.replace_partitions(days, path, ["process_date"])
    Wr.replace_partitions(days.where("process_date = DATE'2024-01-02'").limit(1), path, ["process_date"])
    table = spark.read.parquet(path)
    assert medallion.of_process_date(table, "2024-01-01").count() == 5
    assert medallion.of_process_date(table, "2024-01-02").count() == 1
    plan = medallion.of_process_date(table, "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(process_date" in plan


def test_export_quotes_every_cell(spark, tmp_path):
    path = str(tmp_path / "out")
    row = spark.createDataFrame([("2024-01", 1.5, 2.0, None, None, 1, 0, 3)], ", ".join(
        f"{c} {'string' if c == 'periodo' else 'double' if i < 5 else 'int'}" for i, c in enumerate(Wr.EXPORT_COLUMNS)))
    Wr.export_csv(row, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0].replace('"', "") == ",".join(Wr.EXPORT_COLUMNS)
    assert lines[1] == '"2024-01","1.5","2.0","","","1","0","3"'


def _lake(tmp_path):
    head = "datahora,dia,mes,ano,date,time,{parts},total\n"
    cons, prod, price = [], [], ["title", "unit", "Date;Hour;Portugal;Spain"]
    for h in range(48):
        stamp = f"2024-01-{1 + h // 24:02d}"
        price.append(f"{stamp};{h % 24 + 1};{40 + h};50")
        for q in range(4):
            at = f"{stamp}T{h % 24:02d}:{15 * q:02d}:00+00:00,1,1,2024,{stamp},{h % 24:02d}:{15 * q:02d}"
            cons.append(f"{at},1,1,1,1,{4 + h % 3}")
            if h != 10:
                prod.append(f"{at},2,3,5")
    cons.append(cons[0].rsplit(",", 1)[0] + ",0")  # a duplicate with a zero total
    cons = [c for c in cons if "2024-01-01T10:" not in c]  # hour 10 is absent from both sides
    write(tmp_path / "raw" / "consumption" / "c.csv", head.format(parts="bt,mt,at,mat") + "\n".join(cons) + "\n")
    write(tmp_path / "raw" / "production" / "p.csv", head.format(parts="dgm,pre") + "\n".join(prod) + "\n")
    write(tmp_path / "raw" / "price" / "d.csv", "\n".join(price) + "\n")


def test_medallion_run(spark, tmp_path):
    _lake(tmp_path)
    base = str(tmp_path)
    for _ in range(2):
        medallion.run_medallion(spark, base, AT, repeats=2)
    gold = spark.read.parquet(f"{base}/gold/balance_hourly")
    assert gold.count() == gold.select("timestamp_utc").distinct().count() == 48
    filled = gold.where(F.col("timestamp_utc") == F.lit(datetime(2024, 1, 1, 10)).cast("timestamp_ntz")).first()
    assert filled["flag_missing_source"] and filled["producao_total_kwh"] == 20.0
    assert spark.read.parquet(f"{base}/silver/consumption_15min").count() == 47 * 4
    market = spark.read.parquet(f"{base}/gold/market_hourly")
    assert market.count() == 47 and market.where("consumo_lag_24h IS NOT NULL").count() == 23
    assert spark.read.parquet(f"{base}/gold/load_features_hourly").where("consumo_next_hour IS NULL").count() == 0
    medallion.extend_balance(spark, f"{base}/gold/balance_hourly", datetime(2024, 1, 3, 5))
    assert spark.read.parquet(f"{base}/gold/balance_hourly").count() == 54


def _checks(spark, base, run_id):
    rows = spark.read.parquet(f"{base}/quality/checks").where(F.col("run_id") == run_id).collect()
    return {(r["table_name"], r["check"]): r for r in rows}


def test_run_stops_before_a_table_that_fails_its_checks(spark, tmp_path):
    _lake(tmp_path)
    base = str(tmp_path)
    medallion.run_medallion(spark, base, AT, run_id="good")
    good = _checks(spark, base, "good")
    assert all(r["passed"] for r in good.values())
    assert good["gold_balance_hourly", "rows"]["observed"] == 47
    assert good["gold_balance_hourly", "completeness"]["threshold"] is None
    assert {t for t, _ in good} >= {"bronze_price_b", "silver_price_hourly", "gold_market_hourly", "gold_load_features_hourly"}
    tables = ("silver/consumption_15min", "gold/balance_hourly", "gold/market_hourly")
    before = {name: sorted(map(str, spark.read.parquet(f"{base}/{name}").collect())) for name in tables}
    path = tmp_path / "raw" / "consumption" / "c.csv"
    lines = path.read_text().splitlines()
    path.write_text("\n".join([*lines, lines[1].replace("T00:00", "T00:07").rsplit(",", 1)[0] + ",-50000"]) + "\n")
    with pytest.raises(FailedChecks, match="silver_consumption_15min.*non_negative"):
        medallion.run_medallion(spark, base, AT, pipelines=[medallion.BALANCE], run_id="bad")
    with pytest.raises(FailedChecks, match="silver_consumption_hourly"):
        medallion.run_medallion(spark, base, AT, pipelines=[medallion.MARKET], run_id="bad market")
    assert {name: sorted(map(str, spark.read.parquet(f"{base}/{name}").collect())) for name in tables} == before
    bad = _checks(spark, base, "bad")
    assert [k for k, r in bad.items() if not r["passed"]] == [("silver_consumption_15min", "non_negative_consumo_total_kwh")]
    assert ("gold_balance_hourly", "rows") not in bad and len(_checks(spark, base, "good")) == len(good)
    assert not [f for f in tmp_path.rglob("*staging*")]
    lax = {"silver_consumption_15min": {"non_negative_consumo_total_kwh": 1}, "gold_balance_hourly": {"completeness": 0.999}}
    with pytest.raises(FailedChecks, match="gold_balance_hourly.*completeness"):
        medallion.run_medallion(spark, base, AT, pipelines=[medallion.BALANCE], run_id="lax", limits=lax)


def test_audit_of_an_empty_table(spark, tmp_path):
    audit = Q.Audit("t", [Q.row_count(), Q.hours_covered(), Q.Check("known", F.max("v"), 1)], ["timestamp_utc"])
    empty = spark.createDataFrame([], "timestamp_utc timestamp_ntz, v double")
    with pytest.raises(FailedChecks, match="known"):
        Wr.write_parquet(empty, str(tmp_path / "t"), audit=audit)
    assert [r[1:3] for r in audit.results[:2]] == [("rows", 0.0), ("completeness", None)]
    assert not (tmp_path / "t").exists()


def test_folds_are_balanced_and_disjoint(spark):
    df = spark.range(1003).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    folded = X.stratified_folds(df, "y", "id")
    sizes = folded.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in sizes if r["y"] == y]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    test = X.stratified_holdout(df, "y", "id").where("is_test").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in test} == {0: 180, 1: 20}


def test_ranking_metrics_by_brute_force(spark):
    rows = [(i * 7 % 3 % 2, (i * 13 % 10) / 10.0) for i in range(60)]
    pairs = [(p, n) for y1, p in rows if y1 for y0, n in rows if not y0]
    auc = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in pairs) / len(pairs)
    positives, ap, tp, fp = sum(y for y, _ in rows), 0.0, 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        hit = sum(y for y, x in rows if x == s)
        tp, fp = tp + hit, fp + sum(1 - y for y, x in rows if x == s)
        ap += hit / positives * tp / (tp + fp)
    got = K.ranking_metrics(spark.createDataFrame(rows, "label int, score double")).first()
    assert got["roc_auc"] == pytest.approx(auc) and got["average_precision"] == pytest.approx(ap)


def test_imputer_fills_the_median(spark):
    from pyspark.ml import Pipeline

    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (9.0,)], "x double")
    stages = ml.preparation(["x"])
    filled = Pipeline(stages=stages[:1]).fit(df).transform(df)
    assert sorted(r["x__filled"] for r in filled.collect()) == [1.0, 3.0, 3.0, 9.0]


def test_deficit_model_learns_a_daily_pattern(spark, tmp_path):
    from .test_timeline_gold import gold_rows

    gold = gold_rows(spark, {h: 10.0 + h % 5 for h in range(600)}, {h: 20.0 if h % 24 < 12 else 5.0 for h in range(600)})
    model, measured = ml.train_deficit_model(gold, trees=10)
    assert measured.first()["f1"] > 0.95
    ml.save_model(model, measured, str(tmp_path / "m"))
    loaded, metrics = ml.load_model(spark, str(tmp_path / "m"))
    assert loaded.features == X.feature_names() and metrics.first()["f1"] > 0.95
    row = ml.predict_next_hour(loaded, gold).first()
    assert row["pred_flag_defice_t_plus_1"] == (1 if 600 % 24 >= 12 else 0)


def test_grid_search_picks_the_best_tree(spark):
    df = spark.range(400).select("id", (F.col("id") % 4).cast("double").alias("x"), ((F.col("id") * 37) % 11).cast("double").alias("z"),
                                 (F.col("id") % 4).cast("int").alias("label"))
    results = ml.grid_search_trees(df, ["x", "z"], "label", "id")
    assert results.count() == 8 and K.best_configuration(results).first()["f1_macro"] == 1.0
    _, best = ml.refit_best_tree(df, ["x", "z"], "label", results)
    assert best["max_depth"] == 2


def test_cross_validation_reports_every_fold(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    folds = ml.cross_validate(df, ["x"], "y", "id")
    assert folds.count() == 5 and folds.agg(F.min("roc_auc")).first()[0] == 1.0
    assert K.fold_summary(folds, ["accuracy"]).first()["n_folds"] == 5
