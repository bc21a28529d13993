import math

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tests.llm.test_text_operators import secret_rows
from tests.llm.util import documents, edited
from voltlake.llm.queries import QUERIES

#: Texts repeated four times, with an edit and without, have nearly the shingles of the text itself, which stays.
NEAR = {k + i for k in (2000, 3000) for i in range(20, 40)}
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, truth = secret_rows()
    base = [t.split() for _, t in rows]
    copies = [(1000 + i, rows[i][1].upper() if i % 2 else rows[i][1]) for i in range(20)]
    near = [(2000 + i, " ".join(edited(base[i] * 4, i, 1))) for i in range(20, 40)] + [(3000 + i, " ".join(base[i] * 4)) for i in range(20, 40)]
    junk = [(4000, None), (4001, ""), (4002, "12345 !!! 678")]
    every = [(i, t, "en") for i, t in rows + copies + near + junk]
    path = str(tmp_path_factory.mktemp("pipeline"))
    documents(spark, every).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return path, every, truth


def test_each_stage_does_its_part(spark, folder):
    path, every, truth = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.schema
        docs = corpus_pipeline.staged(stage(spark, docs, path), name)
        assert docs.schema == before
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = {i for i, _, _ in every}
    assert ids - set(kept["language_id"]) == {4000, 4001, 4002}
    assert set(kept["language_id"]) - set(kept["exact_dedup"]) == set(range(20))
    assert set(kept["exact_dedup"]) - set(kept["ngram_jaccard_join"]) == NEAR
    assert set(kept["secret_scan"]) == set(kept["ngram_jaccard_join"])
    assert not any(value in text for _, value in truth for text in kept["secret_scan"].values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {p.doc_id for p in pieces} == set(kept["secret_scan"])


def test_copies_go_by_row(spark):
    """A text stays though a copy of another text bears its id."""
    rows = [(5, "alone"), (5, "Copy"), (7, "copy"), (5, None), (9, ""), (None, "copy"), (None, "none")]
    got = corpus_pipeline.drop_copies(spark, documents(spark, rows), "").select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, "alone"), (7, "copy"), (9, ""), (None, "copy"), (None, "none")], key=str)


def test_texts_that_stay_are_not_shuffled(spark):
    """Only rows whose id has its bit set are joined with the ids that go; with the bitmap no text of another is sent."""
    rows = [(k, "text %d" % k) for k in range(2000)] + [(None, "none"), (7, "again")]
    gone = spark.createDataFrame([(k,) for k in range(0, 2000, 100)] + [(7,)], "_id bigint")
    docs = documents(spark, rows)
    left = corpus_pipeline._less(docs.withColumn("doc_id", docs["doc_id"].cast("int")), gone, F.col("doc_id") == F.col("_id"))
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "bitmap_construct_agg" in plan
    ids = sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect())
    assert ids == [k for k in range(2000) if k % 100 and k != 7] and left.where("doc_id IS NULL").count() == 1


def test_run_applies_all_stages(spark, folder):
    path, every, _ = folder
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == {i for i, _, _ in every} - set(range(20)) - NEAR - {4000, 4001, 4002}


def test_pipeline_of_nothing(spark, tmp_path):
    documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_all_queries_are_registered():
    names = entry_points.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_and_agrees_with_its_sql(spark, sf_dir, name):
    df = QUERIES[name].run(spark, sf_dir)
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got or name == "op9_secret_scan"
    if QUERIES[name].sql:
        con = duckdb.connect()
        for table in TABLES:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        result = con.execute(QUERIES[name].sql)
        at = [[c[0] for c in result.description].index(c) for c in df.columns]
        assert got == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str)
    assert not any(isinstance(x, float) and math.isnan(x) for r in got for x in r)
