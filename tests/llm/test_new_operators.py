import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tests.llm.util import documents, lower, prose
from tests.test_catalogue import _rows
from voltlake.llm import hard_negatives, quality_rules, spelling_variants

SMALL = "/root/testdata/sf0.01"
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b a b a b a b"), (6, "x\nx\n\n \nx y\nx"), (7, "# $5 *&|<>%"), (8, "ñ é ß"), (8, "ñ é ß"), (None, "no id here"), (9, "w " * 60_000), (10, "y" * 200_000)]


def by_key(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


# Quality rules


def base_row(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    counts = len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    return *counts, len(words) < 50 or 100 * len(covered) > 50 * len(words)


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, 0, "t") for r in rows], "doc_id bigint, quality int, toxic int, text string")


def test_quality_counts_on_edge_rows(spark):
    docs = documents(spark, EDGE)
    got = quality_rules.judge(docs, quality_rules.train(docs, labels_of(spark, [])))
    assert by_key(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted([(i, *base_row(t)) for i, t in EDGE], key=str)
    assert all(r.p_good is None and r.kept != r.base_failed for r in got.collect())
    assert quality_rules.judge(documents(spark, []), None).collect() == []


def test_quality_verdict_is_learned(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    # Learned from one half, held against the other.
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = quality_rules.train(docs, labels.where(half))
    rows = quality_rules.judge(docs, model).join(labels.where(~half).select("doc_id", "quality"), "doc_id").where("NOT base_failed").collect()
    assert len(rows) > 100 and sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.97
    assert {r.quality for r in rows} == {0, 1} and all(0 <= r.p_good <= 1 for r in rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert tuple(r)[1:7] == base_row(text[r.doc_id])
    kept = quality_rules.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality_rules.judge(docs, model).where("kept").collect())


def test_quality_training_takes_odd_labels(spark):
    rows = [(i, " ".join(prose(i, 60))) for i in range(60)] + [(100 + i, " ".join(f"#{w}|" for w in prose(i, 60))) for i in range(60)]
    docs = documents(spark, rows)
    good = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)]
    odd = [(None, 1), (3, None), (5, 0), (7, 1), (7, 1), (9, 4), (10**9, 0)]
    model = quality_rules.train(docs, labels_of(spark, good + odd))
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(docs, model).collect()}
    assert sum(verdict[i] == (i < 100) for i, _ in rows) >= 116
    assert np.array_equal(model.weights, quality_rules.train(docs.repartition(5), labels_of(spark, odd + good)).weights)
    assert quality_rules.train(docs, labels_of(spark, [(1, 1), (2, 1)])) is None


def test_calibration_meets_the_share_of_good_rows():
    rng = np.random.default_rng(3)
    score = rng.normal(size=4000)
    good = (rng.random(4000) < 1 / (1 + np.exp(-(2 * score - 1)))).astype(int)
    slope, offset = quality_rules.fit_calibration(score, good, np.ones(4000))
    assert abs(slope - 2) < 0.2 and abs(offset + 1) < 0.15
    slope, offset = quality_rules.fit_calibration(np.r_[np.ones(5), -np.ones(5)], np.r_[np.ones(5), np.zeros(5)], np.ones(10))
    assert np.isfinite([slope, offset]).all() and slope > 0


# Spelling variants


def brute_variants(counts, ratio=5):
    groups, near = defaultdict(set), {w: set() for w in counts}
    for w in counts:
        for p in range(len(w)):
            groups[w[:p], w[p + 1 :]].add(w)
    for w in counts:
        for p in range(len(w)):
            near[w] |= groups[w[:p], w[p + 1 :]] - {w}
            v = w[:p] + w[p + 1 :]
            if v in counts:
                near[w].add(v)
                near[v].add(w)
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def run_counts(rows):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_spelling_query_against_brute_force(spark):
    got = entry_points.queries()["op12_spelling_variants"](spark, SMALL).collect()
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    want = brute_variants(run_counts(texts))
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r.root != r.form for r in got if r.form)


@pytest.mark.parametrize("hot", [1, 3, 100])
def test_spelling_of_hot_chunks_and_odd_words(spark, hot):
    counts = {"abcdef" + a + b: 1 + 30 * (a == "a") * (b == "b") for a in "abcdeÉ" for b in "abcdeé"}
    counts |= {"abcdefa": 900, "bcdefab": 2, "aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaaaa": 625, "baaaaaaaa": 625, "a": 3, "b": 20, "": 1, "é": 100}
    words = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n bigint, form string")
    assert {tuple(r) for r in spelling_variants.variant_forms(words, hot=hot).collect()} == brute_variants(counts)


def test_runs_of_edge_rows(spark):
    rows = [*EDGE, (11, "ÀÉÞß×÷ ABCdef abcDEF-abcdef ΩabcdefÿghiĀ")]
    got = Counter(r.run for r in spelling_variants.runs(documents(spark, rows), 6).collect())
    assert got == {"ÀÉÞß×÷": 1, "abcdef": 3, "abcdefÿghi": 1, "y" * 200_000: 1}
    run, at = F.col("run"), F.col("at")
    cut = spark.createDataFrame([("añb", 0), ("añb", 1), ("añb", 2), ("x", 0)], "run string, at bigint").select(spelling_variants.without_character(run, at))
    assert [r[0] for r in cut.collect()] == ["ñb", "ab", "añ", ""]
    none = spelling_variants.counted(spelling_variants.runs(documents(spark, []), 6).withColumnRenamed("run", "word"), 6, 5)
    assert spelling_variants.variant_forms(none).collect() == []


# Hard negatives

VECTORS = "vec_id bigint, embedding array<double>, label int, key bigint, score double, block string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], VECTORS)


def brute_negatives(rows, every=10, k=5):
    whole = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or None in v or not np.isfinite(v).all():
            continue
        whole[i, str(label), tuple(int(np.floor(256 * x)) for x in v)] = None
    top = 2**63 - 1
    out = []
    for a in whole:
        if a[0] % every:
            continue
        score = [(max(-top - 1, min(top, sum(p * q for p, q in zip(a[2], b[2], strict=True)))), b) for b in whole if b != a and len(b[2]) == len(a[2])]
        order = sorted(score, key=lambda s: (-s[0], s[1][0]))
        for s, p in [x for x in order if x[1][1] == a[1]][:k]:
            inside = [x for x in order if x[1][1] != a[1] and 80 * s <= 100 * x[0] <= 100 * s]
            out += [(a[0], p[0], r, n[0], s, t) for r, (t, n) in enumerate(inside[:k], 1)]
    return sorted(out)


def mined(frame, **kw):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, **kw).collect())


@pytest.mark.parametrize("block_bytes", [1 << 12, 1 << 25])
def test_hard_negatives_against_brute_force(spark, block_bytes):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 40))
    rows = [(i, (centres[rng.integers(6)] + rng.normal(size=40) * rng.choice([0.05, 0.5, 1.5])).tolist(), int(rng.integers(3))) for i in range(700)]
    rows += [(1000 + i, rows[10][1], i % 3) for i in range(300)]  # copies of an anchor
    rows += [(2000 + i, [0.0] * 40, 1) for i in range(20)] + [(3000 + i, rng.normal(size=7).tolist(), i % 2) for i in range(40)]
    assert mined(vectors(spark, rows), block_bytes=block_bytes) == brute_negatives(rows)


def test_hard_negatives_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.9, 0.5], 2), (2, [0.9, 0.5], 2), (3, [1.0, 0.3], 2), (4, [1.0, 0.3], 2), (5, None, 1),
        (6, [None, 1.0], 1), (7, [inf, 1.0], 2), (8, [nan, 1.0], 2), (9, [1.0, 0.5], None), (None, [1.0, 0.5], 1), (10, [], 1), (11, [], 1), (12, [], 2), (13, [2.0], 1),
        (20, [3e18, -3e18, 1.0], 1), (21, [3e18, -3e18, 0.5], 1), (22, [3e18, -3e18, 0.5], 2), (23, [1e200, 1.0, 1.0], 2), (40, [1e200, 1e180, 0.0], 2), (41, [1e200, 0.0, 0.0], 2), (42, [5.0, 1.0, 0.0], 1), (30, [-1.0, -0.5], 3), (31, [0.0, 0.0], 3), (32, [0.001, -0.001], 4),
    ]
    assert mined(vectors(spark, rows)) == brute_negatives(rows)
    assert mined(vectors(spark, [])) == [] and mined(vectors(spark, rows[12:13])) == []


def test_hard_negative_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    df = entry_points.queries()["op13_hard_negative_mining"](spark, SMALL)
    result = con.execute(entry_points.oracle_sql()["op13_hard_negative_mining"])
    columns = [c[0] for c in result.description]
    assert _rows([tuple(r) for r in df.collect()], df.columns, sorted(columns)) == _rows(result.fetchall(), columns, sorted(columns))


def test_index_omits_suffixes_but_no_pair():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(500, 48)) * 100 * 0.9 ** np.arange(48))
    block = hard_negatives.Block(np.arange(500), np.arange(500), np.array(["a"] * 500, object), x)
    a, t = x[:20], np.full(20, float(np.percentile(x[:20] @ x.T, 95)))
    got = {(i, j, s) for part in block.above(a, t) for i, j, s in zip(*map(np.ndarray.tolist, part), strict=True)}
    s = (a @ x.T).astype(int)
    assert got == {(i, j, int(s[i, j])) for i, j in zip(*np.nonzero(s >= t[0]), strict=True)}
