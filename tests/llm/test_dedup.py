import hashlib
import re

import pytest

from tests.llm.util import Union, documents, edited, lower, prose
from voltlake.llm import exact_dedup, set_join
from voltlake.llm.graph import components
from voltlake.session import new_folder

EDGES = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "É"), (6, "é"), (7, "a b"), (7, "a b"), (None, "a b"), (None, "only"), (8, "x" * 300_000)]


def test_exact_dedup_against_brute_force(spark):
    rows = EDGES + [(100 + i, "copy") for i in range(50)]
    got = sorted(map(tuple, exact_dedup.exact_duplicates(documents(spark, rows)).collect()), key=str)
    want = []
    for i, text in rows:
        same = [k for k, t in rows if lower(t) == lower(text)]
        keep = max((k for k in same if k is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(lower(text).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_duplicates(documents(spark, [])).collect() == []


def test_index_persists_between_batches(spark):
    path = new_folder(spark, "index-test")
    first = exact_dedup.DigestIndex(spark, path, 4).add(documents(spark, [(5, "a"), (9, "A"), (1, "b")]))
    assert {(r.doc_id, r.keep_id, r.kept) for r in first.collect()} == {(5, 9, False), (9, 9, True), (1, 1, True)}
    for _ in range(2):  # adding a batch again changes nothing
        index = exact_dedup.DigestIndex(spark, path, 4)
        later = index.add(documents(spark, [(20, "a"), (21, "c"), (22, "C")]))
        assert {(r.doc_id, r.keep_id, r.kept) for r in later.collect()} == {(20, 9, False), (21, 22, False), (22, 22, True)}
        assert index.rows().count() == 3
    plan = index.rows().hint("merge").join(index.rows(), "digest")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def brute_components(rows, num, den, width):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    union = Union(sets)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                union.join(a, b)
    return {i: (len(s), union.find(i)) for i, s in sets.items()}


@pytest.fixture(scope="module")
def near_rows():
    rows, i = [], 0
    for group, (size, length) in enumerate([(12, 30), (12, 80), (10, 200), (6, 900), (25, 60)]):
        base = prose(group, length)
        for k in range(size):
            rows.append((i := i + 1, " ".join(edited(base, i, k % 7))))
    passage = prose(99, 60)
    rows += [(1000 + k, " ".join(prose(500 + k, 40) + passage + prose(600 + k, 40))) for k in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "one\x0btwo")]
    return rows + [(3000 + k, "the very same text of many copies") for k in range(30)]


@pytest.mark.parametrize(("num", "den", "width", "row_cost"), [(9, 10, 3, 500), (9, 10, 3, 0.001), (4, 5, 5, 500), (4, 5, 5, 0.001), (3, 5, 2, 500)])
def test_set_join_against_brute_force(spark, near_rows, num, den, width, row_cost):
    got = set_join.linked_components(documents(spark, near_rows), num, den, width, row_cost).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(near_rows, num, den, width)
    assert len(got) == len(near_rows)


def test_set_join_compares_large_groups_in_chunks(spark, near_rows, monkeypatch):
    monkeypatch.setattr(set_join, "CHUNK", 3)
    got = set_join.linked_components(documents(spark, near_rows), 4, 5, 5).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(near_rows, 4, 5, 5)


def test_large_component_of_a_group_is_not_compared_with_itself(spark, monkeypatch):
    monkeypatch.setattr(set_join, "CHUNK", 10)
    rows = [(1, d, 5, True, 0 if d < 200 else d) for d in range(203)]
    frame = spark.createDataFrame(rows, "sig bigint, d bigint, n bigint, full boolean, component bigint")
    made = set_join._between_chunks(frame).collect()
    assert len(made) <= 200 + 3 * 20  # every chunk with every other: 203 * 20
    pieces = {}
    for r in made:
        pieces.setdefault((r.i, r.j, r.within), []).append(r)
    met = {frozenset((x.d, y.d)) for (i, j, within), rs in pieces.items() for x in rs for y in rs
           if x.chunk == i and (y.chunk == j != i or within and y.chunk == i)}
    assert {frozenset((a, b)) for a in range(203) for b in range(200, 203) if a != b} <= met


def test_later_links_rename_whole_components(spark):
    found = spark.createDataFrame([(k, k // 10 * 10) for k in range(40)], "node bigint, component bigint")
    links = spark.createDataFrame([(13, 35), (38, 50), (21, 22)], "a bigint, b bigint")
    got = {r.node: r.component for r in set_join._joined(found, links).collect()}
    assert got == {k: 10 if k // 10 == 3 else k // 10 * 10 for k in range(40)} | {50: 10}


def test_set_join_of_near_copies_around_the_threshold(spark, monkeypatch):
    """Groups of several chunks with a large component, likely pairs that aren't linked and one-deletion neighbourhoods."""
    monkeypatch.setattr(set_join, "CHUNK", 20)
    base = prose(7, 60)
    rows = [(k, " ".join(edited(base, k, k % 5))) for k in range(160)]
    for row_cost in (500, 0.001):
        got = set_join.linked_components(documents(spark, rows), 4, 5, 5, row_cost).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 5, 5)


def test_set_join_edge_rows(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (3, "a b c d"), (9, "long " * 50_000)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in set_join.linked_components(documents(spark, rows)).collect())
    assert got == [("3", 2, 3), ("4", 2, 3), ("4", 2, 3), ("9", 1, 9), ("None", 2, None)]
    assert set_join.linked_components(documents(spark, [])).collect() == []


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {200 + i: 200 for i in range(30)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
