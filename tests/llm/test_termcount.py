from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm.termcount import BurstTrie, count_terms, mark_terms

SCHEMA = "kind string, idx bigint, pos int, k string, v string"


def brute(rows):
    occ, rec = defaultdict(int), defaultdict(set)
    for kind, idx, _, k, v in set(rows):
        for field, term in (("k", k), ("v", v)):
            if term is not None:
                occ[field, term] += 1
                rec[field, term].add((kind, idx))
        if k is not None or v is not None:
            rec["", ""].add((kind, idx))
            occ["", ""] += 1
    return {x: (occ[x], len(rec[x])) for x in occ}


def found(spark, rows, **more):
    out = count_terms(spark.createDataFrame(rows, SCHEMA), ("kind", "idx"), ("k", "v"), **more)
    return {(r.field, r.term): (r.occurrences, r.records) for r in out.collect()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(1, 5)), max_size=80), st.integers(1, 8))
def test_trie_against_dict(entries, burst_at):
    trie, want = BurstTrie(burst_at), defaultdict(lambda: [0, 0])
    for term, n in entries:
        trie.add(term, n, 1)
        want[term][0] += n
        want[term][1] += 1
    got = [(p + s, c) for p, container in trie.subtrees() for s, c in container]
    assert [t for t, _ in got] == sorted(want)
    assert dict(got) == dict(want)


def _rows():
    rows = [("node", i % 40, i, f"key:{i % 7}", f"http://example.org/{'x' * (i % 5)}/{i}") for i in range(400)]
    rows += [("way", 1, 0, "name", "é"), ("way", 1, 1, "name", "é"), ("way", 1, 1, "name", "é"), ("way", 2, 0, None, ""), ("way", None, 0, "", None), ("way", 3, 0, None, None), ("node", 5, 900, "key:1", "z" * 100_000)]
    return rows


@pytest.mark.parametrize("most", [3, 40, 50_000])
def test_against_brute_force(spark, most):
    assert found(spark, _rows(), most=most) == brute(_rows())


def test_one_term_everywhere(spark):
    rows = [("node", i, 0, "same", "same") for i in range(300)] * 2
    assert found(spark, rows, most=2) == {("k", "same"): (300, 300), ("v", "same"): (300, 300), ("", ""): (300, 300)}


def test_empty_and_all_null(spark):
    assert found(spark, []) == {}
    assert found(spark, [("node", 1, 0, None, None)]) == {}
    assert mark_terms(count_terms(spark.createDataFrame([], SCHEMA), ("kind", "idx"), ("k", "v"))).count() == 0


def test_marks(spark):
    rows = [("node", i, 0, "all", str(i // 3)) for i in range(60)] + [("node", 100, 0, None, None)]
    marks = {(r.field, r.term): r.mark for r in mark_terms(count_terms(spark.createDataFrame(rows, SCHEMA), ("kind", "idx"), ("k", "v"))).collect()}
    assert marks["k", "all"] == "common" and marks["v", "0"] == "common"
    rows = [("node", i, 0, "all", str(i // 3)) for i in range(90)] + [("node", 200, 0, "x", "7")]
    marks = {(r.field, r.term): r.mark for r in mark_terms(count_terms(spark.createDataFrame(rows, SCHEMA), ("kind", "idx"), ("k", "v"))).collect()}
    assert marks["k", "x"] == "rare" and marks["v", "0"] is None and ("", "") not in marks


def test_further_columns_make_rows_differ(spark):
    df = spark.createDataFrame([("node", 1, 0, "a", "b", 1, "x"), ("node", 1, 0, "a", "b", 2, "x")], SCHEMA + ", term int, field string")
    assert {(r.field, r.term): r.occurrences for r in count_terms(df, ("kind", "idx"), ("k",)).collect() if r.field} == {("k", "a"): 2}


def test_texts_that_are_no_utf8_and_flushed_tries(spark, monkeypatch):
    df = spark.sql("select 'node' as kind, id as idx, 0 as pos, cast(X'FF41' as string) as k, concat('v', id % 3) as v from range(200)")
    assert {(r.field, r.occurrences) for r in count_terms(df, ("kind", "idx"), ("k", "v")).collect()} == {("k", 200), ("v", 67), ("v", 66), ("", 200)}
    from tagloom.llm import termcount

    monkeypatch.setattr(termcount, "HELD_TERMS", 5)
    monkeypatch.setattr(termcount, "_GROUPED_BATCHES", 1)
    assert found(spark, _rows(), most=40) == brute(_rows())
