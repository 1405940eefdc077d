"""A third of all rows or more in one group: results stay whole."""

from tagloom.llm.bpe import encode_corpus
from tagloom.llm.heavy import heavy_terms
from tagloom.llm.mix import mix_sources
from tagloom.llm.pairs import count_pairs
from tagloom.llm.termcount import count_terms

TAGS = "kind string, idx bigint, pos int, k string, v string"


def test_terms(spark):
    rows = [("node", 1, 0, "k", "v")] * 10_000 + [("node", i, 1, "hot", str(i % 50)) for i in range(10_000)] + [("node", 2, i, f"k{i}", "x") for i in range(3000)]
    out = {(r.field, r.term): (r.occurrences, r.records) for r in count_terms(spark.createDataFrame(rows, TAGS), ("kind", "idx"), ("k", "v"), most=100).collect()}
    assert out["k", "hot"] == (10_000, 10_000) and out["k", "k"] == (1, 1) and out["v", "x"] == (3000, 1) and out["v", "7"] == (200, 200)
    assert len(out) == 3002 + 52 + 1  # terms of k, terms of v, the number of records


def test_pairs(spark):
    rows = [("n", i, "hot") for i in range(9000)] + [("n", i, f"c{i % 3}") for i in range(9000)] + [("n", 0, "hot")] * 9000
    out = {(r.item_a, r.item_b): r.n_ab for r in count_pairs(spark.createDataFrame(rows, "kind string, idx bigint, item string")).collect()}
    assert out == {("c0", "hot"): 3000, ("c1", "hot"): 3000, ("c2", "hot"): 3000}


def test_heavy(spark):
    rows = [("hot",)] * 20_000 + [(str(i),) for i in range(30_000)]
    assert [(r.term, r.rows) for r in heavy_terms(spark.createDataFrame(rows, "k string"), ("k",)).collect()] == [("hot", 20_000)]


def test_texts(spark):
    rows = [(i, "the same text again") for i in range(6000)] + [(-1, "word " * 300_000)]
    out = encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert out.selectExpr("sum(size(ids)) as n").first().n == 6000 * 4 + 300_001


def test_one_source_of_most(spark):
    docs = [(i, "some words here", "big") for i in range(6000)] + [(10_000 + i, "few words", "small") for i in range(50)]
    _, shares = mix_sources(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame([("big", 0.8, 1), ("small", 0.2, 4)], "source string, weight double, max_repeat int"))
    got = {r.source: r for r in shares.collect()}
    assert abs(got["big"].share - 0.8) < 0.005 and got["small"].most_copies == 4
