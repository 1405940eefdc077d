import numpy as np
import pytest

from tagloom.llm.mix import mix_sources

DOCS, TARGETS = "doc_id bigint, text string, source string", "source string, weight double, max_repeat int"


def run(spark, docs, targets, **more):
    used, shares = mix_sources(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), **more)
    return used.collect(), {r.source: r for r in shares.collect()}


def corpus():
    rng = np.random.default_rng(4)
    out = []
    for source, n in (("a", 900), ("b", 150), ("c", 30), ("other", 50), (None, 20)):
        out += [(len(out) + i, "word " * int(rng.integers(1, 60)), source) for i in range(n)]
    return out


@pytest.mark.parametrize("bits", [2, 10])
def test_shares_and_repeats(spark, bits):
    docs = corpus()
    used, shares = run(spark, docs, [("a", 0.6, 2), ("b", 0.3, 3), ("c", 0.1, 4)], level_bits=bits)
    assert {u.source for u in used} == {"a", "b", "c"}
    for s in "abc":
        assert shares[s].share == pytest.approx(shares[s].target_share, abs=0.003)
        assert not shares[s].short
    assert sum(r.share for r in shares.values()) == pytest.approx(1)
    assert all(1 <= u.copies <= {"a": 2, "b": 3, "c": 4}[u.source] for u in used)
    for s in "abc":
        assert shares[s].tokens == sum(u.tokens * u.copies for u in used if u.source == s)
    assert len({u.doc_id for u in used}) == len(used)
    assert any(shares[s].most_copies == {"a": 2, "b": 3, "c": 4}[s] for s in "abc")


def test_total_given(spark):
    used, shares = run(spark, corpus(), [("a", 0.5, 1), ("b", 0.5, 1)], total=2000)
    assert 1800 < sum(r.tokens for r in shares.values()) <= 2000
    _, shares = run(spark, corpus(), [("a", 0.5, 1), ("c", 0.5, 2)], total=10**7)
    assert shares["a"].short and shares["c"].short and shares["c"].tokens == 2 * shares["c"].available_tokens


def test_source_without_documents_and_odd_targets(spark):
    docs = [(1, "one two", "a"), (2, None, "a"), (3, "", "a"), (None, "x", "a"), (4, "y", "A")]
    used, shares = run(spark, docs, [("a", 0.9, 1), ("none", 0.1, 5), (None, 0.5, 1), ("zero", 0.0, 1), ("null", None, None), ("neg", -1.0, 2), ("a", 0.2, 1)])
    assert shares["a"].share == 1.0 and shares["none"].short and not shares["zero"].short and shares["none"].tokens == 0
    assert {u.doc_id for u in used} == {1, 2, 3, None} and set(shares) == {"a", "none", "zero", "null", "neg"}


def test_repeated_rows_long_texts_and_empty_tables(spark):
    docs = [(1, "w " * 100_000, "a")] + [(2, "x", "b")] * 5
    used, shares = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert shares["b"].tokens == 5 and shares["a"].tokens == 0
    assert run(spark, [], [("a", 1.0, 1)])[0] == [] and run(spark, [], [("a", 1.0, 1)])[1]["a"].short
    assert run(spark, docs, []) == ([], {})


def test_further_columns(spark):
    df = spark.createDataFrame([(1, "x", "a", 5, 6)], DOCS + ", hash int, tokens int")
    targets = spark.createDataFrame([("a", 1.0, 1, "q")], TARGETS + ", tokens string")
    assert mix_sources(df, targets)[0].count() == 1


def test_large_documents_on_the_threshold(spark):
    """A source of few documents, one of them larger than what is left, still gets its share by further copies."""
    docs = [(i, "word " * 10, "small") for i in range(20)] + [(100, "word " * 700, "small")] + [(200 + i, "word " * 20, "big") for i in range(400)]
    _, shares = run(spark, docs, [("big", 0.9, 1), ("small", 0.1, 8)])
    assert shares["small"].share == pytest.approx(0.1, rel=0.02) and not shares["small"].short and shares["small"].most_copies > 1
    _, shares = run(spark, [(1, "word " * 100, "a"), (2, "word " * 150, "b")], [("a", 0.5, 1), ("b", 0.5, 1)])
    assert shares["a"].tokens > 95 and shares["b"].tokens > 95 and shares["b"].short and not shares["a"].short
