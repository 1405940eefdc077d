import numpy as np
import pytest

from tagloom.llm.heavy import BUCKETS, ROWS, GroupTesting, bucket_of, decode, heavy_terms

SCHEMA = "k string, v string"


def brute(rows, share):
    out = {}
    for i, field in enumerate("kv"):
        values = [r[i] for r in rows if r[i] is not None]
        for term in set(values):
            n = values.count(term)
            if n * share >= len(values):
                out[field, term] = n
    return out


def found(spark, rows, share=200):
    return {(r.field, r.term): r.rows for r in heavy_terms(spark.createDataFrame(rows, SCHEMA), ("k", "v"), share).collect()}


def test_sketches_add_up_and_decode():
    rng = np.random.default_rng(1)
    noise = rng.integers(0, 2**63, 200_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    heavy = rng.integers(0, 2**63, 150).astype(np.uint64)
    values = np.concatenate([noise, np.repeat(heavy, 1400)])
    rng.shuffle(values)
    a, b = GroupTesting(), GroupTesting()
    a.add(values[:50_000])
    b.add(values[50_000:])
    counts = a.counts + b.counts
    spelt = {decode(r, i, counts[r, i]) for r in range(ROWS) for i in range(BUCKETS) if counts[r, i, 0]}
    assert {int(np.int64(h)) for h in heavy.view(np.int64)} <= spelt
    assert all(0 <= bucket_of(noise, r).min() and bucket_of(noise, r).max() < BUCKETS for r in range(ROWS))


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{int(a)}" if a % 9 else None, str(int(b))) for a, b in zip(rng.zipf(1.3, 5000) % 2000, rng.zipf(1.8, 5000), strict=True)]
    assert found(spark, rows) == brute(rows, 200)
    assert found(spark, rows, 20) == brute(rows, 20)


def test_ties_at_the_bound_empty_string_and_long_terms(spark):
    rows = [(str(i), "") for i in range(200)] + [("x" * 100_000, None)] * 3
    got = found(spark, rows)
    assert got["v", ""] == 200 and got["k", "x" * 100_000] == 3 and len(got) == 2
    ties = [(str(i % 100), None) for i in range(400)]
    assert len(found(spark, ties, 100)) == 100


def test_empty_and_null(spark):
    assert found(spark, []) == {}
    assert found(spark, [(None, None)]) == {}


def test_further_columns(spark):
    df = spark.createDataFrame([("a", "b", 1, "x")], SCHEMA + ", hash int, field string")
    assert heavy_terms(df, ("k",)).collect()[0].asDict() == {"field": "k", "term": "a", "rows": 1}
    with pytest.raises(ValueError, match="share"):
        heavy_terms(df, ("k",), 5000)
