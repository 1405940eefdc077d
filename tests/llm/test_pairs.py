from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import tagloom.llm.pairs as pairs_module
from tagloom.llm.pairs import count_pairs
from tagloom.llm.queries import QUERIES

SCHEMA = "kind string, idx bigint, item string"


def brute(rows, least=1):
    records = {}
    for kind, idx, item in rows:
        if item is not None:
            records.setdefault((kind, idx), set()).add(item)
    single = Counter(i for r in records.values() for i in r)
    both = Counter(p for r in records.values() for p in combinations(sorted(r, key=str.encode), 2))
    return {(a, b): (n, single[a], single[b], len(records)) for (a, b), n in both.items() if n >= least}


def found(spark, rows, least=1):
    return {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in count_pairs(spark.createDataFrame(rows, SCHEMA), min_together=least).collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [("node" if i % 3 else "way", int(i // 4), f"k{int(x)}=é{int(x) % 3}") for i, x in enumerate(rng.zipf(1.6, 4000) % 60)]
    rows += [("node", None, "a"), ("node", None, "b"), (None, 1, "a"), (None, 1, "c"), ("node", 1, None), ("node", 2, ""), *rows[:200]]
    for least in (1, 10):
        assert found(spark, rows, least) == brute(rows, least)


def test_large_record_and_hot_item(spark):
    rows = [("node", 0, f"i{i}") for i in range(300)] + [("node", i, "hot") for i in range(1000)] + [("node", i, "warm") for i in range(0, 1000, 2)]
    assert found(spark, rows) == brute(rows)


def test_odds_ratio_and_lift(spark):
    rows = [("n", i, x) for i in range(10) for x in (["a"] if i < 4 else []) + (["b"] if i < 3 else []) + ["z"]]
    r = {(r.item_a, r.item_b): r for r in count_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}["a", "b"]
    assert r.lift == pytest.approx(3 * 10 / (4 * 3)) and r.odds_ratio == pytest.approx(3.5 * 6.5 / (1.5 * 0.5))


def test_empty_long_and_further_columns(spark):
    assert found(spark, []) == {}
    assert found(spark, [("n", 1, "x" * 200_000), ("n", 1, "y")]) == {("x" * 200_000, "y"): (1, 1, 1, 1)}
    df = spark.createDataFrame([("n", 1, "a", 5, "q"), ("n", 1, "b", 6, "r")], SCHEMA + ", n_ab int, code string")
    assert count_pairs(df).count() == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6)), max_size=60), st.integers(1, 7), st.integers(1, 20))
def test_runs_over_any_batches(rows, size, run):
    rows = sorted(set(rows))
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(rows), pa.int64()), pa.array([r for r, _ in rows], pa.int64()), pa.array([i for _, i in rows], pa.int64())], ["k", "i", "d"])
    before, pairs_module.RUN_CODES = pairs_module.RUN_CODES, run
    try:
        runs = list(pairs_module._runs(batch.slice(a, size) for a in range(0, len(rows), size)))
    finally:
        pairs_module.RUN_CODES = before
    merged = sorted((c, n) for r in runs for c, n in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True))
    whole = pa.RecordBatch.from_arrays([pa.array([c for c, _ in merged], pa.int64()), pa.array([n for _, n in merged], pa.int64())], ["code", "n"])
    got = {c: n for b in pairs_module._sum_runs(whole.slice(a, size) for a in range(0, len(merged), size)) for c, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    want = Counter((a << 32) | b for r in range(4) for a, b in combinations([i for x, i in rows if x == r], 2))
    assert got == want


def test_a_query_gives_odds_ratios(spark, sf):
    rows = QUERIES["p2_odds"](spark, sf).collect()
    assert rows
    for r in rows:
        a, b, ab, n = r.n_a, r.n_b, r.n_ab, r.n
        assert r.odds_ratio == pytest.approx((ab + 0.5) * (n - a - b + ab + 0.5) / ((a - ab + 0.5) * (b - ab + 0.5)), abs=1e-6)


def test_too_many_items_are_an_error():
    import pyarrow as pa
    from tagloom.llm.pairs import _runs

    columns = [pa.array([1, 1]), pa.array([5, 5]), pa.array([3, 2**31])]
    with pytest.raises(ValueError, match="items"):
        list(_runs(iter([pa.RecordBatch.from_arrays(columns, ["kind", "idx", "id"])])))
