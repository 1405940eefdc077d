import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.core import dense_ids, hot_keys, lookup_join
from tagloom.operators import dictionary as d


def test_string_offsets(spark):
    rows = [(0, i, 0, s, None) for i, s in enumerate(["hello", "world", "world", "!", "!", "!"])]
    got = {r.s: r.byte_offset for r in d.string_table(spark.createDataFrame(rows, "kind_order int, idx bigint, pos int, k string, v string")).collect()}
    assert got == {"hello": 0, "world": 6, "!": 12}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="abcé", max_size=4), min_size=1, max_size=40))
def test_string_table_like_a_list(spark, strings):
    rows = [(0, i, 0, s, None) for i, s in enumerate(strings)]
    got = {r.s: r.byte_offset for r in d.string_table(spark.createDataFrame(rows, "kind_order int, idx bigint, pos int, k string, v string")).collect()}
    want, at = {}, 0
    for s in strings:
        if s not in want:
            want[s] = at
            at += len(s.encode()) + 1
    assert got == want


def test_ranks_of_sparse_and_dense_ids(spark):
    ids = [3, 4, 7, 8, 9, 10, 13, 2**33, 2**34, 63, 64, 65, 127] + [2**34 + 3 * i for i in range(1, 500)]
    df = spark.createDataFrame([(i,) for i in ids], "osm_id bigint")
    got = {r.osm_id: r["rank"] for r in d.bitmap_rank(df).collect()}
    assert got == {x: i for i, x in enumerate(sorted(ids))}
    assert {r.osm_id: r.n for r in dense_ids(df, ["osm_id"], "n", 3).collect()} == got


def test_gcd(spark):
    pairs = [(10**9, 100), (10**9, 7), (12, 18), (17, 17), (1, 10**9)]
    rows = spark.createDataFrame(pairs, "a bigint, b bigint").select(d.gcd(F.col("a"), F.col("b")).alias("g")).collect()
    assert sorted(r.g for r in rows) == sorted(math.gcd(*p) for p in pairs)


def test_ranges_and_running_sums(spark):
    parents = spark.createDataFrame([(i,) for i in range(5)], "idx bigint")
    children = spark.createDataFrame([(0,), (0,), (3,)], "idx bigint")
    assert [(r.idx, r["first"], r["last"]) for r in d.ranges(parents, children).orderBy("idx").collect()] == [(0, 0, 2), (1, 2, 2), (2, 2, 2), (3, 2, 3), (4, 3, 3)]
    assert d.ranges(parents.limit(0), children).count() == 0


def test_hot_keys_meet_a_broadcast_and_the_rest_a_shuffle(spark, monkeypatch):
    import tagloom.core as core

    monkeypatch.setattr(core, "BROADCAST_ROWS", 2)
    left = spark.createDataFrame([("hot", i) for i in range(200)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "key string, i int")
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(40)]], "key string, n int")
    assert hot_keys(left, "key") == ["hot"]
    for how, rows in (("inner", 240), ("left", 251)):
        out = lookup_join(left, right, "key", how)
        assert out.count() == rows and out.where("key = 'hot' and n = 1").count() == 200
