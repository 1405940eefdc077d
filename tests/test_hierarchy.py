import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.operators.hierarchy import circle_descendants, descendants, hierarchy, paths, unfollowed

SCHEMA = "child bigint, parent bigint"


def brute(links):
    parent = {}
    for c, p in links:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for c in parent:
        node, steps, seen = c, 0, set()
        while node in parent and node not in seen:
            seen.add(node)
            node, steps = parent[node], steps + 1
        out[c] = (-1, -1) if node in parent else (node, steps)
    return out


def found(spark, links):
    """By rounds of several forests; one forest has to give the same."""
    df = spark.createDataFrame(links, SCHEMA)
    many, one = ({r.node: (r.root, r.depth) for r in hierarchy(df, local_links=n).collect()} for n in (7, 500_000))
    assert many == one
    return many


def test_deep_wide_and_circles(spark):
    chain = [(i, i + 1) for i in range(1, 300)]
    random.Random(1).shuffle(chain)
    wide = [(1000 + i, 300) for i in range(200)]
    circle = [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2000), (2004, 2003), (2010, 2010), (2011, 2010)]
    links = chain + wide + circle
    assert found(spark, links) == brute(links)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_any_links(spark, links):
    assert found(spark, links) == brute(links)


def test_scattered_ids_cross_partitions(spark):
    ids = random.Random(2).sample(range(10**12), 400)
    links = [(ids[i], ids[(i - 1) // 2]) for i in range(1, 400)]
    assert found(spark, links) == brute(links)


def test_nulls_repeats_empty_and_two_parents(spark):
    assert found(spark, [(1, 2), (1, 2), (None, 2), (3, None), (4, 9), (4, 7)]) == {1: (2, 1), 4: (7, 1)}
    assert found(spark, []) == {}


def test_further_columns(spark):
    df = spark.createDataFrame([(1, 2, 7, "x")], "child bigint, parent bigint, node bigint, top string")
    assert [(r.node, r.root, r.depth) for r in hierarchy(df).collect()] == [(1, 2, 1)]


def test_paths_and_descendants(spark):
    links = [(2, 1), (3, 2), (4, 3), (5, 3), (8, 9), (9, 8), (7, 9)]
    p = paths(spark.createDataFrame(links, SCHEMA)).cache()
    assert {r.node: r.path for r in p.collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 3, 4], 5: [1, 2, 3, 5], 7: None, 8: None, 9: None}
    assert {(r.ancestor, r.descendant, r.steps) for r in descendants(p).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 3), (2, 4, 2), (3, 4, 1), (1, 5, 3), (2, 5, 2), (3, 5, 1)}
    assert paths(spark.createDataFrame([], SCHEMA)).count() == 0


def under_circles(links):
    parent = {}
    for c, p in links:
        parent[c] = min(p, parent.get(c, p))
    out = set()
    for c in parent:
        trail, node = [], c
        while node in parent and parent[node] not in trail:
            node = parent[node]
            trail.append(node)
        if node in parent:
            out |= {(a, c, i) for i, a in enumerate(trail, 1)}
    return out


def around(spark, links):
    rows = [(r.ancestor, r.descendant, r.steps) for r in circle_descendants(spark.createDataFrame(links, SCHEMA)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_descendants_on_and_below_circles(spark):
    links = [(2, 1), (3, 2), (8, 9), (9, 8), (7, 9), (6, 7), (5, 6), (20, 20), (21, 20), (32, 31), (31, 30), (30, 34), (34, 33), (33, 32), (40, 33), (41, 40)]
    found_ = around(spark, links)
    assert {(9, 7, 1), (8, 7, 2), (7, 6, 1), (7, 5, 2), (6, 5, 1), (9, 8, 1), (8, 8, 2), (20, 20, 1), (20, 21, 1)} <= found_
    assert found_ == under_circles(links)
    assert around(spark, []) == around(spark, [(2, 1), (3, 2)]) == set()


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=30))
def test_descendants_of_any_links(spark, links):
    assert around(spark, links) == under_circles(links)


def test_paths_by_rounds_and_by_one_worker(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100 + i, 20) for i in range(30)] + [(200, 201), (201, 200), (202, 201), (None, 1), (3, None)]
    df = spark.createDataFrame(links, SCHEMA)
    many, one = ({r.node: (r.root, r.depth, r.path) for r in paths(df, local_links=n).collect()} for n in (9, 500_000))
    assert many == one and one[1] == (40, 39, list(range(40, 0, -1))) and one[202] == (-1, -1, None) and one[40] == (40, 0, [40])


def test_links_to_second_parents_are_reported(spark):
    links = [(1, 5), (1, 5), (1, 7), (1, 6), (2, 5), (3, None), (None, 3)]
    assert {tuple(r) for r in unfollowed(spark.createDataFrame(links, SCHEMA)).collect()} == {(1, 6), (1, 7)}
