import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.functions.geo import EARTH_RADIUS_M
from tagloom.operators.near import pairs_within

SCHEMA = "idx bigint, lat double, lon double"


def distance(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


def brute(points, metres):
    return {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and distance(a[1], a[2], b[1], b[2]) <= metres}


def found(spark, points, metres, **more):
    return {(r.id_a, r.id_b) for r in pairs_within(spark.createDataFrame(points, SCHEMA), metres, **more).collect()}


@pytest.mark.parametrize(("lat", "lon", "spread", "metres"), [(10, 20, 2e-3, 25), (89.9995, 0, 5e-4, 25), (-89.9999, 10, 3e-4, 25), (60, 179.9995, 1.5e-3, 25), (0, 0, 1e-3, 40), (47, -180, 0.5, 9000)])
@pytest.mark.parametrize("dense", [1, 48])
def test_against_brute_force(spark, lat, lon, spread, metres, dense):
    rng = np.random.default_rng(3)
    lats = np.clip(lat + rng.normal(0, spread / 2, 150), -90, 90)
    lons = lon + rng.normal(0, spread / 2, 150) * (1 if abs(lat) < 80 else 1e5)
    points = [(i, float(a), float((o + 180) % 360 - 180)) for i, (a, o) in enumerate(zip(lats, lons, strict=True))]
    assert found(spark, points, metres, dense=dense) == brute(points, metres)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(-90, 90), st.floats(-180, 180)), max_size=12), st.floats(1, 90_000))
def test_anywhere(spark, places, metres):
    points = [(i, a, o) for i, (a, o) in enumerate(places)] + [(100 + i, max(-90.0, a - 1e-4), o) for i, (a, o) in enumerate(places)]
    got, want = found(spark, points, metres, dense=2), brute(points, metres)
    at = {p[0]: p for p in points}
    # pairs at the very bound may fall either way by rounding
    assert all(abs(distance(*at[a][1:], *at[b][1:]) - metres) < 1e-6 for a, b in got ^ want)


def test_nulls_repeats_and_same_place(spark):
    rows = [(1, 5.0, 5.0), (1, 5.0, 5.0), (2, 5.0, 5.0), (3, None, 5.0), (4, 5.0, None), (None, 5.0, 5.0), (5, 6.0, 5.0), (6, None, None)]
    out = pairs_within(spark.createDataFrame(rows, SCHEMA), 10).collect()
    assert [(r.id_a, r.id_b, r.metres) for r in out] == [(1, 2, 0.0)]


def test_id_at_two_places(spark):
    rows = [(1, 5.0, 5.0), (1, 5.00001, 5.0), (2, 5.00002, 5.0)]
    (r,) = pairs_within(spark.createDataFrame(rows, SCHEMA), 10).collect()
    assert (r.id_a, r.id_b) == (1, 2) and r.metres == pytest.approx(distance(5.00001, 5, 5.00002, 5))


def test_empty_and_further_columns(spark):
    assert found(spark, [], 10) == set()
    df = spark.createDataFrame([(1, 5.0, 5.0, 1, "x", 3), (2, 5.0, 5.0, 2, "y", 4)], SCHEMA + ", id int, key string, band int")
    assert pairs_within(df, 10).count() == 1


def test_crowd_in_one_place(spark):
    rows = [(i, 5.0 + (i % 3) * 1e-7, 5.0) for i in range(120)]
    assert found(spark, rows, 25) == {(a, b) for a in range(120) for b in range(a + 1, 120)}


def test_bound_must_be_sane(spark):
    with pytest.raises(ValueError, match="metres"):
        pairs_within(spark.createDataFrame([], SCHEMA), 0)
