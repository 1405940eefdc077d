import numpy as np
import pytest

from tagloom.operators.regions import points_in_regions

POINTS, OUTLINES = "idx bigint, lat double, lon double", "region bigint, ring int, pos int, lat double, lon double"


def brute(points, outlines):
    out, rings = set(), {}
    for region, ring, pos, lat, lon in sorted(set(outlines)):
        rings.setdefault((region, ring), []).append((lat, lon))
    for i, lat, lon in points:
        for region in {r for r, _ in rings}:
            odd = False
            for (r, _), ring in rings.items():
                for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
                    if r == region and (y1 > lat) != (y2 > lat) and lon < x1 + (x2 - x1) * (lat - y1) / (y2 - y1):
                        odd = not odd
            if odd:
                out.add((region, i))
    return out


def found(spark, points, outlines):
    return {tuple(r) for r in points_in_regions(spark.createDataFrame(points, POINTS), spark.createDataFrame(outlines, OUTLINES)).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_ray_casting(spark, seed):
    """Stars, holes, crossing rings and rings of two ways, of many sizes; their corners are points too."""
    rng = np.random.default_rng(seed)
    outlines = []
    for region in range(8):
        y, x, size = rng.uniform(-60, 60), rng.uniform(-170, 170), 10.0 ** rng.uniform(-4, 1)
        for ring in range(int(rng.integers(1, 4))):
            n = int(rng.integers(3, 60))
            turn = np.sort(rng.uniform(0, 2 * np.pi, n)) if region % 2 else rng.uniform(0, 2 * np.pi, n)
            far = rng.uniform(0.2, 1, n) * size
            outlines += [(region, ring, p, round(float(y + f * np.sin(t)), 7), round(float(x + f * np.cos(t)), 7)) for p, (t, f) in enumerate(zip(turn, far, strict=True))]
    half = [(20, 0, 0, 0.0, 0.0), (20, 0, 1, 0.0, 2.0), (20, 0, 2, 2.0, 2.0), (20, 1, 0, 2.0, 2.0), (20, 1, 1, 2.0, 0.0), (20, 1, 2, 0.0, 0.0)]
    outlines += half
    points = [(i, lat, lon) for i, (*_, lat, lon) in enumerate(outlines)]
    for i in range(900):
        *_, lat, lon = outlines[int(rng.integers(len(outlines)))]
        points.append((1000 + i, round(float(lat + rng.normal(0, 10.0 ** rng.uniform(-5, 0))), 7), round(float(lon + rng.normal(0, 10.0 ** rng.uniform(-5, 0))), 7)))
    points += [(5000, 1.5, 0.5), (5001, 1.0, 1.0), (5002, 3.0, 1.0)]
    want = brute(points, outlines)
    assert found(spark, points, outlines) == want and {(20, 5000), (20, 5001)} <= want and len(want) > 200


def test_nulls_repeats_and_empty_tables(spark):
    square = [(1, 0, i, y, x) for i, (y, x) in enumerate([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)])]
    odd = [(None, 0, 0, 0.0, 0.0), (2, 0, 0, 0.5, 0.5), (3, 0, 0, 0.0, 0.0), (3, 0, 1, 1.0, 1.0), (1, 0, 9, None, 0.5)]
    points = [(1, 0.5, 0.5), (1, 0.5, 0.5), (2, 2.0, 0.5), (None, 0.5, 0.5), (3, None, 0.5), (4, 0.5, None)]
    assert found(spark, points, square * 2 + odd) == {(1, 1)}
    assert found(spark, [], square) == set() and found(spark, points, []) == set()
