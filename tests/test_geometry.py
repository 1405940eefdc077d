import numpy as np
import pytest

from tagloom.operators.geometry import pixels, segments
from tagloom.sources.render import png


def line(x0, y0, x1, y1):
    """Bresenham's error-term form, without the last pixel."""
    out, dx, dy = [], abs(x1 - x0), -abs(y1 - y0)
    sx, sy, err = (1 if x0 < x1 else -1), (1 if y0 < y1 else -1), abs(x1 - x0) - abs(y1 - y0)
    while (x0, y0) != (x1, y1):
        out.append((x0, y0))
        twice = 2 * err
        if twice >= dy:
            err, x0 = err + dy, x0 + sx
        if twice <= dx:
            err, y0 = err + dx, y0 + sy
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pixels_like_bresenham(spark, seed):
    rng = np.random.default_rng(seed)
    lines = [[(float(a), float(o)) for a, o in rng.integers(0, 60, (4, 2))] for _ in range(12)] + [[(0.0, 0.0), (60.0, 60.0)]]
    rows = [(i, p, a, o) for i, l in enumerate(lines) for p, (a, o) in enumerate(l)]
    df = spark.createDataFrame(rows, "idx bigint, pos int, lat double, lon double")
    width = 61
    lats, lons = [r[2] for r in rows], [r[3] for r in rows]
    height = int(width * ((max(lats) - min(lats)) / (max(lons) - min(lons)) / np.cos(max(lats) / 180 * np.pi)))

    def at(a, o):
        return int((o - min(lons)) * (width - 1) / (max(lons) - min(lons))), int((max(lats) - a) * (height - 1) / (max(lats) - min(lats)))

    want = {p for l in lines for s, e in zip(l, l[1:]) for p in line(*at(*s), *at(*e))}
    assert {(r.x, r.y) for r in pixels(df, width).collect()} == want


def test_degenerate(spark):
    schema = "idx bigint, pos int, lat double, lon double"
    assert pixels(spark.createDataFrame([], schema), 10).count() == 0
    assert pixels(spark.createDataFrame([(1, 0, 5.0, 5.0), (1, 1, 5.0, 5.0)], schema), 10).count() == 0
    assert segments(spark.createDataFrame([(1, 0, 5.0, 5.0)], schema)).count() == 0


def test_png():
    data = png(np.array([[0, 255], [255, 0]], np.uint8))
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and data[16:24] == (2).to_bytes(4, "big") * 2
