"""Drawings: pixels and lines come from Spark, the driver only encodes the file."""

from __future__ import annotations

import struct
import zlib
from xml.sax.saxutils import quoteattr

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tagloom.core import materialise, scope
from tagloom.operators import geometry
from tagloom.operators.maps import MapTables

#: Groups of a drawing in their order, and how they look.
STYLES = {
    "road": {"stroke": "#001F3F", "stroke-width": "0.3", "fill": "none"},
    "river": {"stroke": "#0074D9", "fill": "none", "stroke-opacity": "0.8"},
    "water": {"stroke": "#0074D9", "fill": "#0074D9", "fill-opacity": "0.3"},
    "park": {"stroke": "#3D9970", "fill": "#3D9970", "fill-opacity": "0.3"},
}


def png(image: np.ndarray) -> bytes:
    """An 8-bit greyscale PNG of this array of bytes."""
    height, width = image.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = image
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def draw_roads(m: MapTables, path: str, width: int = 4320) -> tuple[int, int]:
    """Write the drivable roads, black on white, as a PNG of this width; the height follows from the extent.

    What goes to the driver is bounded by the size of the image: each black pixel once, packed into rows of bits.
    """
    lines = geometry.whole_lines(m, geometry.drivable(m))
    size = geometry.bounds(lines).select(geometry.raster_size(width, *(F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon"))).alias("h")).first()
    height = max(1, size.h)
    image = np.full((height, width), 255, np.uint8)
    words = geometry.pixels(lines, width).groupBy("y", F.shiftright("x", 5).alias("w")).agg(F.sum(F.expr("shiftleft(1L, cast(x & 31 as int))")).alias("bits"))
    for batch in words.toLocalIterator():
        for i in range(32):
            if batch.bits >> i & 1 and batch.w * 32 + i < width and 0 <= batch.y < height:
                image[batch.y, batch.w * 32 + i] = 0
    with open(path, "wb") as f:
        f.write(png(image))
    return width, height


def point_text(points: DataFrame) -> DataFrame:
    """kind, idx, category, width, points: each feature's "lon,lat " pairs with five decimals, in order."""
    one = F.struct("part", "pos", F.format_string("%.5f,%.5f ", "lon", "lat").alias("t"))
    return points.groupBy("kind", "idx", "category", "width").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.t), "").alias("points"))


def draw_features(m: MapTables, path: str, width: int = 800, height: int = 600) -> int:
    """Write classified features as an SVG; returns how many were drawn. Lines are streamed to the file one by one."""
    with scope(m.nodes.sparkSession):
        points = materialise(geometry.feature_points(m), "points")
        b = geometry.bounds(points).first()
        river = points.where("category = 'river'").agg(F.max_by("width", "idx").alias("width")).first().width
        lines = materialise(point_text(points), "lines")
        return _svg(lines, path, width, height, b, river)


def _svg(lines: DataFrame, path: str, width: int, height: int, b: Row, river: int | None) -> int:
    across, up = b.max_lon - b.min_lon, b.min_lat - b.max_lat
    scale = (width / across if across else 1.0, height / up if up else 1.0)
    drawn = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">\n<style>polyline {{ vector-effect: non-scaling-stroke; }}</style>\n')
        f.write(f'<g transform="scale({scale[0]:.5f} {scale[1]:.5f}) translate({-b.min_lon:.5f} {-b.max_lat:.5f})">\n')
        for category, style in STYLES.items():
            if category == "river" and river is not None:
                style = style | {"stroke-width": str(river)}
            f.write("<g " + " ".join(f"{k}={quoteattr(v)}" for k, v in style.items()) + ">\n")
            for row in lines.where(F.col("category") == category).orderBy("kind", "idx").toLocalIterator():
                f.write(f'<polyline points="{row.points}"/>\n')
                drawn += 1
            f.write("</g>\n")
        f.write(f'</g>\n<text x="{max(0, width - 10)}" y="{max(0, height - 10)}" text-anchor="end">© OpenStreetMap Contributors</text>\n</svg>\n')
    return drawn
