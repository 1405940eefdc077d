"""Points in regions: adaptive coverage of polygons by cells, equi-joins, exact tests in boundary cells alone.

Each region gets a square grid of its own fineness, by its extent and its number of edges. Cells that no edge touches lie
wholly inside or outside; those inside accept their points at once. In a cell that edges touch, a point is inside or
not as the cell's centre is, turned round by every edge of that cell on the way from the centre to the point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.core import fits_broadcast, lookup_join, materialise

#: Cells along a side of a region: at least and at most, in between twice the root of its number of edges.
LEAST_SIDE, MOST_SIDE = 16, 1024
#: Part of a cell by which grids are shifted, so that no stored position lies on the centre lines of cells.
_SHIFT = 0.4142135623730951
#: Edges nearer to a cell than this part of it touch it.
_MARGIN = 1e-6


def _edges(outlines: DataFrame) -> DataFrame:
    """region, x1, y1, x2, y2 of closed rings: each point with the next one, the last with the first."""
    w = Window.partitionBy("region", "ring").orderBy("pos")
    nexts = F.coalesce(F.lead(F.struct("lat", "lon")).over(w), F.first(F.struct("lat", "lon")).over(w))
    edges = outlines.withColumn("_n", nexts).select("region", F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("_n.lon").alias("x2"), F.col("_n.lat").alias("y2"))
    return edges.where("x1 <> x2 or y1 <> y2")


def points_in_regions(points: DataFrame, outlines: DataFrame, id_col: str = "idx", lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """(region, id): the regions that each point lies in, by the even-odd rule over all edges of a region's rings.

    points has id_col and degrees; outlines region, ring, pos, lat, lon. A ring is closed from its last point to its first, so
    ways that make a ring together may be rings of their own: the closing edges of their ends cancel out. Edges are
    straight in degrees; none goes over the date line. A point on an edge lies in the region to its east or north. NULL
    ids, positions or regions take no part, repeated rows count once, rings of fewer than three points hold nothing.
    Empty tables give an empty result. Further columns are ignored.
    """
    lines = outlines.select("region", "ring", "pos", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropna(subset=["region", "lat", "lon"]).distinct()
    edges = materialise(_edges(lines), "edges")
    least, most = "least({0}1, {0}2)", "greatest({0}1, {0}2)"
    boxes = edges.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(f"{f}({e.format(c)})").alias(f"{f}_{c}") for c in "xy" for f, e in (("min", least), ("max", most))]
    ).withColumn("extent", F.expr("greatest(max_x - min_x, max_y - min_y)")).where("extent > 0")
    side = f"least({MOST_SIDE}, greatest({LEAST_SIDE}, ceil(2 * sqrt(n))))"
    boxes = materialise(boxes.withColumn("level", F.expr(f"cast(floor(log2({side} / extent)) as int)")).withColumn("s", F.expr("power(2D, -level)")), "boxes")
    levels = [r.level for r in boxes.select("level").distinct().collect()]  # as many as there are powers of two between extents

    def cell(value: str) -> str:
        return f"cast(floor(({value}) / s + {_SHIFT}) as bigint)"

    def at(edge: str) -> str:
        return f"(x1 + (x2 - x1) * ({edge} - y1) / nullif(y2 - y1, 0D))"

    rows = (
        lookup_join(edges, boxes.select("region", "level", "s"), "region", "inner", edges.select("region"))
        .withColumn("y", F.explode(F.expr(f"sequence({cell(f'{least.format("y")} - s * {_MARGIN}')}, {cell(f'{most.format("y")} + s * {_MARGIN}')})")))
        .withColumn("low", F.expr(f"greatest({least.format('y')}, (y - {_SHIFT} - {_MARGIN}) * s)"))
        .withColumn("high", F.expr(f"least({most.format('y')}, (y + 1 - {_SHIFT} + {_MARGIN}) * s)"))
        .withColumn("cy", F.expr(f"(y + 0.5D - {_SHIFT}) * s"))
    )
    ends = [F.expr(f"if(y1 = y2, x{i + 1}, {at(e)})").alias(f"e{i}") for i, e in enumerate(("low", "high"))]
    touched = rows.select("region", "level", "s", "y", "x1", "y1", "x2", "y2", *ends).withColumn(
        "x", F.explode(F.expr(f"sequence({cell(f'least(e0, e1) - s * {_MARGIN}')}, {cell(f'greatest(e0, e1) + s * {_MARGIN}')})"))
    )
    touched = materialise(touched.select("region", "level", "s", "y", "x", "x1", "y1", "x2", "y2"), "touched")

    # which cells have their centre inside: edges that cross the middle of the row further east, one sum a row
    crossings = rows.where("(y1 > cy) <> (y2 > cy)").withColumn("xc", F.expr(at("cy"))).withColumn("x", F.expr(cell("xc")))
    crossings = crossings.groupBy("region", "y", "x").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.expr(f"xc > (x + 0.5D - {_SHIFT}) * s")).alias("east"))
    grid = boxes.withColumn("y", F.explode(F.expr(f"sequence({cell('min_y')}, {cell('max_y')})"))).withColumn("x", F.explode(F.expr(f"sequence({cell('min_x')}, {cell('max_x')})")))
    edge_cells = touched.select("region", "level", "s", "y", "x").distinct().withColumn("touched", F.lit(True))
    cells = grid.select("region", "level", "s", "y", "x").join(edge_cells, ["region", "level", "s", "y", "x"], "full").join(crossings, ["region", "y", "x"], "left")
    further = F.sum(F.coalesce("all", F.lit(0))).over(Window.partitionBy("region", "y").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1))
    inside = (F.coalesce(further, F.lit(0)) + F.coalesce("east", F.lit(0))) % 2 == 1
    cells = cells.withColumn("inside", inside).withColumn("touched", F.coalesce("touched", F.lit(False))).where("inside or touched").select("region", "level", "y", "x", "inside", "touched")
    cells = materialise(cells, "cells")

    plain = points.select(F.col(id_col).alias("id"), F.col(lat_col).cast("double").alias("lat"), F.col(lon_col).cast("double").alias("lon")).dropna().distinct()
    placed = plain.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.expr("cast(array() as array<int>)"))).withColumn("s", F.expr("power(2D, -level)"))
    placed = placed.withColumn("y", F.expr(cell("lat"))).withColumn("x", F.expr(cell("lon"))).drop("s")
    met = placed.join(F.broadcast(cells) if fits_broadcast(cells) else cells, ["level", "y", "x"])
    accepted = met.where("not touched").select("region", "id")

    # from the centre of the cell north or south to the point's latitude, then east or west to the point
    near = met.where("touched").join(touched.drop("level"), ["region", "y", "x"]).withColumn("cx", F.expr(f"(x + 0.5D - {_SHIFT}) * s")).withColumn("cy", F.expr(f"(y + 0.5D - {_SHIFT}) * s"))
    up = "((x1 > cx) <> (x2 > cx) and ((y1 + (y2 - y1) * (cx - x1) / nullif(x2 - x1, 0D)) > cy) <> ((y1 + (y2 - y1) * (cx - x1) / nullif(x2 - x1, 0D)) > lat))"
    across = f"((y1 > lat) <> (y2 > lat) and (lon < {at('lat')}) <> (cx < {at('lat')}))"
    turns = near.groupBy("region", "id", "lat", "lon").agg(F.sum(F.expr(f"int({up}) + int({across})")).alias("turns"), F.first("inside").alias("inside"))
    tested = turns.where("inside <> (turns % 2 = 1)").select("region", "id")
    return accepted.unionByName(tested).distinct()
