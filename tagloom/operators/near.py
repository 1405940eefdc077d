"""Points near other points: adaptive coverage of a disc by cells, equi-joins, exact tests on the rim alone.

The sphere is cut into bands of equal height and each band into cells of at least the same width, and cells into parts of
1 / FINE of their height. A point's disc is covered by the cells it can touch; coverage and points meet in an equi-join on the
cell. Points in a part wholly inside the disc are accepted at once; for parts that the rim crosses the exact distance is
tested. Where a cell holds many points, coverage and points are cut into parts before they meet, and parts outside the
disc drop out; elsewhere that would make more copies of a point than it saves tests.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.core import lookup_join, materialise
from tagloom.functions.geo import EARTH_RADIUS_M, haversine

#: A cell of more points than this is cut into FINE x FINE parts before the join: a disc touches about so many of them.
DENSE = 48
FINE = 16
#: Height of a cell in distances: larger cells mean fewer copies of each point, smaller ones fewer exact tests.
CELL = 5
#: Discs are covered a little larger, so that rounding never loses a pair.
_MARGIN = 1e-6


def _grid(lat: Column, lon: Column, step: float) -> tuple[Column, Column]:
    """Band and its number of cells: bands of `step` radians of latitude from the south pole, cells at least as wide."""
    band = F.floor((F.radians(lat) + math.pi / 2) / step)
    return band, _cells_of(band, step)


def _cells_of(band: Column, step: float) -> Column:
    """Cells of a band, at least 1: their width at the edge of the band nearer to a pole is step or more."""
    edge = F.greatest(F.abs(band * step - math.pi / 2), F.abs((band + 1) * step - math.pi / 2))
    return F.greatest(F.lit(1), F.floor(2 * math.pi * F.greatest(F.cos(edge), F.lit(0.0)) / step)).cast("bigint")


def _turn(lon: Column) -> Column:
    """Longitude as a share of a full turn, in [0, 1)."""
    share = lon / 360.0
    return share - F.floor(share)


def pairs_within(points: DataFrame, metres: float, id_col: str = "idx", lat_col: str = "lat", lon_col: str = "lon", scale: float = 1.0, dense: int = DENSE) -> DataFrame:
    """(id_a, id_b, metres), id_a < id_b: every two ids whose points lie within this great-circle distance.

    lat_col / scale and lon_col / scale are degrees. Points with a NULL id, lat or lon take no part. Repeated rows count
    once; an id at two places takes part at both and its pairs then come with the least distance. Two ids at the same
    place are a pair at 0 m; no id is paired with itself. The bound is inclusive; the date line and the poles are like
    any other place. An empty table gives an empty result. Further columns are ignored. A place of m points within reach
    of each other has m (m - 1) / 2 pairs in the result; there is no cap.
    """
    if not 0 < metres < 100_000:
        raise ValueError("metres must be between 0 and 100,000")
    step = CELL * metres / EARTH_RADIUS_M
    reach = metres / EARTH_RADIUS_M * (1 + _MARGIN)
    # positions travel as they are stored, which is often half as wide as degrees
    base = materialise(points.select(F.col(id_col).alias("id"), F.col(lat_col).alias("lat"), F.col(lon_col).alias("lon")).dropna().distinct(), "points")

    def deg(column: str) -> Column:
        return F.col(column) / F.lit(float(scale))

    band, cells = _grid(deg("lat"), deg("lon"), step)
    own = base.withColumn("band", band).withColumn("cell", F.least(F.floor(_turn(deg("lon")) * cells), cells - 1))

    # bands and cells that the disc of a point touches, each pair of cells from one side only
    phi = F.radians(deg("lat"))
    near_pole = F.abs(phi) + reach >= math.pi / 2
    half = F.when(near_pole, 0.5).otherwise(F.asin(F.least(F.lit(1.0), math.sin(reach) / F.cos(phi))) / (2 * math.pi))  # of a turn
    cover = (
        own.withColumn("half", half).withColumn("turn", _turn(deg("lon")))
        .withColumn("to", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.floor((phi - reach + math.pi / 2) / step)), F.floor((phi + reach + math.pi / 2) / step))))
        .withColumn("n", _cells_of(F.col("to"), step))
        .withColumn("first", F.floor((F.col("turn") - F.col("half")) * F.col("n")))
        .withColumn("last", F.least(F.floor((F.col("turn") + F.col("half")) * F.col("n")), F.col("first") + F.col("n") - 1))
        .withColumn("at", F.explode(F.sequence("first", "last")))
        .withColumn("at", F.pmod("at", "n"))
        .where((F.col("to") > F.col("band")) | ((F.col("to") == F.col("band")) & (F.col("at") >= F.col("cell"))))
        .select("id", "lat", "lon", (F.col("to") * (1 << 32) + F.col("at")).alias("key"), ((F.col("to") == F.col("band")) & (F.col("at") == F.col("cell"))).alias("same"))
    )
    there = own.select(F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), (F.col("band") * (1 << 32) + F.col("cell")).alias("key"))
    # there are few crowded cells, if any: knowing them before the joins leaves one join for most points, which can be split where it is skewed
    crowded = materialise(there.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > dense).select("key", F.lit(True).alias("crowded")), "crowded")
    cover = lookup_join(cover, crowded, "key", "left")
    there = lookup_join(there, crowded, "key", "left")

    once = F.when(F.col("same"), F.col("id") < F.col("id2")).otherwise(F.col("id") != F.col("id2"))
    # FINE x FINE parts of a cell
    to, at = F.shiftright("key", 32), F.col("key").bitwiseAND(0xFFFFFFFF)
    n = _cells_of(to, step)

    def part(lat: str, lon: str) -> tuple[Column, Column]:
        up = F.floor(((F.radians(deg(lat)) + math.pi / 2) / step - to) * FINE)
        along = F.floor((_turn(deg(lon)) * n - at) * FINE)
        return F.greatest(F.lit(0), F.least(F.lit(FINE - 1), up)), F.greatest(F.lit(0), F.least(F.lit(FINE - 1), along))

    up, along = part("lat2", "lon2")
    parted = (up * FINE + along).cast("int")
    i, j = F.floor(F.col("part") / FINE), F.col("part") % FINE
    south, north = (to + i / FINE) * step - math.pi / 2, (to + (i + 1) / FINE) * step - math.pi / 2
    west = (at + j / FINE) / n * 2 * math.pi
    wide = 2 * math.pi / (n * FINE)
    # distance in longitude from the point to the part's edges, the shorter way round
    here = _turn(deg("lon")) * 2 * math.pi
    mid = F.abs(here - (west + wide / 2))
    mid = F.least(mid, 2 * math.pi - mid)
    least_lon, most_lon = F.greatest(F.lit(0.0), mid - wide / 2), F.least(F.lit(math.pi), mid + wide / 2)
    least_lat = F.greatest(F.lit(0.0), south - phi, phi - north)
    most_lat = F.greatest(F.abs(south - phi), F.abs(north - phi))
    # hav(d) = hav(dlat) + cos cos hav(dlon), with the largest and smallest cosine in the part; hav(x) is at most x * x / 4
    big, small = F.greatest(F.cos(south), F.cos(north), F.when((south <= 0) & (north >= 0), 1.0).otherwise(0.0)), F.greatest(F.lit(0.0), F.least(F.cos(south), F.cos(north)))

    def hav(x: Column) -> Column:
        return F.pow(F.sin(x / 2), 2)

    nearest = hav(least_lat) + F.cos(phi) * small * hav(least_lon)
    farthest = (most_lat * most_lat + F.cos(phi) * big * most_lon * most_lon) / 4
    bound = math.sin(metres / EARTH_RADIUS_M / 2) ** 2
    # points sit in a part up to rounding: a part counts as inside or outside only by a margin
    inside = farthest <= bound * (1 - 1e-4)
    distance = haversine(deg("lat"), deg("lon"), deg("lat2"), deg("lon2"))
    # the usual cell: its few points are met as they are, and those in inner parts of the disc need no test. Here parts have
    # the same height and width in degrees; |x - floor(y) - 1/2| + 1/2 is the way to the further edge of y's part
    part_size = step / FINE
    ways = [F.abs(F.radians(deg(a)) / part_size - F.floor(F.radians(deg(b)) / part_size) - 0.5) + 0.5 for a, b in (("lat", "lat2"), ("lon", "lon2"))]
    across = F.cos(phi) * (F.cos(phi) + ways[0] * part_size)  # a cosine grows by no more than the angle
    inner = ways[0] * ways[0] + across * ways[1] * ways[1] <= 4 * bound * (1 - 1e-4) / part_size**2
    loose = (
        cover.where("crowded is null").drop("crowded").join(there.where("crowded is null").drop("crowded"), "key")
        .where(once).where(inner | (distance <= metres)).withColumn("metres", distance)
    )
    # crowded cells: parts outside drop out before the join
    fine_there = there.where("crowded").withColumn("part", parted).drop("crowded")
    fine_cover = (
        cover.where("crowded").drop("crowded")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(FINE * FINE - 1))))
        .where(nearest <= bound * (1 + 1e-4) + 1e-20)
        .withColumn("inside", inside)
    )
    tight = (
        fine_cover.join(fine_there, ["key", "part"])
        .where(once)
        .withColumn("metres", distance)
        .where(F.col("inside") | (F.col("metres") <= metres))
    )
    cols = [F.least("id", "id2").alias("id_a"), F.greatest("id", "id2").alias("id_b"), "metres"]
    return loose.select(*cols).unionByName(tight.select(*cols)).groupBy("id_a", "id_b").agg(F.min("metres").alias("metres"))
