"""Ways as lines: coordinates, segments, lengths, pixels, classified features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.geo import haversine
from tagloom.functions.tags import NOT_DRIVABLE, is_lake, is_park, parse_unsigned, relation_category
from tagloom.operators.maps import MapTables, first_tag


def drivable(m: MapTables) -> DataFrame:
    """idx of ways with any highway tag that is not on the deny list."""
    return m.way_tags.where((F.col("k") == "highway") & ~F.col("v").isin(*NOT_DRIVABLE)).select("idx").distinct()


def located_refs(m: MapTables, ways: DataFrame | None = None) -> DataFrame:
    """idx, pos, lat, lon of every reference of these ways (all by default); lat and lon NULL where it leads nowhere.

    Ways are filtered before the join with nodes, which carries only positions.
    """
    refs = m.refs if ways is None else m.refs.join(ways.select("idx"), "idx", "left_semi")
    return m.located(refs.select("idx", "pos", "node_idx")).select("idx", "pos", "lat", "lon")


def whole_lines(m: MapTables, ways: DataFrame | None = None) -> DataFrame:
    """located_refs of the ways all of whose references lead to a position."""
    w = Window.partitionBy("idx")
    return located_refs(m, ways).withColumn("_bad", F.count_if(F.col("lat").isNull()).over(w)).where("_bad = 0").drop("_bad")


def segments(points: DataFrame) -> DataFrame:
    """idx, pos, lat, lon, lat2, lon2: each point of a line with the next one; the last has none."""
    w = Window.partitionBy("idx").orderBy("pos")
    nexts = F.lead(F.struct("lat", "lon")).over(w)
    return points.withColumn("_n", nexts).where("_n is not null").select("idx", "pos", "lat", "lon", F.col("_n.lat").alias("lat2"), F.col("_n.lon").alias("lon2"))


def lengths(m: MapTables) -> DataFrame:
    """idx, metres of every way with a highway tag: NULL if a segment has an end without position; 0 without segments."""
    ways = m.way_tags.where("k = 'highway'").select("idx").distinct()
    steps = segments(located_refs(m, ways)).withColumn("d", haversine("lat", "lon", "lat2", "lon2"))
    per = steps.groupBy("idx").agg(F.sum("d").alias("d"), F.count_if(F.col("d").isNull()).alias("bad"))
    return ways.join(per, "idx", "left").select("idx", F.when(F.coalesce("bad", F.lit(0)) > 0, None).otherwise(F.coalesce("d", F.lit(0.0))).alias("metres"))


def bounds(points: DataFrame) -> DataFrame:
    """One row: least and greatest lat and lon; 0 without points."""
    return points.agg(*[F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")])


def raster_size(width: int, min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    """Height in pixels for this width, truncated; 0 where the points have no extent in longitude."""
    ratio = (max_lat - min_lat) / F.nullif(max_lon - min_lon, F.lit(0.0)) / F.cos(max_lat / 180.0 * math.pi)
    return F.coalesce((F.lit(float(width)) * ratio).cast("bigint"), F.lit(0).cast("bigint"))


def pixels(points: DataFrame, width: int) -> DataFrame:
    """x, y of every black pixel of the lines (idx, pos, lat, lon) drawn `width` pixels wide, each once.

    Lines are drawn segment by segment without the segment's last pixel; the i-th pixel follows from i in closed form.
    """
    b = F.broadcast(bounds(points))  # one row
    height = raster_size(width, F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"))

    def x(lon: str) -> Column:
        return F.coalesce(((F.col(lon) - F.col("min_lon")) * float(width - 1) / F.nullif(F.col("max_lon") - F.col("min_lon"), F.lit(0.0))).cast("bigint"), F.lit(0).cast("bigint"))

    def y(lat: str) -> Column:
        return F.coalesce(((F.col("max_lat") - F.col(lat)) * (F.col("height") - 1).cast("double") / F.nullif(F.col("max_lat") - F.col("min_lat"), F.lit(0.0))).cast("bigint"), F.lit(0).cast("bigint"))

    cut = segments(points).crossJoin(b).withColumn("height", height).select(x("lon").alias("x0"), y("lat").alias("y0"), x("lon2").alias("x1"), y("lat2").alias("y1")).distinct()
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    sx, sy = F.signum(F.col("x1") - F.col("x0")).cast("bigint"), F.signum(F.col("y1") - F.col("y0")).cast("bigint")
    drawn = (
        cut.withColumn("n", F.greatest(dx, dy)).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
        .withColumn("minor", F.floor((2 * F.col("i") * F.least(dx, dy) + F.col("n")) / (2 * F.col("n"))))
    )
    steep = dy > dx
    return drawn.select(
        (F.col("x0") + sx * F.when(steep, F.col("minor")).otherwise(F.col("i"))).alias("x"), (F.col("y0") + sy * F.when(steep, F.col("i")).otherwise(F.col("minor"))).alias("y")
    ).distinct()


def classify_ways(m: MapTables) -> DataFrame:
    """idx, category, width of roads and rivers among ways of at least 3 references."""

    def first(*keys: str) -> Column:
        return F.min(F.when(F.col("k").isin(*keys), F.struct("pos", "k", "v")))

    tags = m.way_tags.where(F.col("k").isin("highway", "waterway", "width", "maxwidth")).groupBy("idx").agg(first("highway", "waterway").alias("t"), first("width", "maxwidth").alias("w"))
    long_ = m.refs.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("idx")
    width = F.when(F.col("w").isNull(), F.lit(1).cast("bigint")).otherwise(parse_unsigned(F.col("w.v"), 2**32 - 1))
    road = (F.col("t.k") == "highway") & ~F.coalesce(F.col("t.v").isin(*NOT_DRIVABLE), F.lit(False))
    category = F.when(road, "road").when((F.col("t.k") == "waterway") & width.isNotNull(), "river")
    named = tags.where("t is not null").select("idx", category.alias("category"), width.alias("width")).where("category is not null")
    return named.join(long_, "idx", "left_semi").select("idx", "category", F.when(F.col("category") == "river", F.col("width")).alias("width"))


def classify_relations(m: MapTables) -> DataFrame:
    """idx, category of parks and waters."""
    k, v = F.col("k"), F.col("v")
    kind = F.when((k == "type") & (v == "multipolygon"), "m").when(is_park(k, v), "p").when(is_lake(k, v), "l")
    marked = m.relation_tags.withColumn("kind", kind).where("kind is not null")
    # tags of one relation that say what it is
    places = marked.groupBy("idx").agg(*[F.array_sort(F.collect_set(F.when(F.col("kind") == x, F.col("pos")))).alias(x) for x in "mpl"]).where("size(m) > 0")
    first = {x: F.try_element_at(x, F.lit(1)) for x in "mpl"}
    after = [F.try_element_at(F.filter(x, lambda p: p > F.try_element_at("m", F.lit(1))), F.lit(1)) for x in "pl"]
    return places.select("idx", relation_category(first["m"], first["p"], first["l"], *after).alias("category")).where("category is not null")


def rings(m: MapTables, relations: DataFrame, roles: tuple[str, ...] = ("outer",)) -> DataFrame:
    """rel_idx, member_pos, pos, lat, lon and the further columns of relations (idx, ...): their outlines, in order of members and references,
    from the member ways with these roles.

    Relations with an unresolved outer way or a reference without position are left out; those without outer ways have no
    rows. Only the references of outer ways are looked up.
    """
    more = [c for c in relations.columns if c != "idx"]
    outer = m.members.where((F.col("mtype") == "way") & F.col("role").isin(*roles)).join(relations, "idx").select(F.col("idx").alias("rel_idx"), F.col("pos").alias("member_pos"), F.col("ref_idx").alias("idx"), *more)
    lines = outer.join(located_refs(m, outer.where("idx is not null").select("idx").distinct()), "idx", "left")
    bad = F.count_if(F.expr("idx is null or (pos is not null and lat is null)")).over(Window.partitionBy("rel_idx"))
    return lines.withColumn("_bad", bad).where("_bad = 0 and pos is not null").select("rel_idx", "member_pos", "pos", "lat", "lon", *more)


def features(m: MapTables) -> DataFrame:
    """kind, idx, category, width: classified ways, then relations."""
    return classify_ways(m).select(F.lit("way").alias("kind"), "idx", "category", "width").unionByName(
        classify_relations(m).select(F.lit("relation").alias("kind"), "idx", "category", F.lit(None).cast("bigint").alias("width"))
    )


def feature_points(m: MapTables) -> DataFrame:
    """kind, idx, category, width, part, pos, lat, lon of every feature that can be drawn and has points."""
    ways = classify_ways(m)
    way_lines = whole_lines(m, ways).join(ways, "idx").select(F.lit("way").alias("kind"), "idx", "category", "width", F.lit(0).alias("part"), "pos", "lat", "lon")
    outlines = rings(m, classify_relations(m)).withColumnRenamed("rel_idx", "idx")
    return way_lines.unionByName(outlines.select(F.lit("relation").alias("kind"), "idx", "category", F.lit(None).cast("bigint").alias("width"), F.col("member_pos").alias("part"), "pos", "lat", "lon"))


def river_width(m: MapTables) -> DataFrame:
    """One row: width of the last river that is drawn; it holds for the whole group. A river without references can't be."""
    rivers = classify_ways(m).where("category = 'river'")
    return whole_lines(m, rivers).select("idx").distinct().join(rivers, "idx").agg(F.max_by("width", "idx").alias("width"))
