"""The named queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.core import dense_ids
from tagloom.functions.tags import NOT_DRIVABLE, parse_unsigned
from tagloom.operators import dictionary, geometry
from tagloom.operators.hierarchy import circle_descendants, descendants, hierarchy, paths, unfollowed
from tagloom.operators.maps import COORD_SCALE, MapTables, degrees, first_tag
from tagloom.operators.near import pairs_within
from tagloom.operators.regions import points_in_regions
from tagloom.operators.units import COMMON, LEAST, read_units
from tagloom.operators.wide import texts_of, widen
from tagloom.sources.tables import table, tag_rows


def p4_values(spark: SparkSession, folder: str) -> DataFrame:
    return read_units(table(spark, folder, "node_tag"), table(spark, folder, "source_unit"))[0]


def p4_sources(spark: SparkSession, folder: str) -> DataFrame:
    return read_units(table(spark, folder, "node_tag"), table(spark, folder, "source_unit"))[1]


def p4_withheld(spark: SparkSession, folder: str) -> DataFrame:
    """What the graph finds for the declared sources of 20 values or more, without knowing any declaration."""
    declared = table(spark, folder, "source_unit")
    found = read_units(table(spark, folder, "node_tag"), declared.limit(0))[1].drop("declared")
    known = declared.where("source_name is not null and k is not null").groupBy(F.col("source_name").alias("source"), "k").agg(F.min("unit").alias("declared"))
    return found.where(f"n >= {LEAST}").join(known, ["k", "source"]).select("k", "source", "declared", "estimated")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values in another than the common unit, by the graph. An exact check follows: where no value and no declaration names
    a unit the problem takes the common one, so that a source's estimate alone is no case (p4_values has it)."""
    common = [f"(k = '{k}' and unit = '{u}')" for k, u in COMMON.items()]
    return p4_values(spark, folder).where(f"unit is not null and how <> 'estimated' and not ({' or '.join(common)})").select("idx", "pos", "unit")


def relation_links(spark: SparkSession, folder: str) -> DataFrame:
    """(child, parent) positions of relations in relations, by original id."""
    of = table(spark, folder, "rel").select("idx", "osm_id").distinct()
    member = table(spark, folder, "rel_member").where("mtype = 'relation'").select(F.col("idx").alias("parent"), F.col("ref_osm_id").alias("osm_id")).distinct()
    return member.join(of, "osm_id").select(F.col("idx").alias("child"), "parent")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy(relation_links(spark, folder)).select(F.col("node").alias("idx"), F.col("root").alias("root_idx"), "depth")


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every relation: its root, depth and path; relations that neither have nor are a member are roots of their own."""
    of = paths(relation_links(spark, folder))
    every = table(spark, folder, "rel").select(F.col("idx").alias("node")).dropna().distinct()
    alone = every.join(of.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.array("node").alias("path"))
    return of.unionByName(alone).select(F.col("node").alias("idx"), F.col("root").alias("root_idx"), "depth", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Of relations that hang from a root; p5_circle_descendants has the others."""
    return descendants(paths(relation_links(spark, folder)))


def p5_circle_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Of relations on circles and below them; no row is in p5_descendants too."""
    return circle_descendants(relation_links(spark, folder))


def p5_unfollowed(spark: SparkSession, folder: str) -> DataFrame:
    """Links to second parents, which no tree of p5_found has."""
    return unfollowed(relation_links(spark, folder)).select(F.col("child").alias("idx"), F.col("parent").alias("parent_idx"))


def p6_wide(spark: SparkSession, folder: str) -> DataFrame:
    return widen(tag_rows(spark, folder), table(spark, folder, "attr_type"), report_keyless=True)


def p6_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of p6_wide as a row again, whether it stands in a column or in the map."""
    return texts_of(p6_wide(spark, folder))


def p6_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Only the columns that attr_type names."""
    return widen(tag_rows(spark, folder), table(spark, folder, "attr_type"), None).drop("other", "issues")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    issues = F.filter("issues", lambda x: x.k.isNotNull() & x.issue.isin("conflict", "unfit"))
    return p6_wide(spark, folder).select("kind", "idx", F.explode(F.array_distinct(F.transform(issues, lambda x: F.struct(x.k.alias("k"), x.issue.alias("issue"))))).alias("i")).select("kind", "idx", "i.k", "i.issue")


def p7_near(spark: SparkSession, folder: str) -> DataFrame:
    near = pairs_within(table(spark, folder, "node"), 25.0, scale=1e7)
    return near.select(F.col("id_a").alias("idx_a"), F.col("id_b").alias("idx_b"), F.round("metres", 3).alias("metres"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_near(spark, folder).select("idx_a", "idx_b")


def p7_regions(spark: SparkSession, folder: str) -> DataFrame:
    """For every node position the parks and waters whose outlines, without what lies in inner ones, hold it."""
    m = MapTables(spark, folder)
    outlines = geometry.rings(m, geometry.classify_relations(m).select("idx"), ("outer", "inner"))
    held = points_in_regions(m.positions(), outlines.select(F.col("rel_idx").alias("region"), F.col("member_pos").alias("ring"), "pos", "lat", "lon"), "node_idx")
    return held.select(F.col("region").alias("rel_idx"), F.col("id").alias("idx"))


Maps = Callable[[MapTables], DataFrame]


def _needs_ids(f: Maps) -> Maps:
    """f, with MissingIds instead of wrong rows on a dataset that was stored without ids."""

    def run(m: MapTables) -> DataFrame:
        m.require_ids()
        return f(m)

    run.__doc__ = f.__doc__
    return run


def _on(f: Maps) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return f(MapTables(spark, folder))

    run.__doc__ = f.__doc__
    return run


def entity_counts(m: MapTables) -> DataFrame:
    return m.entities().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def scan_ways(m: MapTables) -> DataFrame:
    sizes = m.refs.groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    return m.ways.join(sizes, "idx", "left").select("idx", "osm_id", F.coalesce("n", F.lit(0)).alias("n_refs"))


def scan_relations(m: MapTables) -> DataFrame:
    sizes = m.members.groupBy("idx").agg(F.count(F.lit(1)).alias("n"))
    return m.relations.join(sizes, "idx", "left").select("idx", "osm_id", F.coalesce("n", F.lit(0)).alias("n_members"))


def point_lookup(m: MapTables) -> DataFrame:
    """Random access to a few positions; the filter reaches the scan."""
    return m.nodes.where(F.col("idx").isin(0, 7, 100, 999)).select("idx", "lat", "lon")


def header_summary(m: MapTables) -> DataFrame:
    return m.nodes.agg(F.lit(COORD_SCALE).alias("coord_scale"), F.min("lon").alias("bbox_left"), F.max("lon").alias("bbox_right"), F.max("lat").alias("bbox_top"), F.min("lat").alias("bbox_bottom"))


def node_degrees(m: MapTables) -> DataFrame:
    return m.nodes.select("idx", F.round(degrees("lat"), 7).alias("lat_deg"), F.round(degrees("lon"), 7).alias("lon_deg"))


def find_tag_name(m: MapTables) -> DataFrame:
    return first_tag(m.node_tags, F.col("k") == "name").select("idx", F.col("v").alias("name"))


def has_tag_first_key(m: MapTables) -> DataFrame:
    first = first_tag(m.node_tags, F.col("k") == "amenity")
    return m.nodes.select("idx").join(first, "idx", "left").select("idx", F.coalesce(F.col("v") == "pub", F.lit(False)).alias("is_pub"))


def find_tag_by_drivable(m: MapTables) -> DataFrame:
    return first_tag(m.way_tags, (F.col("k") == "highway") & ~F.col("v").isin(*NOT_DRIVABLE)).select("idx", "v")


def highway_ways(m: MapTables) -> DataFrame:
    return m.way_tags.where("k = 'highway'").select("idx").distinct()


def semi_join_tagged(m: MapTables) -> DataFrame:
    return m.nodes.join(m.node_tags, "idx", "left_semi").select("idx")


def unresolved_refs(m: MapTables) -> DataFrame:
    return m.refs.join(m.nodes.select(F.col("osm_id").alias("ref_osm_id")), "ref_osm_id", "left_anti").select("idx", "pos", "ref_osm_id")


def cities(m: MapTables, most: int = 2**63 - 1) -> DataFrame:
    """Nodes whose first place is city, with a name and a population that is a plain number up to `most`: a BIGINT, or with
    2 ** 64 - 1, as the command line has it, a DECIMAL."""
    keys = ("place", "name", "population")
    first = [F.min(F.when(F.col("k") == k, F.struct("pos", "v"))).getField("v").alias(k) for k in keys]
    cities_ = m.node_tags.where(F.col("k").isin(*keys)).groupBy("idx").agg(*first).where("place = 'city'")
    return cities_.select("idx", "name", parse_unsigned(F.col("population"), most).alias("population")).where("is_valid_utf8(name) and population is not null")


def _pubs(m: MapTables) -> DataFrame:
    out = None
    for kind, tags in (("node", m.node_tags), ("way", m.way_tags)):
        one = first_tag(tags, F.col("k") == "amenity").where("v = 'pub'").select(F.lit(kind).alias("kind"), "idx")
        out = one if out is None else out.unionByName(one)
    return out


def _tags_of(m: MapTables) -> DataFrame:
    return m.node_tags.withColumn("kind", F.lit("node")).unionByName(m.way_tags.withColumn("kind", F.lit("way")))


def pub_names(m: MapTables) -> DataFrame:
    names = _tags_of(m).where("k = 'name'").groupBy("kind", "idx").agg(F.min(F.struct("pos", "v")).getField("v").alias("v"))
    shown = F.when(F.col("v").isNull(), "unknown pub name").when(F.is_valid_utf8("v"), F.col("v")).otherwise("broken pub name")
    return _pubs(m).join(names, ["kind", "idx"], "left").select("kind", "idx", shown.alias("name"))


def pub_addresses(m: MapTables) -> DataFrame:
    return _tags_of(m).where("startswith(k, 'addr:') and is_valid_utf8(k) and coalesce(is_valid_utf8(v), true)").join(_pubs(m), ["kind", "idx"], "left_semi").select("kind", "idx", "pos", "k", "v")


def way_refs_resolved(m: MapTables) -> DataFrame:
    return m.resolved_refs().select("idx", "pos", F.col("found_idx").alias("node_idx"))


def member_resolution(m: MapTables) -> DataFrame:
    return m.resolved_members().select(F.col("idx").alias("rel_idx"), "pos", "mtype", F.col("found_idx").alias("idx"), "role")


def members_by_type(m: MapTables) -> DataFrame:
    return m.resolved_members().groupBy("mtype").agg(F.count(F.lit(1)).alias("n"), F.count("found_idx").alias("resolved"))


def compile_stats(m: MapTables) -> DataFrame:
    """One row: entities, and ids that lead nowhere, by kind."""
    counts = m.entities().groupBy().pivot("kind", ["node", "way", "relation"]).agg(F.count(F.lit(1)))
    lost = m.resolved_members().where("found_idx is null").groupBy().pivot("mtype", ["node", "way", "relation"]).agg(F.count(F.lit(1)))
    refs = m.resolved_refs().agg(F.count_if(F.col("found_idx").isNull()).alias("r"))
    zero = F.lit(0).cast("bigint")
    return (
        counts.select(*[F.coalesce(k, zero).alias(n) for k, n in (("node", "nodes"), ("way", "ways"), ("relation", "relations"))])
        .crossJoin(lost.select(*[F.coalesce(k, zero).alias(n) for k, n in (("node", "_n"), ("way", "unresolved_ways"), ("relation", "unresolved_relations"))]))
        .crossJoin(refs)  # one row each
        .select("nodes", "ways", "relations", (F.col("_n") + F.col("r")).alias("unresolved_nodes"), "unresolved_ways", "unresolved_relations")
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("lat", F.round("lat", 7)).withColumn("lon", F.round("lon", 7))


def way_coords(m: MapTables) -> DataFrame:
    return _rounded(geometry.whole_lines(m)).withColumnRenamed("idx", "way_idx")


def road_segments(m: MapTables) -> DataFrame:
    steps = geometry.segments(geometry.whole_lines(m, highway_ways(m)))
    return steps.select(F.col("idx").alias("way_idx"), "pos", F.round(geometry.haversine("lat", "lon", "lat2", "lon2"), 3).alias("metres"))


def road_length_per_way(m: MapTables) -> DataFrame:
    return geometry.lengths(m).where("metres is not null").select(F.col("idx").alias("way_idx"), F.round("metres", 3).alias("metres"))


def road_length_total(m: MapTables) -> DataFrame:
    return geometry.lengths(m).agg(F.count("metres").alias("ways"), F.round(F.coalesce(F.sum("metres"), F.lit(0.0)) / 1000, 3).alias("km"))


def roads_bounds(m: MapTables) -> DataFrame:
    return geometry.bounds(geometry.whole_lines(m, geometry.drivable(m))).select(*[F.round(c, 7).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


RASTER_WIDTH = 4320


def raster_transform(m: MapTables) -> DataFrame:
    b = geometry.bounds(geometry.whole_lines(m, geometry.drivable(m)))
    return b.select(F.lit(RASTER_WIDTH).alias("width"), geometry.raster_size(RASTER_WIDTH, *(F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon"))).alias("height"))


def raster_pixels(m: MapTables) -> DataFrame:
    return geometry.pixels(geometry.whole_lines(m, geometry.drivable(m)), RASTER_WIDTH)


def multipolygon_rings(m: MapTables) -> DataFrame:
    return _rounded(geometry.rings(m, geometry.classify_relations(m).select("idx")))


def multipolygon_sizes(m: MapTables) -> DataFrame:
    """Every classified relation that can be drawn and how many points it has; 0 where it has no outer way."""
    rels = geometry.classify_relations(m).select("idx")
    outer = m.members.where("mtype = 'way' and role = 'outer'").join(rels, "idx", "left_semi").select("idx").distinct()
    drawn = geometry.rings(m, rels).groupBy(F.col("rel_idx").alias("idx")).agg(F.count(F.lit(1)).alias("points"))
    return drawn.unionByName(rels.join(outer, "idx", "left_anti").select("idx", F.lit(0).cast("bigint").alias("points"))).withColumnRenamed("idx", "rel_idx")


def feature_polylines(m: MapTables) -> DataFrame:
    return _rounded(geometry.feature_points(m))


def feature_extent(m: MapTables) -> DataFrame:
    return geometry.bounds(geometry.feature_points(m)).select(*[F.round(c, 7).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


def svg_transform(m: MapTables) -> DataFrame:
    """What scales and shifts degrees into a drawing of 800 x 600."""
    b = geometry.bounds(geometry.feature_points(m))
    zero = F.lit(0.0)
    return b.select(
        F.round(800.0 / F.nullif(F.col("max_lon") - F.col("min_lon"), zero), 5).alias("scale_x"), F.round(600.0 / F.nullif(F.col("min_lat") - F.col("max_lat"), zero), 5).alias("scale_y"),
        F.round(-F.col("min_lon"), 5).alias("shift_x"), F.round(-F.col("max_lat"), 5).alias("shift_y"),
    )


def _text(tags: DataFrame) -> DataFrame:
    """idx and the tags as one text in their order; NULL as the empty text."""
    one = F.concat(F.coalesce("k", F.lit("")), F.lit("="), F.coalesce("v", F.lit("")))
    return tags.select("idx", F.struct("pos", one.alias("t")).alias("t")).groupBy("idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x.t), ";").alias("tags"))


DEBUG_ROWS, DEBUG_RELATIONS = 1000, 3


def debug_nodes(m: MapTables) -> DataFrame:
    first = m.nodes.where(F.col("idx") < DEBUG_ROWS)
    return first.join(_text(m.node_tags.where(F.col("idx") < DEBUG_ROWS)), "idx", "left").select("idx", "osm_id", F.round(degrees("lat"), 7).alias("lat"), F.round(degrees("lon"), 7).alias("lon"), F.coalesce("tags", F.lit("")).alias("tags"))


def debug_ways(m: MapTables) -> DataFrame:
    inside = F.col("idx") < DEBUG_ROWS
    shown = F.coalesce(F.col("node_idx").cast("string"), F.lit("-"))
    refs = m.refs.where(inside).groupBy("idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("n")))), lambda x: x.n), ",").alias("nodes"))
    return m.ways.where(inside).join(_text(m.way_tags.where(inside)), "idx", "left").join(refs, "idx", "left").select("idx", "osm_id", F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("nodes", F.lit("")).alias("nodes"))


def debug_relations(m: MapTables) -> DataFrame:
    inside = F.col("idx") < DEBUG_RELATIONS
    shown = F.concat(F.coalesce("mtype", F.lit("")), F.lit(":"), F.coalesce(F.col("ref_idx").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("role", F.lit("")))
    members = m.members.where(inside).groupBy("idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("n")))), lambda x: x.n), ",").alias("members"))
    return m.relations.where(inside).join(_text(m.relation_tags.where(inside)), "idx", "left").join(members, "idx", "left").select("idx", "osm_id", F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("members", F.lit("")).alias("members"))


def id_to_idx(m: MapTables) -> DataFrame:
    """Dense positions from ids: the rank of each node id."""
    return dense_ids(m.nodes.select("osm_id").distinct(), ["osm_id"], "rank").select("osm_id", "rank")


def unsorted_ids(m: MapTables) -> DataFrame:
    """Nodes that ids and positions put in different places; none, if ids rise with positions."""
    by_id = dense_ids(m.nodes.select("idx", "osm_id"), ["osm_id", "idx"], "by_id")
    by_idx = dense_ids(m.nodes.select("idx", "osm_id"), ["idx", "osm_id"], "by_idx")
    return by_id.join(by_idx, ["idx", "osm_id"]).where("by_id <> by_idx").select("idx", "osm_id")


BLOCK_BITS = 12


def _ordered_tags(m: MapTables) -> DataFrame:
    out = None
    for i, tags in enumerate((m.node_tags, m.way_tags, m.relation_tags)):
        one = tags.withColumn("kind_order", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def delta_decode(m: MapTables) -> DataFrame:
    """References as differences to the one before, and back by a running sum."""
    w = Window.partitionBy("idx").orderBy("pos")
    coded = m.refs.select("idx", "pos", (F.col("ref_osm_id") - F.lag("ref_osm_id", 1, 0).over(w)).alias("delta"))
    return coded.select(F.col("idx").alias("way_idx"), "pos", "delta", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ref_osm_id"))


def i40_roundtrip(m: MapTables) -> DataFrame:
    packed = dictionary.pack40(F.col("osm_id"))
    return m.nodes.select("osm_id", *[p.alias(f"b{i}") for i, p in enumerate(packed)], dictionary.unpack40(packed).alias("value"))


def granularity_gcd(m: MapTables) -> DataFrame:
    """Common divisor of block granularities; the blocks here are the ways' numbers of references, in hundreds."""
    sizes = m.refs.groupBy("idx").agg((F.count(F.lit(1)) * 100).alias("g")).select("g").distinct()
    return dictionary.gcd_of(sizes, "g", 1_000_000_000)


def block_order(m: MapTables) -> DataFrame:
    """Blocks of 8,000 ids of one kind in the order in which they are read."""
    kind = F.when(F.col("kind") == "node", 0).when(F.col("kind") == "way", 1).otherwise(2)
    blocks = m.entities().groupBy(kind.alias("kind_order"), F.floor(F.col("idx") / 8000).alias("block")).agg(F.min("osm_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return dense_ids(blocks, ["kind_order", "block"], "place").select("place", "kind_order", "block", "first_id", "n")


MAP_QUERIES: dict[str, Maps] = {
    "road_length_total": road_length_total,
    "entity_counts": entity_counts,
    "scan_nodes": lambda m: m.nodes,
    "scan_ways": scan_ways,
    "scan_relations": scan_relations,
    "point_lookup": point_lookup,
    "header_summary": header_summary,
    "node_degrees": node_degrees,
    "node_tags_exploded": lambda m: m.node_tags,
    "way_tags_exploded": lambda m: m.way_tags,
    "find_tag_name": find_tag_name,
    "has_tag_first_key": has_tag_first_key,
    "find_tag_by_drivable": find_tag_by_drivable,
    "highway_ways": highway_ways,
    "drivable_roads": geometry.drivable,
    "classify_ways": geometry.classify_ways,
    "semi_join_tagged": semi_join_tagged,
    "unresolved_refs": _needs_ids(unresolved_refs),
    "cities": cities,
    "pub_names": pub_names,
    "pub_addresses": pub_addresses,
    "way_refs_resolved": way_refs_resolved,
    "compile_stats": compile_stats,
    "member_resolution": member_resolution,
    "relation_self_join": lambda m: m.resolved_members("relation").select(F.col("idx").alias("rel_idx"), "pos", F.col("found_idx").alias("member_idx")),
    "members_by_type": members_by_type,
    "way_coords": way_coords,
    "road_segments": road_segments,
    "road_length_per_way": road_length_per_way,
    "roads_bounds": roads_bounds,
    "raster_transform": raster_transform,
    "raster_pixels": raster_pixels,
    "classify_relations": geometry.classify_relations,
    "classified_features": geometry.features,
    "multipolygon_rings": multipolygon_rings,
    "multipolygon_sizes": multipolygon_sizes,
    "feature_polylines": feature_polylines,
    "feature_extent": feature_extent,
    "svg_transform": svg_transform,
    "river_group_width": geometry.river_width,
    "debug_nodes": debug_nodes,
    "debug_ways": debug_ways,
    "debug_relations": debug_relations,
    "ids_join": _needs_ids(lambda m: m.entities()),
    "id_to_idx": _needs_ids(id_to_idx),
    "unsorted_ids": _needs_ids(unsorted_ids),
    "id_block_offsets": _needs_ids(lambda m: dictionary.block_offsets(m.nodes, BLOCK_BITS)),
    "bitmap_rank": _needs_ids(lambda m: dictionary.bitmap_rank(m.nodes)),
    "tag_dictionary": lambda m: dictionary.tag_dictionary(_ordered_tags(m)),
    "string_table": lambda m: dictionary.string_table(_ordered_tags(m)),
    "tag_ranges": lambda m: dictionary.ranges(m.nodes, m.node_tags),
    "delta_decode": _needs_ids(delta_decode),
    "i40_roundtrip": _needs_ids(i40_roundtrip),
    "granularity_gcd": granularity_gcd,
    "block_order": _needs_ids(block_order),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _on(f) for name, f in MAP_QUERIES.items()} | {
    "p4_found": p4_found,
    "p4_values": p4_values,
    "p4_sources": p4_sources,
    "p4_withheld": p4_withheld,
    "p5_found": p5_found,
    "p5_paths": p5_paths,
    "p5_descendants": p5_descendants,
    "p5_circle_descendants": p5_circle_descendants,
    "p5_unfollowed": p5_unfollowed,
    "p6_found": p6_found,
    "p6_wide": p6_wide,
    "p6_texts": p6_texts,
    "p6_typed": p6_typed,
    "p7_found": p7_found,
    "p7_near": p7_near,
    "p7_regions": p7_regions,
}
