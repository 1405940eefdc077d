"""The map as flat tables: one row for each entity, tag, reference and member, without repeated rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.core import lookup_join
from tagloom.sources.tables import table

#: Fixed value: units of a degree in which positions are stored.
COORD_SCALE = 10_000_000


class MissingIds(ValueError):
    """The query is about original ids, which this dataset was stored without."""


class MapTables:
    """The tables of one folder. Rows delivered more than once count once; load times and versions don't make rows differ."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def _set(self, name: str, *columns: str) -> DataFrame:
        return table(self._spark, self._folder, name).select(*columns).distinct()

    def _entities(self, name: str, *columns: str) -> DataFrame:
        """One row an idx: rows of an entity differ in load times alone, and grouped by idx they need no shuffle for a join on it."""
        return table(self._spark, self._folder, name).select(*columns).dropDuplicates(["idx"])

    @cached_property
    def nodes(self) -> DataFrame:
        return self._entities("node", "idx", "osm_id", "lat", "lon")

    @cached_property
    def ways(self) -> DataFrame:
        return self._entities("way", "idx", "osm_id")

    @cached_property
    def relations(self) -> DataFrame:
        return self._entities("rel", "idx", "osm_id")

    @cached_property
    def node_tags(self) -> DataFrame:
        return self._set("node_tag", "idx", "pos", "k", "v")

    @cached_property
    def way_tags(self) -> DataFrame:
        return self._set("way_tag", "idx", "pos", "k", "v")

    @cached_property
    def relation_tags(self) -> DataFrame:
        return self._set("rel_tag", "idx", "pos", "k", "v")

    @cached_property
    def refs(self) -> DataFrame:
        return self._set("way_ref", "idx", "pos", "ref_osm_id", "node_idx")

    @cached_property
    def members(self) -> DataFrame:
        return self._set("rel_member", "idx", "pos", "mtype", "ref_osm_id", "ref_idx", "role")

    def entities(self) -> DataFrame:
        """kind, idx, osm_id of all three kinds."""
        out = None
        for kind, df in (("node", self.nodes), ("way", self.ways), ("relation", self.relations)):
            one = df.select(F.lit(kind).alias("kind"), "idx", "osm_id")
            out = one if out is None else out.unionByName(one)
        return out

    def positions(self) -> DataFrame:
        """node_idx, lat, lon of nodes in degrees; a node without both is no position."""
        return self.nodes.where("lat is not null and lon is not null").select(F.col("idx").alias("node_idx"), degrees("lat").alias("lat"), degrees("lon").alias("lon"))

    def like(self, name: str) -> DataFrame:
        """A table as delivered: what may be in its set of rows, cheap to read and to measure."""
        return table(self._spark, self._folder, name)

    def require_ids(self) -> None:
        """Raise MissingIds if original ids aren't known."""

    def located(self, refs: DataFrame) -> DataFrame:
        """refs (node_idx, ...) with lat and lon; NULL where node_idx leads to no position."""
        return lookup_join(refs, self.positions(), "node_idx", "left", self.like("way_ref").select("node_idx"), self.like("node").select("idx", "lat", "lon"))

    def resolved_refs(self) -> DataFrame:
        """References with found_idx, the position of the node that they name; NULL where there is none."""
        return resolve(self.refs, self.nodes, self.like("way_ref").select("ref_osm_id"), self.like("node").select("idx", "osm_id"))

    def resolved_members(self, mtype: str | None = None) -> DataFrame:
        """Members (of one type) with found_idx, the position of the entity that they name."""
        names = {"node": "node", "way": "way", "relation": "rel"}
        wanted = [mtype] if mtype else list(names)
        ids = self.entities().where(F.col("kind").isin(wanted))
        members = self.members if mtype is None else self.members.where(F.col("mtype") == mtype)
        every = None
        for kind in wanted:
            one = self.like(names[kind]).select(F.lit(kind).alias("kind"), "idx", "osm_id")
            every = one if every is None else every.unionByName(one)
        like = self.like("rel_member").select("mtype", "ref_osm_id")
        return resolve_members(members, ids, like if mtype is None else like.where(F.col("mtype") == mtype), every)


def degrees(column: str) -> Column:
    return F.col(column).cast("double") / F.lit(float(COORD_SCALE))


def first_tag(tags: DataFrame, condition: Column, prefix: str = "") -> DataFrame:
    """(idx, k, v, pos) of the first tag of each entity that meets the condition; the filter reaches the scan, one partial aggregate."""
    return (
        tags.where(condition).groupBy("idx").agg(F.min(F.struct("pos", "k", "v")).alias("t"))
        .select("idx", F.col("t.k").alias(f"{prefix}k"), F.col("t.v").alias(f"{prefix}v"), F.col("t.pos").alias(f"{prefix}pos"))
    )


def resolve(children: DataFrame, ids: DataFrame, children_like: DataFrame | None = None, ids_like: DataFrame | None = None) -> DataFrame:
    """children (ref_osm_id, ...) with idx of the entity of that id in ids (idx, osm_id), as found_idx; NULL where there is none.

    Much-used ids and NULLs are spread; for the others see lookup_join.
    """
    return lookup_join(children, ids.select(F.col("osm_id").alias("ref_osm_id"), F.col("idx").alias("found_idx")), "ref_osm_id", "left", children_like, ids_like)


def resolve_members(members: DataFrame, entities: DataFrame, members_like: DataFrame | None = None, entities_like: DataFrame | None = None) -> DataFrame:
    """members with found_idx; the target is told by type and id together, as ids of the three kinds overlap."""
    ids = entities.select(F.col("kind").alias("mtype"), F.col("osm_id").alias("ref_osm_id"), F.col("idx").alias("found_idx"))
    return lookup_join(members, ids, ["mtype", "ref_osm_id"], "left", members_like, entities_like)
