"""A map as a folder of Parquet tables with nested tags, references and members."""

from __future__ import annotations

import os
import tarfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.core import keep, lookup_join, shared_dir
from tagloom.operators.maps import COORD_SCALE, MapTables, MissingIds

_TAGS = "tags array<struct<k: string, v: string>>"
SCHEMAS = {
    "header": "coord_scale int, bbox_left int, bbox_right int, bbox_top int, bbox_bottom int, writingprogram string, source string, replication_timestamp bigint, "
    "replication_sequence_number bigint, replication_base_url string",
    "nodes": f"idx bigint, osm_id bigint, lat int, lon int, {_TAGS}",
    "ways": f"idx bigint, osm_id bigint, {_TAGS}, refs array<struct<osm_id: bigint, idx: bigint>>",
    "relations": f"idx bigint, osm_id bigint, {_TAGS}, members array<struct<type: string, osm_id: bigint, idx: bigint, role: string>>",
}


class SchemaMismatch(ValueError):
    """A stored table isn't what this version reads."""


def _struct(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def _without_ids(df: DataFrame, name: str) -> DataFrame:
    none = F.lit(None).cast("bigint")
    df = df.withColumn("osm_id", none)
    for column in ("refs", "members"):
        if column in df.columns:
            df = df.withColumn(column, F.transform(column, lambda x: x.withField("osm_id", none)))
    return df


@dataclass
class MapDataset:
    """header (one row), nodes, ways and relations; entities own their tags, references and members as ordered arrays.

    idx is the dense position of an entity of its kind, in the order of ids; NULL in a reference or member means that it
    leads out of the collection. osm_id is NULL where ids weren't kept.
    """

    header: DataFrame
    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> MapDataset:
        """Read what save() wrote, or a tar of it (unpacked into the shared folder); a table with other columns or types raises SchemaMismatch."""
        tables = {}
        if path.endswith(".tar"):
            path = _unpacked(spark, path)
        for name, schema in SCHEMAS.items():
            want = _struct(schema)
            have = spark.read.parquet(f"{path}/{name}").schema
            if have.simpleString() != want.simpleString():
                raise SchemaMismatch(f"{path}/{name}: {have.simpleString()} instead of {want.simpleString()}")
            tables[name] = spark.read.schema(want).parquet(f"{path}/{name}")
        return cls(**tables)

    def save(self, path: str, ids: bool = True, mode: str = "errorifexists") -> None:
        """Write all tables, each sorted by idx so that a lookup reads few row groups; without ids their columns are NULL, in references and members too."""
        for name in SCHEMAS:
            df = getattr(self, name)
            if name != "header":
                if not ids:
                    df = _without_ids(df, name)
                df = df.repartitionByRange("idx").sortWithinPartitions("idx")
            df.to(_struct(SCHEMAS[name])).write.mode(mode).parquet(f"{path}/{name}")

    def header_view(self) -> DataFrame:
        """The header with its box in degrees and the time of replication as a timestamp."""
        sides = [(F.col(f"bbox_{s}").cast("double") / F.col("coord_scale")).alias(s) for s in ("left", "right", "top", "bottom")]
        return self.header.select(*sides, "writingprogram", "source", F.timestamp_seconds("replication_timestamp").alias("replication_time"), "replication_sequence_number", "replication_base_url")

    def has_ids(self) -> bool:
        """Whether original ids were stored; true for an empty dataset."""
        return all(df.isEmpty() or not df.where("osm_id is not null").isEmpty() for df in (self.nodes, self.ways, self.relations))

    def node_tags(self) -> DataFrame:
        return explode_tags(self.nodes)

    def way_tags(self) -> DataFrame:
        return explode_tags(self.ways)

    def relation_tags(self) -> DataFrame:
        return explode_tags(self.relations)

    def way_refs(self) -> DataFrame:
        return self.ways.select("idx", F.posexplode("refs").alias("pos", "r")).select("idx", "pos", F.col("r.osm_id").alias("ref_osm_id"), F.col("r.idx").alias("node_idx"))

    def relation_members(self) -> DataFrame:
        exploded = self.relations.select("idx", F.posexplode("members").alias("pos", "m"))
        return exploded.select("idx", "pos", F.col("m.type").alias("mtype"), F.col("m.osm_id").alias("ref_osm_id"), F.col("m.idx").alias("ref_idx"), F.col("m.role").alias("role"))

    def tables(self) -> MapTables:
        """The flat tables of this dataset, on which every query of plans.queries.MAP_QUERIES runs."""
        return DatasetTables(self)


class DatasetTables(MapTables):
    """MapTables over a stored dataset, whose rows are unique already: no query needs a shuffle for that.

    References and members lead to the positions that were stored with them; ids play no part in that.
    """

    def __init__(self, data: MapDataset):
        self._data = data

    def require_ids(self) -> None:
        if not self._data.has_ids():
            raise MissingIds("this dataset was stored without original ids")

    def located(self, refs: DataFrame) -> DataFrame:
        return lookup_join(refs, self.positions(), "node_idx", "left", self.refs.select("node_idx"), self.nodes.select("idx", "lat", "lon"))

    def resolved_refs(self) -> DataFrame:
        return self.refs.withColumn("found_idx", F.col("node_idx"))

    def resolved_members(self, mtype: str | None = None) -> DataFrame:
        members = self.members if mtype is None else self.members.where(F.col("mtype") == mtype)
        return members.withColumn("found_idx", F.col("ref_idx"))

    @property
    def nodes(self) -> DataFrame:
        return self._data.nodes.drop("tags")

    @property
    def ways(self) -> DataFrame:
        return self._data.ways.select("idx", "osm_id")

    @property
    def relations(self) -> DataFrame:
        return self._data.relations.select("idx", "osm_id")

    @property
    def node_tags(self) -> DataFrame:
        return self._data.node_tags()

    @property
    def way_tags(self) -> DataFrame:
        return self._data.way_tags()

    @property
    def relation_tags(self) -> DataFrame:
        return self._data.relation_tags()

    @property
    def refs(self) -> DataFrame:
        return self._data.way_refs()

    @property
    def members(self) -> DataFrame:
        return self._data.relation_members()


def _unpacked(spark: SparkSession, path: str) -> str:
    """The folder, in the shared one, of the dataset in a tar, whatever folder of the tar it is in; files are copied one by one, in pieces."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = f"{shared_dir(spark)}/tagloom-tar-{uuid.uuid4().hex}"
    keep(spark, target)
    fs, root = jvm.org.apache.hadoop.fs.Path(target).getFileSystem(conf), ""
    with tarfile.open(path.removeprefix("file:")) as tar:
        for member in tar:
            name = os.path.normpath(member.name)
            if not member.isfile() or name.startswith(("..", "/")) or os.path.basename(name).startswith((".", "_")):
                continue
            above, found, _ = f"/{name}".partition("/header/")
            root = above if found else root
            source, out = tar.extractfile(member), fs.create(jvm.org.apache.hadoop.fs.Path(f"{target}/{name}"))
            try:
                while piece := source.read(4 << 20):
                    out.write(piece)
            finally:
                out.close()
    return target + root


def explode_tags(entities: DataFrame) -> DataFrame:
    return entities.select("idx", F.posexplode("tags").alias("pos", "t")).select("idx", "pos", "t.k", "t.v")


def nest(parents: DataFrame, children: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """parents (idx, ...) with the rows of children (idx, pos, ...) as an array of their fields in the order of pos; an empty one where there are none."""
    item = F.struct(F.col("pos").alias("_pos"), F.struct(*fields).alias("_item"))
    # sorted by pos, then by content where two rows share one
    lists = children.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_item"]).alias(name))
    kind = lists.schema[name].dataType.simpleString()
    return parents.join(lists, "idx", "left").withColumn(name, F.coalesce(name, F.expr(f"cast(array() as {kind})")))


def from_tables(m: MapTables) -> MapDataset:
    """A dataset of the flat tables; repeated rows go, order stays, references and members are resolved by id."""
    header = m.nodes.agg(
        F.lit(COORD_SCALE).alias("coord_scale"), F.min("lon").alias("bbox_left"), F.max("lon").alias("bbox_right"), F.max("lat").alias("bbox_top"), F.min("lat").alias("bbox_bottom"),
        F.lit("tagloom").alias("writingprogram"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("bigint").alias("replication_timestamp"),
        F.lit(None).cast("bigint").alias("replication_sequence_number"), F.lit(None).cast("string").alias("replication_base_url"),
    )
    nodes = nest(m.nodes, m.node_tags, "tags", ["k", "v"]).select("idx", "osm_id", "lat", "lon", "tags")
    refs = m.resolved_refs().select("idx", "pos", F.col("ref_osm_id").alias("osm_id"), F.col("found_idx").alias("to"))
    ways = nest(nest(m.ways, m.way_tags, "tags", ["k", "v"]), refs, "refs", ["osm_id", "to"])
    members = m.resolved_members().select("idx", "pos", F.col("mtype").alias("type"), F.col("ref_osm_id").alias("osm_id"), F.col("found_idx").alias("to"), "role")
    relations = nest(nest(m.relations, m.relation_tags, "tags", ["k", "v"]), members, "members", ["type", "osm_id", "to", "role"])
    return MapDataset(
        header, nodes,
        ways.withColumn("refs", F.col("refs").cast("array<struct<osm_id: bigint, idx: bigint>>")),
        relations.withColumn("members", F.col("members").cast("array<struct<type: string, osm_id: bigint, idx: bigint, role: string>>")),
    )
