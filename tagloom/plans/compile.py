"""From a .osm.pbf file to a dataset: decode, number, resolve, store, check, count."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.core import dense_ids, materialise, scope
from tagloom.operators.maps import resolve, resolve_members
from tagloom.sources.dataset import MapDataset, nest
from tagloom.sources.pbf import PARTITION_BYTES, PbfError, read_pbf

NANO = 1_000_000_000


def block_index(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """block_type, granularity, blob_start, blob_len of every block, nodes before ways before relations, then by granularity and place."""
    kind = F.when(F.col("block_type") == "nodes", 0).when(F.col("block_type") == "ways", 1).otherwise(2)
    return read_pbf(spark, path, "blocks", partition_bytes).orderBy(kind, "granularity", "blob_start", "blob_len")


def _numbered(rows: DataFrame, entity: str) -> DataFrame:
    """rows with idx, the rank of osm_id; whole rows delivered twice count once, different rows of one id are an error."""
    rows = rows.withColumn("_row", F.xxhash64(*rows.columns))
    once = materialise(rows.dropDuplicates(["osm_id", "_row"]).drop("_row"), entity)
    if twice := once.groupBy("osm_id").count().where("count > 1").limit(1).collect():
        raise PbfError(f"{entity} has different entities of the id {twice[0].osm_id}")
    return dense_ids(once, ["osm_id"], "idx")


def compile_pbf(spark: SparkSession, source: str, target: str, ids: bool = False, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Write the dataset of a file into the folder target and return one row of counts.

    Entities are numbered by the rank of their id, whatever the order of blocks; repeated rows count once, and different
    entities of one kind and id are an error. The
    file must have exactly one header. Positions are stored in the largest unit that all blocks' granularities and a
    degree share. Without ids the original ids aren't stored. The dataset is read again before the counts are given.
    """
    with scope(spark):
        return _compile(spark, source, target, ids, partition_bytes)


def _compile(spark: SparkSession, source: str, target: str, ids: bool, partition_bytes: int) -> DataFrame:
    headers = read_pbf(spark, source, "header").limit(2).collect()
    if len(headers) != 1:
        raise PbfError(f"{source} has {'no header' if not headers else 'more than one header'}")
    h = headers[0]
    # the index is read once, a row for each block; each entity then opens its own blocks alone
    index = read_pbf(spark, source, "index", partition_bytes).collect()
    of = {e: [(r.path, r.blob_start, r.blob_len) for r in index if e in r.kinds] for e in ("nodes", "ways", "relations")}
    unit = math.gcd(NANO, *{r.granularity for r in index if "nodes" in r.kinds})

    def scaled(name: str):
        return F.expr(f"cast({name} div {unit} as int)")

    box = [getattr(h, f"bbox_{side}") for side in ("left", "right", "top", "bottom")]
    header = spark.createDataFrame(
        [(NANO // unit, *(None if x is None else int(x / unit) for x in box), h.writingprogram, h.source, h.replication_timestamp, h.replication_sequence_number, h.replication_base_url)],
        "coord_scale int, bbox_left int, bbox_right int, bbox_top int, bbox_bottom int, writingprogram string, source string, replication_timestamp bigint, replication_sequence_number bigint, replication_base_url string",
    )
    entities = {e: _numbered(read_pbf(spark, source, e, partition_bytes, of[e]), e) for e in of}
    nodes = entities["nodes"].select("idx", "osm_id", scaled("lat_nano").alias("lat"), scaled("lon_nano").alias("lon"), "tags")
    refs = materialise(resolve(entities["ways"].select("idx", F.posexplode("refs").alias("pos", "ref_osm_id")), nodes), "refs")
    ways = nest(entities["ways"].select("idx", "osm_id", "tags"), refs.select("idx", "pos", F.col("ref_osm_id").alias("osm_id"), F.col("found_idx").alias("to")), "refs", ["osm_id", "to"])
    every = None
    for kind, e in (("node", "nodes"), ("way", "ways"), ("relation", "relations")):
        one = entities[e].select(F.lit(kind).alias("kind"), "idx", "osm_id")
        every = one if every is None else every.unionByName(one)
    exploded = entities["relations"].select("idx", F.posexplode("members").alias("pos", "m")).select("idx", "pos", F.col("m.type").alias("mtype"), F.col("m.osm_id").alias("ref_osm_id"), F.col("m.role").alias("role"))
    members = materialise(resolve_members(exploded, every), "members")
    relations = nest(
        entities["relations"].select("idx", "osm_id", "tags"),
        members.select("idx", "pos", F.col("mtype").alias("type"), F.col("ref_osm_id").alias("osm_id"), F.col("found_idx").alias("to"), "role"), "members", ["type", "osm_id", "to", "role"],
    )
    data = MapDataset(
        header, nodes, ways.withColumn("refs", F.col("refs").cast("array<struct<osm_id: bigint, idx: bigint>>")),
        relations.withColumn("members", F.col("members").cast("array<struct<type: string, osm_id: bigint, idx: bigint, role: string>>")),
    )
    data.save(target, ids)
    stored = MapDataset.open(spark, target)
    counts = {e: getattr(stored, e).count() for e in ("nodes", "ways", "relations")}
    lost = {r.mtype: r["count"] for r in members.where("found_idx is null").groupBy("mtype").count().collect()}
    lost_refs = refs.where("found_idx is null").count()
    return spark.createDataFrame(
        [(*counts.values(), lost_refs + lost.get("node", 0), lost.get("way", 0), lost.get("relation", 0))],
        "nodes bigint, ways bigint, relations bigint, unresolved_nodes bigint, unresolved_ways bigint, unresolved_relations bigint",
    )
