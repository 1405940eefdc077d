"""Reading the map and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG_TABLES = {"node": "node_tag", "way": "way_tag", "relation": "rel_tag"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tag_rows(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("node", "way", "relation")) -> DataFrame:
    """kind, idx, pos, k, v of the tag tables of these kinds, as stored (repeated rows included)."""
    out = None
    for kind in kinds:
        one = table(spark, folder, TAG_TABLES[kind]).select(F.lit(kind).alias("kind"), "idx", "pos", "k", "v")
        out = one if out is None else out.unionByName(one)
    return out
