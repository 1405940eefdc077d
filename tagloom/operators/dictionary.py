"""Dictionaries, positions and the byte-level forms of the stored format, without single-partition windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.core import dense_ids, materialise


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of `value` over all rows before it in this order.

    Range partitions sum on their own; one total for each goes to the driver.
    """
    spark = df.sparkSession
    cols = [F.col(c) for c in order]
    ranked = materialise(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    totals = sorted((r[0], r[1]) for r in ranked.groupBy(part.alias("p")).agg(F.sum(value).alias("s")).collect())
    starts, total = [], 0
    for p, s in totals:
        starts.append((p, total))
        total += s or 0
    offsets = spark.createDataFrame(starts or [(0, 0)], "_part bigint, _start bigint")
    within = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return (
        ranked.withColumn("_part", part).withColumn("_w", F.coalesce(within, F.lit(0)))
        .join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_w")).drop("_part", "_at", "_w", "_start")
    )


def tag_dictionary(tags: DataFrame) -> DataFrame:
    """k, v, dict_idx of tags (kind_order, idx, pos, k, v): different pairs, numbered by first appearance."""
    firsts = tags.groupBy("k", "v").agg(F.min(F.struct("kind_order", "idx", "pos")).alias("f")).select("k", "v", F.col("f.kind_order").alias("a"), F.col("f.idx").alias("b"), F.col("f.pos").alias("c"))
    return dense_ids(firsts, ["a", "b", "c"], "dict_idx").select("k", "v", "dict_idx")


def string_table(tags: DataFrame) -> DataFrame:
    """s, byte_offset of the different strings of tags: end to end in order of first appearance, each with one byte behind it."""
    both = tags.select("kind_order", "idx", "pos", F.posexplode(F.array("k", "v")).alias("side", "s")).where("s is not null")
    firsts = both.groupBy("s").agg(F.min(F.struct("kind_order", "idx", "pos", "side")).alias("f")).select("s", "f.*").withColumn("n", (F.octet_length("s") + 1).cast("bigint"))
    return running_sum(firsts, ["kind_order", "idx", "pos", "side"], "n", "byte_offset").select("s", "byte_offset")


def ranges(parents: DataFrame, children: DataFrame) -> DataFrame:
    """idx, first, last: the half-open range that each parent's children take in the list of all children."""
    sizes = parents.select("idx").join(children.groupBy("idx").agg(F.count(F.lit(1)).alias("n")), "idx", "left").select("idx", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return running_sum(sizes, ["idx"], "n", "first").select("idx", "first", (F.col("first") + F.col("n")).alias("last"))


def block_offsets(ids: DataFrame, bits: int) -> DataFrame:
    """block, n, offset of ids (osm_id) in blocks of 2 ** bits ids; there are few blocks, ids are bounded by 2 ** 40."""
    blocks = ids.groupBy(F.shiftright("osm_id", bits).alias("block")).agg(F.countDistinct("osm_id").alias("n"))
    return running_sum(blocks, ["block"], "n", "offset").select("block", "n", "offset")


def bitmap_rank(ids: DataFrame) -> DataFrame:
    """osm_id, rank: how many smaller ids there are, from 64-bit words of a bitmap and the count of bits before them."""
    word, bit = F.shiftright("osm_id", 6), F.col("osm_id").bitwiseAND(63).cast("int")
    words = ids.select("osm_id").dropna().distinct().groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(osm_id & 63 as int))")).alias("bits"))
    counted = running_sum(words.withColumn("n", F.bit_count("bits").cast("bigint")), ["word"], "n", "before")
    return (
        ids.select("osm_id").dropna().distinct().withColumn("word", word).withColumn("bit", bit).join(counted, "word")
        .select("osm_id", (F.col("before") + F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)")))).alias("rank"))
    )


def pack40(value: Column) -> list[Column]:
    """The five bytes of a 40-bit number, the lowest first."""
    return [F.shiftright(value, 8 * i).bitwiseAND(255) for i in range(5)]


def unpack40(parts: list[Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for i, p in enumerate(parts):
        out = out.bitwiseOR(F.shiftleft(p.cast("bigint"), 8 * i))
    return out


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two positive numbers below 2 ** 31, by Euclid's rule in a bounded fold."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(48)), F.struct(a.cast("bigint").alias("x"), b.cast("bigint").alias("y")),
        lambda s, _: F.struct(F.when(s.y == 0, s.x).otherwise(s.y).alias("x"), F.when(s.y == 0, F.lit(0).cast("bigint")).otherwise(s.x % F.when(s.y == 0, 1).otherwise(s.y)).alias("y")),
    )
    return step.x


def gcd_of(df: DataFrame, value: str, seed: int) -> DataFrame:
    """One row, gcd: of seed and all positive values of a column that has few different ones."""
    values = df.where(F.col(value) > 0).agg(F.collect_set(F.col(value).cast("bigint")).alias("all"))
    return values.select(F.aggregate("all", F.lit(seed).cast("bigint"), lambda s, x: gcd(s, x)).alias("gcd"))
