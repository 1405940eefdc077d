"""Streams of arriving rows (beyond what a stored map needs): latest edits, windowed counts with late rows, tag totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_stream(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """Rows of the Parquet files that arrive in a folder; the schema is that of the files there now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def loads_per_hour(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """window start, rows: how many different (idx, version) were loaded each hour; repeated deliveries count once.

    Rows later than the watermark are left out, so that the state stays bounded.
    """
    stamped = rows.where("loaded_at is not null").select("idx", "version", F.col("loaded_at").cast("timestamp").alias("loaded_at")).withWatermark("loaded_at", late)
    once = stamped.dropDuplicatesWithinWatermark(["idx", "version"])
    return once.groupBy(F.window("loaded_at", "1 hour")).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("hour"), "rows")


def tag_totals(rows: DataFrame) -> DataFrame:
    """k, rows: running totals of a stream of tag rows, for the complete or update mode."""
    return rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("rows"))


def keep_latest(batch: DataFrame, target: str, keys: list[str], order: list[str]) -> None:
    """For foreachBatch: merge a batch into the Parquet table at target so that each key keeps its latest row.

    The merged table is written beside the old one, which moves aside while the new one takes its place. Whatever is lost
    in between, executors or the driver, the next call finds the table: at target, or where it was moved to. A batch that
    is merged again changes nothing. Of rows alike in order the greatest counts.
    """
    spark = batch.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    table, fresh, aside = (jvm.org.apache.hadoop.fs.Path(target + end) for end in ("", ".next", ".before"))
    fs = table.getFileSystem(conf)
    if not fs.exists(table) and fs.exists(aside):
        fs.rename(aside, table)
    rows = spark.read.parquet(target).unionByName(batch) if fs.exists(table) else batch
    others = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order, *others)).alias("r")).select(*keys, "r.*")
    latest.write.mode("overwrite").parquet(target + ".next")
    fs.delete(aside, True)
    if fs.exists(table):
        fs.rename(table, aside)
    fs.rename(fresh, table)
    fs.delete(aside, True)
