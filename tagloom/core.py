"""Helpers that every operator shares: session settings, materialised tables, dense ids, joins that bear hot keys."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a table that may be broadcast after they were counted, and their bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: A key is hot from this share of the rows on; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 64

_PATHS: set[str] = set()
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that Python workers import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tagloom-"), "tagloom_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("tagloom", os.path.relpath(path, here)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir or what the context was told, or on local masters a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    if spark.sparkContext.applicationId not in _LOCAL:
        _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="tagloom-shared-")
    return _LOCAL[spark.sparkContext.applicationId]


_LOCAL: dict[str, str] = {}


def _write(df: DataFrame, label: str) -> str:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tagloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep(spark, path)
    return path


def keep(spark: SparkSession, path: str) -> None:
    """Note a folder in the shared one, to be deleted like materialised tables."""
    if not _PATHS:
        atexit.register(_remove, spark)
    _PATHS.add(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    Cuts the lineage: lost executors cost no recomputation beyond the table. The files go when the driver ends, or with the scope() they were made in.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, label))


class Shelf:
    """Materialised tables of one schema that are read as one, however many rounds an iteration takes."""

    def __init__(self, label: str):
        self._label, self._paths = label, []

    def add(self, df: DataFrame) -> DataFrame:
        """Write df; returns it as read again, alone."""
        self._spark, self._schema = df.sparkSession, df.schema
        self._paths.append(_write(df, self._label))
        return self._spark.read.schema(self._schema).parquet(self._paths[-1])

    def read(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(*self._paths)


def release(spark: SparkSession) -> None:
    """Delete all materialised tables now; results built on them can't be read afterwards."""
    _remove(spark)


def _remove(spark: SparkSession, paths: set[str] | None = None) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in list(_PATHS if paths is None else paths):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
            _PATHS.discard(path)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        pass


def dense_ids(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order given, without a single-partition window.

    Range partitions are sorted on their own; only one count for each partition goes to the driver.
    """
    spark = df.sparkSession
    cols = [F.col(c) for c in order]
    # without a number small neighbouring ranges become one
    ranges = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    ranked = materialise(
        ranges.sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    )
    part = F.shiftright("_at", 33)
    counts = sorted((r[0], r[1]) for r in ranked.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, c in counts:
        starts.append((p, total))
        total += c
    offsets = spark.createDataFrame(starts or [(0, 0)], "_part bigint, _start bigint")
    return (
        ranked.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_start", "_at")
    )


def spread(df: DataFrame, times: int = 3) -> DataFrame:
    """df in more partitions, if a plain scan would give fewer than there are cores: for work that costs far more than a shuffle of its input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan" or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * times)


#: Values that the search for hot keys tracks at once: it can't miss one of HOT_SHARE of the rows.
_TRACKED = 8192


def hot_keys(df: DataFrame, key: Column | str, share: float = HOT_SHARE) -> list:
    """The non-null values of key that hold at least the given share of df's rows: at most about 1 / share of them.

    One pass and a sketch for each task, no shuffle of keys; a value a little below the share may be given too.
    """
    found = df.select((F.col(key) if isinstance(key, str) else key).alias("_key")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_key, {int(2 / share)}, {_TRACKED})").alias("top")).first()
    return [r["item"] for r in found.top if r["item"] is not None and r["count"] >= max(2, found.n * share)]


def is_hot(columns: list[str], rows: DataFrame) -> Column | None:
    """A condition that picks the rows whose columns together hold at least HOT_SHARE of all of rows; None if there are none."""
    key = F.xxhash64(*columns)
    hot = hot_keys(rows, key)
    return key.isin(hot) if hot else None


def _row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row takes in memory."""
    out = F.lit(16 + 8 * len(schema))
    for f in schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out = out + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            out = out + 8 * F.coalesce(F.array_size(F.col(f"`{f.name}`")), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0))
    return out


def fits_broadcast(df: DataFrame) -> bool:
    """Whether all of df may be broadcast: its rows and their bytes are counted."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(df.schema)).alias("b")).first()
    return size.n <= BROADCAST_ROWS and (size.b or 0) <= BROADCAST_BYTES


def lookup_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner", left_like: DataFrame | None = None, right_like: DataFrame | None = None) -> DataFrame:
    """Join left with right, in which key is unique, on key; how is inner or left.

    right is broadcast if it has at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes. Else rows of left under hot keys
    (at most 1 / HOT_SHARE keys) meet a broadcast extract of right, rows with a NULL key pass by the join, and only the
    others are shuffled. left is materialised for that, as it is read several times, unless left_like is given: a table that is
    cheap to read and has left's key columns with about the same rows. right_like is a table of at least right's rows that
    is cheaper to measure.
    """
    keys = [key] if isinstance(key, str) else key
    if fits_broadcast(right if right_like is None else right_like):
        return left.join(F.broadcast(right), keys, how)
    if left_like is None:
        left = left_like = materialise(left, "left")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    kinds = {f.name: f.dataType for f in left.schema}
    hash_ = F.xxhash64(*[F.col(k).cast(kinds[k]) for k in keys])
    hot = hot_keys(left_like, F.when(known, hash_))
    spread_ = F.coalesce(hash_.isin(hot), F.lit(False)) if hot else F.lit(False)
    out = left.where(known & ~spread_).join(right.where(~spread_) if hot else right, keys, how)
    if hot:
        out = out.unionByName(left.where(known & spread_).join(F.broadcast(right.where(spread_)), keys, how))
    if how == "left":
        out = out.unionByName(left.where(~known).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in keys]))
    return out


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables materialised within are deleted at the end, when nothing that is built on them is needed any more."""
    before = set(_PATHS)
    try:
        yield
    finally:
        _remove(spark, _PATHS - before)
