"""Most frequent terms in bounded memory: combinatorial group testing.

Each of a few rows of hash buckets keeps, for every bucket, how many values fell into it and, for each of the 64 bits of
a value's hash, how many of them had that bit set. If one value holds more than half of a bucket, the majority of every
bit spells its hash. Sketches of partitions are added; what their buckets spell is verified by an exact count of the
candidates alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.core import materialise, ship_package

#: Sketch size. A value with a share of 1/200 is missed only if in each row the others in its bucket outweigh it: with an even spread they hold 1/1024.
ROWS, BUCKETS = 5, 1024
_BUFFER = 100_000
#: Sketches (2.7 MB a field) that are shuffled, at most, for each core.
SKETCHES_A_CORE = 4
#: Odd multipliers of the rows' hash functions.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def bucket_of(hashes: np.ndarray, row: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * _ODD[row]
    return (mixed >> np.uint64(64 - 10)).astype(np.int64) % BUCKETS


class GroupTesting:
    """totals[row, bucket] and bits[row, bucket, bit]."""

    def __init__(self) -> None:
        self.counts = np.zeros((ROWS, BUCKETS, 65), np.int64)

    def add(self, hashes: np.ndarray) -> None:
        values, n = np.unique(hashes, return_counts=True)
        table = np.empty((len(values), 65), np.int64)
        table[:, 0] = 1
        table[:, 1:] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        table *= n[:, None]
        for row in range(ROWS):
            at = bucket_of(values, row)
            order = np.argsort(at, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
            self.counts[row, at[order][starts]] += np.add.reduceat(table[order], starts, axis=0)


def decode(row: int, bucket: int, counts: np.ndarray) -> int | None:
    """The hash that the bucket's majorities spell, if it belongs into this bucket."""
    spelt = np.packbits(counts[1:] * 2 > counts[0], bitorder="little").view("<u8").astype(np.uint64)
    return int(spelt.view(np.int64)[0]) if bucket_of(spelt, row)[0] == bucket else None


def heavy_terms(rows: DataFrame, fields: tuple[str, ...], share: int = 200) -> DataFrame:
    """(field, term, rows): terms of a column whose rows * share >= the column's rows with a non-null value; counts are exact.

    rows are used as they are: remove repeated rows before if they should count once. NULL is no term, the empty string is
    one; ties at the bound are all in; terms of any length are hashed whole. An empty table or column gives nothing. share
    may be at most BUCKETS / 4. Memory of a worker: one sketch of ROWS x BUCKETS x 65 numbers for each field, however many
    terms there are. Further columns are ignored.
    """
    if not 1 <= share <= BUCKETS // 4:
        raise ValueError(f"share must be 1 to {BUCKETS // 4}")
    spark = rows.sparkSession
    ship_package(spark)
    plain = rows.select(*[F.col(c).cast("string").alias(f"_f{i}") for i, c in enumerate(fields)])
    hashed = plain.select(*[F.when(F.col(f"_f{i}").isNotNull(), F.xxhash64(f"_f{i}")).alias(f"_h{i}") for i in range(len(fields))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = [GroupTesting() for _ in fields]
        waiting: list[list[np.ndarray]] = [[] for _ in fields]
        held = 0

        def flush() -> None:
            for s, w in zip(sketches, waiting, strict=True):
                if w and len(all_ := np.concatenate(w)):
                    s.add(all_)
                w.clear()

        for batch in batches:
            for column, w in zip(batch.columns, waiting, strict=True):
                w.append(column.drop_null().to_numpy().view(np.uint64))
            held += batch.num_rows
            if held >= _BUFFER:
                flush()
                held = 0
        flush()
        for i, s in enumerate(sketches):
            row, bucket = np.nonzero(s.counts[:, :, 0])
            if len(row):
                payload = pa.array([s.counts[r, b].tobytes() for r, b in zip(row, bucket, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(row), pa.int32()), pa.array(row, pa.int32()), pa.array(bucket, pa.int32()), payload], ["field", "row", "bucket", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for field, row, bucket, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, more = (field, row, bucket), np.frombuffer(counts, np.int64)
                sums[at] = sums[at] + more if at in sums else more
        found = [(f, h) for (f, r, b), c in sums.items() if (h := decode(r, b, c)) is not None]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.int32()), pa.array([h for _, h in found], pa.int64())], ["field", "hash"])

    # a sketch for each task: few large tasks rather than one for each part of a scan
    added = hashed.coalesce(SKETCHES_A_CORE * spark.sparkContext.defaultParallelism).mapInArrow(sketch, "field int, row int, bucket int, counts binary").repartition("field", "row", "bucket")
    # at most ROWS * BUCKETS candidates a field
    candidates = materialise(added.mapInArrow(add_up, "field int, hash bigint").distinct(), "candidates")
    exploded = plain.select(F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"_f{i}").alias("term")) for i in range(len(fields))])).alias("t")).select("t.*").where(F.col("term").isNotNull())
    verified = (
        exploded.withColumn("hash", F.xxhash64("term"))
        .join(F.broadcast(candidates), ["field", "hash"], "left_semi")
        .groupBy("field", "term")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    totals = plain.agg(*[F.count(f"_f{i}").alias(f"_n{i}") for i in range(len(fields))])
    name, total = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for i, f in enumerate(fields):
        name, total = F.when(F.col("field") == i, F.lit(f)).otherwise(name), F.when(F.col("field") == i, F.col(f"_n{i}")).otherwise(total)
    return verified.crossJoin(F.broadcast(totals)).where(F.col("rows") * share >= total).select(name.alias("field"), "term", "rows")  # totals: one row
