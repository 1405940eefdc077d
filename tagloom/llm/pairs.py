"""Items that appear together: sorted runs of packed 64-bit pair codes, merged and run-length counted.

Items get 32-bit numbers in the order of their bytes. A worker turns the sorted records it holds into codes a << 32 | b
with a < b, sorts them run by run and hands on (code, repeats). Spark's external sorter, which spills sorted runs and
merges them, brings equal codes together; a streaming pass sums the repeats of each run of equal codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.core import dense_ids, lookup_join, materialise, ship_package

RUN_CODES = 1 << 20
_MOST_ITEMS = 2**31 - 1


def _run(codes: list[np.ndarray]) -> pa.RecordBatch:
    code, n = np.unique(np.concatenate(codes), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (record, id) -> sorted runs of (code, repeats). Holds one record and one run."""
    codes: list[np.ndarray] = []
    held = 0
    kept: tuple[np.ndarray, np.ndarray] | None = None

    def pairs(starts: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
        """starts: number of the record of each id."""
        here = np.arange(len(ids) - 1)
        step = 1
        while len(here):
            here = here[here + step < len(ids)]
            here = here[starts[here] == starts[here + step]]
            if len(here):
                yield (ids[here] << 32) | ids[here + step]
            step += 1

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal codes, held
        if codes:
            yield _run(codes)
        codes, held = [], 0

    def take(starts: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal held
        for c in pairs(starts, ids):
            codes.append(c)
            held += len(c)
            if held >= RUN_CODES:
                yield from flush()

    last = None
    number = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, idx, ids = (batch.column(i) for i in range(3))
        ids = ids.to_numpy()
        if ids.max() > _MOST_ITEMS:
            raise ValueError(f"more than {_MOST_ITEMS} items don't fit into codes of 64 bits")
        key = np.stack([kind.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), idx.fill_null(0).to_numpy(), idx.is_null().to_numpy(zero_copy_only=False).astype(np.int64)])
        new = np.ones(len(ids), bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        new[0] = last is None or bool((key[:, 0] != last).any())
        last = key[:, -1]
        starts = number + np.cumsum(new)
        number = int(starts[-1])
        if kept is not None:
            starts, ids = np.concatenate([kept[0], starts]), np.concatenate([kept[1], ids])
        cut = int(np.searchsorted(starts, number))  # the last record may go on
        yield from take(starts[:cut], ids[:cut])
        kept = (starts[cut:], ids[cut:])
    if kept is not None:
        yield from take(*kept)
    yield from flush()


def _sum_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by code -> (code, n) with each code once in the partition."""
    open_code, open_n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        code, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        code, n = code[at], np.add.reduceat(n, at)
        if open_code is not None:
            if code[0] == open_code:
                n[0] += open_n
            else:
                code, n = np.concatenate([[open_code], code]), np.concatenate([[open_n], n])
        open_code, open_n = code[-1], n[-1]
        if len(code) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(code[:-1], pa.int64()), pa.array(n[:-1], pa.int64())], ["code", "n"])
    if open_code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_code], pa.int64()), pa.array([open_n], pa.int64())], ["code", "n"])


def count_pairs(items: DataFrame, record: tuple[str, str] = ("kind", "idx"), item: str = "item", min_together: int = 1) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, odds_ratio) of every pair that stands together in min_together records or more.

    record names an int-like or string kind column and a bigint column. item_a < item_b by UTF-8 bytes. Repeated rows
    count once and NULL items not at all; the empty string is an item; a NULL record value is a record of its own. n is
    the number of records with an item, lift = n_ab * n / (n_a * n_b), and odds_ratio has 0.5 added to each of the four
    cells. An item in fewer than min_together records can't be in such a pair and is left out of the pairing, not of n.
    More than 2 ** 31 - 1 items in pairs are an error. A record without a pair gives none; an empty table gives an empty result. Further columns are ignored.
    """
    ship_package(items.sparkSession)
    plain = items.select(F.col(record[0]).alias("_kind"), F.col(record[1]).cast("bigint").alias("_idx"), F.col(item).cast("string").alias("_item")).where(F.col("_item").isNotNull())
    kinds = plain.withColumn("_kind", F.xxhash64("_kind")) if dict(plain.dtypes)["_kind"] == "string" else plain.withColumn("_kind", F.col("_kind").cast("bigint"))
    held = materialise(kinds.distinct(), "items")
    total = held.select("_kind", "_idx").distinct().count()
    counts = held.groupBy("_item").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_together)
    numbered = dense_ids(counts, ["_item"], "_id")
    coded = lookup_join(held, numbered.select("_item", "_id"), "_item").select("_kind", "_idx", "_id")
    runs = coded.repartition("_kind", "_idx").sortWithinPartitions("_kind", "_idx", "_id").mapInArrow(_runs, "code bigint, n bigint")
    pairs = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_sum_runs, "code bigint, n bigint").where(F.col("n") >= min_together)
    found = pairs.select(F.shiftright("code", 32).alias("_a"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("_b"), F.col("n").alias("n_ab"))
    found = lookup_join(found, numbered.select(F.col("_id").alias("_a"), F.col("_item").alias("item_a"), F.col("_n").alias("n_a")), "_a")
    found = lookup_join(found, numbered.select(F.col("_id").alias("_b"), F.col("_item").alias("item_b"), F.col("_n").alias("n_b")), "_b")
    n, ab, a, b = F.lit(total), F.col("n_ab"), F.col("n_a"), F.col("n_b")
    odds = (ab + 0.5) * (n - a - b + ab + 0.5) / ((a - ab + 0.5) * (b - ab + 0.5))
    return found.select("item_a", "item_b", "n_ab", "n_a", "n_b", n.cast("bigint").alias("n"), (ab.cast("double") * n / (a.cast("double") * b)).alias("lift"), odds.alias("odds_ratio"))
