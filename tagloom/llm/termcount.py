"""Frequency of every term: burst tries on the workers, merged subtree by subtree.

A burst trie keeps terms in small containers (suffix -> counters) below the prefix that leads to them; a container that
grows past a limit bursts into one container for each next byte. So prefixes are as long as the terms need. Workers hand
on their containers; a routing of adaptive prefixes, burst in the same way from the containers' sizes, says which worker
merges which subtrees.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.core import is_hot, materialise, ship_package

BURST_AT = 4096
#: Batches, and bytes of them, whose equal terms are added up before they go into a trie.
_GROUPED_BATCHES, _GROUPED_BYTES = 64, 32 << 20
#: Terms, and bytes of them, that a worker holds before it hands on its tries and starts new ones.
HELD_TERMS, HELD_BYTES = 1_000_000, 256 << 20
#: Terms of a subtree that is not cut further when subtrees are routed to workers.
ROUTED_TERMS = 50_000
#: There are at most about so many heavy prefixes on one level of the routing, whatever the number of terms.
MOST_HEAVY = 2_000
#: Bytes of prefix that one job of the routing looks into.
_STRIDE = 4


class BurstTrie:
    """Terms (bytes) with two counters each: occurrences and records."""

    def __init__(self, burst_at: int = BURST_AT):
        self.burst_at = burst_at
        self._root: dict | _Node = {}

    def add(self, term: bytes, occurrences: int, records: int) -> None:
        node, parent, depth = self._root, None, 0
        while type(node) is _Node:
            if depth == len(term):
                if node.end is None:
                    node.end = [0, 0]
                node.end[0] += occurrences
                node.end[1] += records
                return
            parent, byte = node, term[depth]
            node = parent.below.get(byte)
            if node is None:
                node = parent.below[byte] = {}
            depth += 1
        suffix = term[depth:]
        counters = node.get(suffix)
        if counters is None:
            node[suffix] = [occurrences, records]
            if len(node) > self.burst_at:
                burst = _Node(node)
                if parent is None:
                    self._root = burst
                else:
                    parent.below[term[depth - 1]] = burst
        else:
            counters[0] += occurrences
            counters[1] += records

    def subtrees(self) -> Iterator[tuple[bytes, list[tuple[bytes, list[int]]]]]:
        """(prefix, sorted [(suffix, counters)]) of every container, in the order of the terms."""
        stack: list[tuple[bytes, dict | _Node]] = [(b"", self._root)]
        while stack:
            prefix, node = stack.pop()
            if type(node) is _Node:
                if node.end is not None:
                    yield prefix, [(b"", node.end)]
                stack += [(prefix + bytes([b]), node.below[b]) for b in sorted(node.below, reverse=True)]
            elif node:
                yield prefix, sorted(node.items())


class _Node:
    __slots__ = ("below", "end")

    def __init__(self, container: dict[bytes, list[int]]):
        self.end = container.pop(b"", None)
        self.below: dict[int, dict | _Node] = {}
        for suffix, counters in container.items():
            self.below.setdefault(suffix[0], {})[suffix[1:]] = counters


_SUBTREES = "field string, prefix binary, suffixes array<binary>, occurrences array<bigint>, records array<bigint>"
_BINARIES, _LONGS = pa.list_(pa.binary()), pa.list_(pa.int64())


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.string(), pa.binary(), _BINARIES, _LONGS, _LONGS]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["field", "prefix", "suffixes", "occurrences", "records"])


def _emit(tries: dict[str, BurstTrie]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for field, trie in tries.items():
        for prefix, container in trie.subtrees():
            rows.append((field, prefix, [s for s, _ in container], [c[0] for _, c in container], [c[1] for _, c in container]))
            held += len(container)
            if held >= 16_384:
                yield _arrow(rows)
                rows, held = [], 0
    if rows:
        yield _arrow(rows)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, term, n) -> subtrees; hands on what it holds whenever that is much."""
    tries: dict[str, BurstTrie] = {}
    held: list[pa.RecordBatch] = []
    terms = size = waiting = 0

    def flush() -> None:
        nonlocal terms, size, waiting
        grouped = pa.Table.from_batches(held).group_by(["field", "term"]).aggregate([("n", "sum"), ("n", "count")])
        held.clear()
        terms, size, waiting = terms + len(grouped), size + grouped.column("term").nbytes, 0
        for field, term, occurrences, records in zip(*(grouped.column(c).to_pylist() for c in ("field", "term", "n_sum", "n_count")), strict=True):
            tries.setdefault(field, BurstTrie()).add(term, occurrences, records)

    for batch in batches:
        held.append(batch)
        waiting += batch.nbytes
        if len(held) >= _GROUPED_BATCHES or waiting > _GROUPED_BYTES:
            flush()
        if terms >= HELD_TERMS or size >= HELD_BYTES:
            yield from _emit(tries)
            tries, terms, size = {}, 0, 0
    if held:
        flush()
    yield from _emit(tries)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees sorted by bound -> terms; holds the trie of one bound."""
    trie, open_ = BurstTrie(), None

    def counted() -> Iterator[pa.RecordBatch]:
        for prefix, container in trie.subtrees():
            terms = pa.array([prefix + s for s, _ in container], pa.binary())
            numbers = [pa.array([c[i] for _, c in container], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([open_[0]] * len(container), pa.string()), terms, *numbers], ["field", "term", "occurrences", "records"])

    for batch in batches:
        for bound, field, prefix, suffixes, occurrences, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (field, bound) != open_:
                yield from counted()
                trie, open_ = BurstTrie(), (field, bound)
            for suffix, o, r in zip(suffixes, occurrences, records, strict=True):
                trie.add(prefix + suffix, o, r)
    yield from counted()


def routing(subtrees: DataFrame, most: int = ROUTED_TERMS) -> list[tuple[str, bytes]]:
    """Sorted (field, prefix) bounds: each opens a subtree of about `most` terms or fewer, more only for over 10 ** 8 terms.

    Starts from the first byte and bursts only prefixes above `most`, of which there are at most terms / most; one job for
    _STRIDE bytes. To the driver go the children of heavy prefixes; neighbours that are small together share a bound.
    """
    sizes = subtrees.select("field", "prefix", F.size("suffixes").alias("n"))
    most = max(most, (sizes.agg(F.sum("n").alias("n")).first().n or 0) // MOST_HEAVY)
    leaves: dict[tuple[str, bytes], int] = {}
    heavy: list[tuple[str, bytes]] = []
    depth = 0
    while depth == 0 or heavy:
        at = sizes
        if depth:
            wanted = subtrees.sparkSession.createDataFrame(heavy, "field string, _from binary")
            at = sizes.withColumn("_from", F.substring("prefix", 1, depth)).join(F.broadcast(wanted), ["field", "_from"])
        longest = at.groupBy("field", F.substring("prefix", 1, depth + _STRIDE).alias("p")).agg(F.sum("n").alias("n"))
        lengths = F.explode(F.sequence(F.lit(depth + 1), F.greatest(F.lit(depth + 1), F.length("p"))))
        every = longest.withColumn("d", lengths).groupBy("field", "d", F.expr("substring(p, 1, d)").alias("p")).agg(F.sum("n").alias("n"))
        above = every.where(F.col("n") > most).select("field", F.col("p").alias("_up"))
        first = every.where(f"d = {depth + 1}")
        later = every.where(f"d > {depth + 1}").withColumn("_up", F.expr("substring(p, 1, d - 1)")).join(above, ["field", "_up"], "left_semi")
        rows = first.select("field", "d", "p", "n").unionByName(later.select("field", "d", "p", "n")).collect()
        heavy = []
        for r in sorted(rows, key=lambda r: r.d):
            leaves[r.field, bytes(r.p)] = r.n
            if r.n > most and len(r.p) == r.d:
                if r.d == depth + _STRIDE:
                    heavy.append((r.field, bytes(r.p)))
                else:
                    leaves[r.field, bytes(r.p)] = 0  # what ends here is counted with its first child
        depth += _STRIDE
    bounds: list[tuple[str, bytes]] = []
    held = 0
    for (field, prefix), n in sorted(leaves.items()):
        if not bounds or bounds[-1][0] != field or held + n > most:
            bounds.append((field, prefix))
            held = 0
        held += n
    return bounds


def count_terms(rows: DataFrame, record: tuple[str, ...], fields: tuple[str, ...], most: int = ROUTED_TERMS) -> DataFrame:
    """(field, term, occurrences, records): every distinct non-null value of the columns `fields`.

    rows are taken as a set over all their columns: a repeated row counts once. occurrences is the number of rows with the
    term in that field, records the number of different values of the columns `record` that have it. NULL is no term, the
    empty string is one; terms are compared byte by byte, whatever their length. A NULL record value is a record of its
    own. An empty table gives an empty result. The pseudo-field '' holds, under the term '', the number of records with
    any term. Columns of rows beyond `record` and `fields` only make rows differ.
    """
    ship_package(rows.sparkSession)
    plain = rows.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(record)], *[F.col(c).cast("string").alias(f"_f{i}") for i, c in enumerate(fields)], *[F.col(c).alias(f"_x{i}") for i, c in enumerate(rows.columns) if c not in (*record, *fields)])
    some = F.coalesce(*[F.col(f"_f{i}") for i in range(len(fields))]).isNotNull()
    keys = [f"_r{i}" for i in range(len(record))]
    terms = [F.struct(F.lit(f).alias("field"), F.col(f"_f{i}").cast("binary").alias("term")) for i, f in enumerate(fields)]
    # rows with any term are those with one in the first field and, few as a rule, these
    terms = F.array(*terms, F.struct(F.lit("").alias("field"), F.when(some & F.col("_f0").isNull(), F.lit("").cast("binary")).alias("term")))

    def of_records(part: DataFrame) -> DataFrame:
        exploded = part.distinct().select(*keys, F.explode(terms).alias("t")).select(*keys, "t.field", "t.term").where(F.col("term").isNotNull())
        return exploded.groupBy(*keys, "field", "term").agg(F.count(F.lit(1)).alias("n")).select("field", "term", "n")

    # one exchange by record serves both the set of rows and the terms of a record; records that hold a large share of the rows are spread
    hot = is_hot(keys, plain)
    counted = of_records((plain if hot is None else plain.where(~hot)).repartition(*keys))
    if hot is not None:
        counted = counted.unionByName(of_records(plain.where(hot)))
    subtrees = materialise(counted.mapInArrow(_count, _SUBTREES), "subtrees")
    of_field = subtrees.where(F.col("field").isin(fields[0], "")).agg(F.sum(F.aggregate("occurrences", F.lit(0).cast("bigint"), lambda a, n: a + n)).alias("n"))
    rows_with, records = of_field.first().n, plain.where(some).select(*keys).distinct().count()
    subtrees = subtrees.where("field <> ''")
    bounds = routing(subtrees, most)
    shared = rows.sparkSession.sparkContext.broadcast(bounds)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            routed: dict[int, list[tuple]] = {}
            for field, prefix, suffixes, occurrences, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = 0
                while at < len(suffixes):
                    to = bisect_right(bounds, (field, prefix + suffixes[at])) - 1
                    until = len(suffixes)
                    if to + 1 < len(bounds) and bounds[to + 1][0] == field and bounds[to + 1][1] <= prefix + suffixes[-1]:
                        low = at
                        while until - low > 1:
                            middle = (low + until) // 2
                            low, until = (middle, until) if prefix + suffixes[middle] < bounds[to + 1][1] else (low, middle)
                    routed.setdefault(to, []).append((field, prefix, suffixes[at:until], occurrences[at:until], records[at:until]))
                    at = until
            for to, rows_ in routed.items():
                out = _arrow(rows_)
                yield pa.RecordBatch.from_arrays([pa.array([to] * out.num_rows, pa.int32()), *out.columns], ["bound", *out.schema.names])

    merged = subtrees.mapInArrow(route, "bound int, " + _SUBTREES).repartition("bound").sortWithinPartitions("bound")
    found = merged.mapInArrow(_merge, "field string, term binary, occurrences bigint, records bigint").withColumn("term", F.col("term").cast("string"))
    whole = rows.sparkSession.createDataFrame([("", "", rows_with, records)] if records else [], "field string, term string, occurrences bigint, records bigint")
    return found.unionByName(whole)


def mark_terms(counts: DataFrame, rare: int = 2, common: int = 20) -> DataFrame:
    """count_terms' result, without the pseudo-field, and mark: 'rare' if records <= rare, else 'common' if records * common >= all records, else NULL."""
    counts = materialise(counts, "terms")
    total = counts.where(F.col("field") == "").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("_all"))
    return (
        counts.where(F.col("field") != "")
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") * common >= F.col("_all"), "common"))
        .drop("_all")
    )
