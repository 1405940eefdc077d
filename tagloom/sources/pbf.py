"""Reading .osm.pbf files as a data source: spark.read.format("osm_pbf").option("entity", ...).load(path).

entity is nodes, ways, relations, header or blocks. The driver reads only the frames of a file; partitions of whole
blocks are inflated and decoded by the executors, which must see the path. A block without the wanted entity is passed
over before its content is decoded.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401 - pa.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tagloom.sources.wire import fields, packed, packed_lists, signed, sums_within, unzigzag, zigzag

_TAGS = "tags array<struct<k: string, v: string>>"
SCHEMAS = {
    "nodes": f"osm_id bigint, lat_nano bigint, lon_nano bigint, granularity int, {_TAGS}",
    "ways": f"osm_id bigint, {_TAGS}, refs array<bigint>",
    "relations": f"osm_id bigint, {_TAGS}, members array<struct<type: string, osm_id: bigint, role: string>>",
    "header": "bbox_left bigint, bbox_right bigint, bbox_top bigint, bbox_bottom bigint, required string, writingprogram string, source string, "
    "replication_timestamp bigint, replication_sequence_number bigint, replication_base_url string",
    "blocks": "block_type string, granularity int, blob_start bigint, blob_len bigint",
    "index": "path string, kinds array<string>, granularity int, blob_start bigint, blob_len bigint",
}
#: Field numbers of the groups of a block, of the member types, and the order of block types.
_GROUPS = {1: "plain_nodes", 2: "nodes", 3: "ways", 4: "relations", 5: "changesets"}
_MEMBER_TYPES = ("node", "way", "relation")
_TAG_LIST = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))
_MEMBER_LIST = pa.list_(pa.struct([("type", pa.string()), ("osm_id", pa.int64()), ("role", pa.string())]))
#: Bytes of blocks that one partition reads.
PARTITION_BYTES = 32 << 20


class PbfError(ValueError):
    """The file isn't what the format asks for, or has what isn't supported."""


@dataclass
class Blob:
    kind: str
    start: int
    size: int
    path: str = ""


def _where(path: str):
    """(file system, path in it) of a path or URI: local, or any store that Arrow knows."""
    if "://" in path:
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def files_of(path: str) -> list[str]:
    """The .pbf files of a folder, in order of their names, or the file itself; paths that _open() takes."""
    fs, inside = _where(path)
    start = path[: len(path) - len(inside)] if "://" in path and path.endswith(inside) else ""
    if fs.get_file_info(inside).type != pa.fs.FileType.Directory:
        return [path]
    return sorted(start + f.path for f in fs.get_file_info(pa.fs.FileSelector(inside)) if f.type == pa.fs.FileType.File and f.path.endswith(".pbf"))


def _open(path: str):
    fs, inside = _where(path)
    return fs.open_input_file(inside)


def frames(path: str) -> Iterator[Blob]:
    """The blobs of a file, from their headers alone."""
    with _open(path) as f:
        size, at = f.size(), 0
        while at < size:
            f.seek(at)
            head = f.read(4)
            if len(head) < 4:
                raise PbfError(f"{path} ends within a frame")
            n = int.from_bytes(head, "big")
            if not 0 < n <= 64 << 10:
                raise PbfError(f"{path} has a blob header of {n} bytes")
            kind, blob = "", None
            for number, value in fields(f.read(n)):
                if number == 1:
                    kind = value.decode()
                elif number == 3:
                    blob = value
            if kind not in ("OSMHeader", "OSMData") or blob is None:
                raise PbfError(f"{path} has a blob of unknown type {kind!r}")
            if at + 4 + n + blob > size:
                raise PbfError(f"{path} ends within a blob")
            yield Blob(kind, at + 4 + n, blob, path)
            at += 4 + n + blob


def inflate(blob: bytes) -> bytes:
    raw = size = packed_ = None
    for number, value in fields(blob):
        if number == 1:
            raw = value
        elif number == 2:
            size = value
        elif number == 3:
            packed_ = value
    if raw is not None:
        return raw
    if packed_ is None:
        raise PbfError("a blob is neither raw nor compressed by zlib")
    data = zlib.decompress(packed_)
    if size is not None and size != len(data):
        raise PbfError(f"a blob inflates to {len(data)} bytes, not {size}")
    return data


def _kinds(group: bytes) -> str | None:
    """What a group holds, from its first field."""
    for number, _ in fields(group):
        kind = _GROUPS.get(number)
        if kind in (None, "plain_nodes", "changesets"):
            raise PbfError(f"a group holds {(kind or 'unknown data').replace('_', ' ')}, which isn't supported")
        return kind
    return None


class Block:
    """A primitive block: its string table, groups and scales."""

    def __init__(self, data: bytes):
        self.strings: list[str] = []
        self.groups: list[tuple[str, bytes]] = []
        self.granularity, self.lat_offset, self.lon_offset = 100, 0, 0
        table = b""
        for number, value in fields(data):
            if number == 1:
                table = value
            elif number == 2:
                if kind := _kinds(value):
                    self.groups.append((kind, value))
            elif number == 17:
                self.granularity = signed(value)
            elif number == 19:
                self.lat_offset = signed(value)
            elif number == 20:
                self.lon_offset = signed(value)
        self._table = table

    def load_strings(self) -> pa.Array:
        return pa.array([v for n, v in fields(self._table) if n == 1], pa.binary()).cast(pa.string())

    def batches(self, entity: str) -> Iterator[pa.RecordBatch]:
        wanted = [g for kind, g in self.groups if kind == entity]
        if wanted:
            strings = self.load_strings()
            for group in wanted:
                yield from getattr(self, f"_{entity}")(group, strings)

    def _nodes(self, group: bytes, strings: pa.Array) -> Iterator[pa.RecordBatch]:
        for number, dense in fields(group):
            if number != 2:
                continue
            of = dict(fields(dense))
            ids, lats, lons = (np.cumsum(unzigzag(packed(of.get(i, b"")))) for i in (1, 8, 9))
            if not len(ids) == len(lats) == len(lons):
                raise PbfError("dense nodes with lists of different lengths")
            pairs = packed(of.get(10, b"")).astype(np.int64)
            if len(pairs):
                stops = _stops(pairs)
                if len(stops) != len(ids):
                    raise PbfError("dense nodes with another number of tag lists")
                counts = np.diff(np.concatenate([[-1], stops])) // 2
                flat = np.delete(pairs, stops)
            else:
                counts, flat = np.zeros(len(ids), np.int64), pairs
            lat, lon = self.lat_offset + self.granularity * lats, self.lon_offset + self.granularity * lons
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(lat), pa.array(lon), pa.array(np.full(len(ids), self.granularity, np.int32)), _tags(strings, flat[::2], flat[1::2], counts)],
                ["osm_id", "lat_nano", "lon_nano", "granularity", "tags"],
            )

    def _ways(self, group: bytes, strings: pa.Array) -> Iterator[pa.RecordBatch]:
        rows = [dict(fields(w)) for n, w in fields(group) if n == 3]
        ids = pa.array([signed(r[1]) for r in rows], pa.int64())
        deltas, ends = packed_lists([r.get(8, b"") for r in rows])
        refs = sums_within(unzigzag(deltas), ends)
        yield pa.RecordBatch.from_arrays([ids, self._keys_values(rows, strings), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(refs, pa.int64()))], ["osm_id", "tags", "refs"])

    def _relations(self, group: bytes, strings: pa.Array) -> Iterator[pa.RecordBatch]:
        rows = [dict(fields(r)) for n, r in fields(group) if n == 4]
        ids = pa.array([signed(r[1]) for r in rows], pa.int64())
        roles, ends = packed_lists([r.get(8, b"") for r in rows])
        deltas, id_ends = packed_lists([r.get(9, b"") for r in rows])
        kinds, kind_ends = packed_lists([r.get(10, b"") for r in rows])
        if not (np.array_equal(ends, id_ends) and np.array_equal(ends, kind_ends)):
            raise PbfError("a relation with member lists of different lengths")
        members = pa.StructArray.from_arrays(
            [pa.array(_MEMBER_TYPES).take(pa.array(kinds.astype(np.int64))), pa.array(sums_within(unzigzag(deltas), ends), pa.int64()), strings.take(pa.array(roles.astype(np.int64)))],
            ["type", "osm_id", "role"],
        )
        yield pa.RecordBatch.from_arrays([ids, self._keys_values(rows, strings), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), members)], ["osm_id", "tags", "members"])

    def _keys_values(self, rows: list[dict], strings: pa.Array) -> pa.Array:
        keys, ends = packed_lists([r.get(2, b"") for r in rows])
        values, value_ends = packed_lists([r.get(3, b"") for r in rows])
        if not np.array_equal(ends, value_ends):
            raise PbfError("keys and values of different number")
        return _tags(strings, keys.astype(np.int64), values.astype(np.int64), np.diff(np.concatenate([[0], ends])))


def _stops(pairs: np.ndarray) -> np.ndarray:
    """Places of the zeros that end a node's list of key, value, key, value, ...; a value of 0 ends none."""
    zeros = np.flatnonzero(pairs == 0)
    if not (np.diff(zeros, prepend=-1) % 2 == 0).any():  # an even number of entries before each zero: no value is 0
        return zeros
    stops, start = [], 0
    for z in zeros:
        if z >= start and (z - start) % 2 == 0:
            stops.append(z)
            start = z + 1
    return np.array(stops, np.int64)


def _tags(strings: pa.Array, keys: np.ndarray, values: np.ndarray, counts: np.ndarray) -> pa.Array:
    pairs = pa.StructArray.from_arrays([strings.take(pa.array(keys)), strings.take(pa.array(values))], ["k", "v"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pairs)


def read_header(data: bytes) -> dict:
    box: dict[int, int] = {}
    of: dict[int, list] = {}
    for number, value in fields(data):
        if number == 1:
            box = {n: zigzag(v) for n, v in fields(value)}
        else:
            of.setdefault(number, []).append(value)

    def text(number: int) -> str | None:
        return of[number][-1].decode() if number in of else None

    def number(at: int) -> int | None:
        return signed(of[at][-1]) if at in of else None

    return {
        "bbox_left": box.get(1), "bbox_right": box.get(2), "bbox_top": box.get(3), "bbox_bottom": box.get(4), "required": ",".join(x.decode() for x in of.get(4, [])),
        "writingprogram": text(16), "source": text(17), "replication_timestamp": number(32), "replication_sequence_number": number(33), "replication_base_url": text(34),
    }


@dataclass
class _Part(InputPartition):
    blobs: list[Blob]


class _Reader(DataSourceReader):
    def __init__(self, path: str, entity: str, bytes_: int, blobs: str | None):
        self.path, self.entity, self.bytes_ = path, entity, bytes_
        self.blobs = None if blobs is None else [Blob("OSMData", start, size, file) for file, start, size in json.loads(blobs)]

    def partitions(self) -> list[InputPartition]:
        wanted = "OSMHeader" if self.entity == "header" else "OSMData"
        parts: list[InputPartition] = []
        held: list[Blob] = []
        bytes_ = 0
        for blob in (b for file in files_of(self.path) for b in frames(file)) if self.blobs is None else self.blobs:
            if blob.kind != wanted:
                continue
            if held and bytes_ + blob.size > self.bytes_:
                parts.append(_Part(held))
                held, bytes_ = [], 0
            held.append(blob)
            bytes_ += blob.size
        return [*parts, _Part(held)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path in dict.fromkeys(blob.path for blob in partition.blobs):
            with _open(path) as f:
                for blob in partition.blobs:
                    if blob.path == path:
                        f.seek(blob.start)
                        yield from self._decode(blob, inflate(f.read(blob.size)))

    def _decode(self, blob: Blob, data: bytes) -> Iterator[pa.RecordBatch]:
        if self.entity == "header":
            row = read_header(data)
            kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))
            return
        block = Block(data)
        place = [pa.array([block.granularity], pa.int32()), pa.array([blob.start], pa.int64()), pa.array([blob.size], pa.int64())]
        names = ["granularity", "blob_start", "blob_len"]
        if self.entity == "blocks":
            kind = block.groups[-1][0] if block.groups else None
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.string()), *place], ["block_type", *names])
        elif self.entity == "index":
            kinds = sorted({kind for kind, _ in block.groups})
            yield pa.RecordBatch.from_arrays([pa.array([blob.path]), pa.array([kinds], pa.list_(pa.string())), *place], ["path", "kinds", *names])
        else:
            yield from block.batches(self.entity)


class PbfDataSource(DataSource):
    """Options: path (of a file or a folder, local or a URI), entity (nodes by default), partition_bytes, and blobs, a list of the only blocks to read."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def _entity(self) -> str:
        entity = self.options.get("entity", "nodes")
        if entity not in SCHEMAS:
            raise PbfError(f"entity must be one of {', '.join(SCHEMAS)}")
        return entity

    def schema(self) -> str:
        return SCHEMAS[self._entity()]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._entity(), int(self.options.get("partition_bytes", PARTITION_BYTES)), self.options.get("blobs"))


def read_pbf(spark: SparkSession, path: str, entity: str, partition_bytes: int = PARTITION_BYTES, blobs: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """One entity of a file, or of the .pbf files of a folder, as a DataFrame; of the blocks (path, start, size) alone if they are given."""
    from tagloom.core import ship_package

    ship_package(spark)
    spark.dataSource.register(PbfDataSource)
    reader = spark.read.format("osm_pbf").option("entity", entity).option("partition_bytes", partition_bytes)
    return (reader if blobs is None else reader.option("blobs", json.dumps(blobs))).load(path)
