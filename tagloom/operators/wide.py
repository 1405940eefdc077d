"""Attribute-value rows into wide tables: hash-bucketed entities, dictionary codes, values scattered into typed arrays."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.core import is_hot, ship_package

#: A key outside the types gets a column of its own if it has as many rows as this share of the entities.
COLUMN_SHARE = 1 / 1000
MOST_TYPES, MOST_COLUMNS = 2000, 5000
_CHUNK = 100_000
_INT, _DOUBLE, _DATE = re.compile(r"[+-]?[0-9]{1,18}"), re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?"), re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
#: Texts of a boolean, in lower case.
_BOOLEANS = {"yes": True, "no": False, "true": True, "false": False, "1": True, "0": False}
_ARROW = {"int": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32(), "text": pa.string()}
_NUMPY = {"int": np.int64, "double": np.float64, "boolean": np.bool_, "date": "datetime64[D]"}
_SPARK = {"int": "bigint", "double": "double", "boolean": "boolean", "date": "date", "text": "string"}
_ISSUE = pa.struct([("k", pa.string()), ("issue", pa.string()), ("v", pa.string())])


def fit(text: str, kind: str):
    """text as a value of this type, without spaces around it; None if it doesn't fit."""
    text = text.strip(" ")
    if kind == "int":
        return int(text) if _INT.fullmatch(text) else None
    if kind == "double":
        return float(text) if _DOUBLE.fullmatch(text) else None
    if kind == "boolean":
        return _BOOLEANS.get(text.lower()) if text.isascii() else None
    if kind == "date":
        try:
            return datetime.date.fromisoformat(text) if _DATE.fullmatch(text) else None
        except ValueError:
            return None
    return text


def _lists(owner: np.ndarray, entities: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=entities))]), pa.int32())


class _Chunk:
    """Whole entities, sorted by entity, key, place and value, as one Arrow table."""

    def __init__(self, columns: list[tuple[str, str, str]], report_keyless: bool):
        self.columns, self.report_keyless = columns, report_keyless
        self.place = {k: i for i, (k, _, _) in enumerate(columns)}

    def widen(self, rows: pa.Table) -> pa.RecordBatch:
        kind, idx = rows.column(0).combine_chunks(), rows.column(1).combine_chunks()
        keys, values = (rows.column(i).combine_chunks().dictionary_encode() for i in (2, 3))
        k, v = (x.indices.fill_null(-1).to_numpy(zero_copy_only=False) for x in (keys, values))
        new = _changes(kind, idx)
        entity = np.cumsum(new) - 1
        n = int(entity[-1]) + 1
        first_rows = np.flatnonzero(new)
        keyless = [(int(entity[i]), None, "no key", int(v[i])) for i in np.flatnonzero((k < 0) & (v >= 0))] if self.report_keyless else []
        valid = np.flatnonzero((k >= 0) & (v >= 0))
        e, k, v = entity[valid], k[valid], v[valid]
        opens = np.ones(len(e), bool)
        opens[1:] = (e[1:] != e[:-1]) | (k[1:] != k[:-1])
        first = np.flatnonzero(opens)
        group = np.cumsum(opens) - 1
        names = keys.dictionary.to_pylist()
        column = np.array([self.place.get(x, -1) for x in names] or [-1])
        of = column[k[first]] if len(first) else np.empty(0, np.int64)
        issues = [(int(e[i]), names[k[i]], "conflict", int(v[i])) for i in np.flatnonzero(v != v[first[group]])] if len(first) else []
        texts = values.dictionary
        out, held = [], {}
        for c, (key, _, kind_) in enumerate(self.columns):
            at = first[of == c]
            codes = np.full(n, -1, np.int64)
            codes[e[at]] = v[at]
            if kind_ == "text":
                out.append(texts.take(pa.array(codes, mask=codes < 0)) if len(texts) else pa.nulls(n, pa.string()))
                continue
            array, fits = np.zeros(n, _NUMPY[kind_]), np.zeros(n, bool)
            for code in np.unique(v[at]):
                value = held.get((code, kind_))
                if value is None:
                    value = held[code, kind_] = (fit(texts[int(code)].as_py(), kind_),)
                where = codes == code if len(at) > 64 else e[at[v[at] == code]]
                if value[0] is None:
                    issues += [(int(x), key, "unfit", int(code)) for x in (np.flatnonzero(where) if where.dtype == bool else where)]
                else:
                    array[where], fits[where] = value[0], True
            out.append(pa.array(array, _ARROW[kind_], mask=~fits))
        rest = first[of < 0]
        other = pa.MapArray.from_arrays(_lists(e[rest], n), keys.dictionary.take(pa.array(k[rest])), texts.take(pa.array(v[rest]))) if len(rest) else pa.array([[]] * n, pa.map_(pa.string(), pa.string()))
        issues = sorted(set(issues + keyless), key=lambda x: (x[0], x[1] is not None, x[1] or "", *x[2:]))
        owner = np.array([x[0] for x in issues], np.int64)
        reported = pa.array([{"k": x[1], "issue": x[2], "v": texts[x[3]].as_py()} for x in issues], _ISSUE)
        listed = pa.ListArray.from_arrays(_lists(owner, n), reported)
        at = pa.array(first_rows)
        return pa.RecordBatch.from_arrays([kind.take(at), idx.take(at), *out, other, listed], ["kind", "idx", *(c for _, c, _ in self.columns), "other", "issues"])


def _changes(kind: pa.Array, idx: pa.Array) -> np.ndarray:
    code = kind.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    number, missing = idx.fill_null(0).to_numpy(zero_copy_only=False), idx.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (number[1:] != number[:-1]) | (missing[1:] != missing[:-1])
    return new


def column_names(keys: list[str], taken: set[str]) -> list[str]:
    """A column name for each key: k_ and its letters and digits, numbered where two would be the same but for case."""
    out, taken = [], {x.lower() for x in taken}
    for key in keys:
        base = name = "k_" + re.sub(r"[^0-9A-Za-z]+", "_", key)
        i = 1
        while name.lower() in taken:
            i += 1
            name = f"{base}_{i}"
        taken.add(name.lower())
        out.append(name)
    return out


def widen(tags: DataFrame, types: DataFrame, column_share: float | None = COLUMN_SHARE, report_keyless: bool = False) -> DataFrame:
    """One row for each (kind, idx) of tags (kind, idx, pos, k, v): kind, idx, a column a key, other, issues.

    types (k, col_name, col_type) names typed columns: int (BIGINT), double, boolean, date or text. Further keys
    with at least column_share as many rows as there are entities (about 2 % more or less, as these are estimated) get text
    columns (k_..., the key is in the column's metadata); all others stand in the map `other`, so nothing is lost however many keys there are. column_share 0
    gives every key a column, an error beyond MOST_COLUMNS; None gives only the columns of types.

    A column has the value of the lowest pos (a NULL pos comes last; at equal pos the lowest text). issues is an array of
    (k, issue, v): 'conflict' for each other value of the same key, 'unfit' for a value that doesn't fit its column, which
    is then NULL; with report_keyless also (NULL, 'no key', v) for each different value of an entity whose k is NULL, which
    no column can hold. Typed values are read without spaces around them, texts as they are. Rows with a NULL k or v place
    nothing, but their entity has a row; a NULL idx is an entity of its own; the empty string is a key or value like any.
    Repeated rows count once. An unknown type is text; NULL or repeated keys in types: the first name in order. An empty
    table gives an empty result. Further columns are ignored.
    """
    ship_package(tags.sparkSession)
    plain = tags.select("kind", F.col("idx").cast("bigint").alias("idx"), F.col("pos").cast("bigint").alias("pos"), "k", "v")
    named = types.where("k is not null and col_name is not null").groupBy("k").agg(F.min(F.struct("col_name", "col_type")).alias("c")).limit(MOST_TYPES + 1).collect()
    if len(named) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} typed keys")
    columns = [(r.k, r.c.col_name, r.c.col_type if r.c.col_type in _SPARK else "text") for r in sorted(named, key=lambda r: r.k)]
    if column_share is not None:
        # counts without a shuffle of rows: layout alone hangs on them
        total = tags.agg(F.approx_count_distinct(F.xxhash64("kind", "idx"), 0.02).alias("n")).first().n
        counts = tags.where("k is not null and v is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1.0, total * column_share))
        known = {c[0] for c in columns}
        wide = sorted(r.k for r in counts.select("k").limit(MOST_COLUMNS + 1).collect())
        if len(wide) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} keys would get a column; a larger column_share leaves the rarer ones in the map")
        wide = [k for k in wide if k not in known]
        columns += [(k, c, "text") for k, c in zip(wide, column_names(wide, {"kind", "idx", "other", "issues", *(c[1] for c in columns)}), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, rows = _Chunk(columns, report_keyless), [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < _CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            new = np.flatnonzero(_changes(table.column(0).combine_chunks(), table.column(1).combine_chunks()))
            cut = int(new[-1])  # the last entity may go on
            if cut:
                yield chunk.widen(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = len(table) - cut
        if held:
            yield chunk.widen(pa.Table.from_batches(held).combine_chunks())

    schema = "kind string, idx bigint, " + "".join(f"`{c.replace('`', '``')}` {_SPARK[t]}, " for _, c, t in columns) + "other map<string,string>, issues array<struct<k: string, issue: string, v: string>>"
    # one exchange by entity serves both the set of rows and their order; repeats within an entity of many rows go before it
    hot = is_hot(["kind", "idx"], plain)
    once = plain if hot is None else plain.where(~hot).unionByName(plain.where(hot).distinct())
    ordered = once.repartition("kind", "idx").distinct().sortWithinPartitions("kind", "idx", "k", F.col("pos").asc_nulls_last(), "v")
    wide = ordered.select("kind", "idx", "k", "v").mapInArrow(run, schema)
    return wide.select("kind", "idx", *[F.col(f"`{c.replace('`', '``')}`").alias(c, metadata={"key": k}) for k, c, _ in columns], "other", "issues")


def texts_of(wide: DataFrame) -> DataFrame:
    """(kind, idx, k, v): widen()'s result as rows again, as far as its values are texts."""
    columns = [f for f in wide.schema if "key" in f.metadata and f.dataType.typeName() == "string"]
    held = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f.metadata["key"]) for f in columns]), F.array(*[F.col(f"`{f.name.replace('`', '``')}`") for f in columns])), lambda _, v: v.isNotNull()) if columns else None
    every = F.col("other") if held is None else F.map_concat(held, "other")
    return wide.select("kind", "idx", F.explode(every).alias("k", "v"))
