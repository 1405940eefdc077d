"""Byte-level BPE over a whole corpus: heap of merge ranks on a linked list of symbols.

A text is cut into words by the tokenizer's pattern. Each word is a doubly linked list of byte symbols; a heap holds the
rank and place of every adjacent pair that the vocabulary can merge. The lowest rank is taken first; an entry whose pair
was changed by an earlier merge is stale and skipped. Words already seen are kept in a bounded cache of the worker.
Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tagloom.core import ship_package, spread

#: The folder of the public vocabularies, and the pattern that cuts texts into words for them.
VOCABULARY_FOLDER = "/opt/tokenizers"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Before a space with a visible ASCII character behind it a new word always starts, so texts may be cut there and the parts looked up.
_PART = re.compile(r" (?=[!-~])")
#: Ids that are handed on at once.
MOST_IDS = 1_000_000
CACHED_PARTS, CACHED_PAIRS, LONGEST_CACHED = 400_000, 2_000_000, 64


class _Pairs(dict):
    """(left id << 20 | right id) -> id of the merged symbol, or -1; filled on demand."""

    def __init__(self, ranks: dict[bytes, int], symbols: list[bytes]):
        self.ranks, self.symbols = ranks, symbols

    def __missing__(self, pair: int) -> int:
        if len(self) >= CACHED_PAIRS:
            self.clear()
        merged = self.ranks.get(self.symbols[pair >> 20] + self.symbols[pair & 0xFFFFF], -1)
        self[pair] = merged
        return merged


class _Parts(dict):
    """Text part -> its ids; filled on demand and emptied when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.encode(part)
        if len(part) <= LONGEST_CACHED:
            if len(self) >= CACHED_PARTS:
                self.clear()
            self[part] = ids
        return ids


class ByteBpe:
    """A byte-level BPE vocabulary, given as lines of base64 symbol and rank; ids are ranks."""

    def __init__(self, vocabulary: bytes, pattern: str = WORD_PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.symbols = [b""] * (max(self.ranks.values()) + 1)
        for symbol, rank in self.ranks.items():
            self.symbols[rank] = symbol
        self._byte = [self.ranks[bytes([b])] for b in range(256)]
        self._words = regex.compile(pattern).findall
        self._pairs = _Pairs(self.ranks, self.symbols)
        self._word_ids: dict[str, tuple[int, ...]] = {}
        self._parts = _Parts(self._encode_part)
        self.cacheable = pattern == WORD_PATTERN

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word."""
        known = self.ranks.get(word)
        if known is not None:
            return (known,)
        ids = [self._byte[b] for b in word]
        n, pairs = len(ids), self._pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [m << 32 | i for i in range(n - 1) if (m := pairs[ids[i] << 20 | ids[i + 1]]) >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, merged = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if ids[i] < 0 or j >= n or pairs[ids[i] << 20 | ids[j]] != merged:
                continue  # stale
            ids[i], ids[j] = merged, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (m := pairs[merged << 20 | ids[j]]) >= 0:
                    heappush(heap, m << 32 | i)
            j = before[i]
            if j >= 0 and (m := pairs[ids[j] << 20 | merged]) >= 0:
                heappush(heap, m << 32 | j)
        return tuple(x for x in ids if x >= 0)

    def word_ids(self, word: str) -> tuple[int, ...]:
        ids = self._word_ids.get(word)
        if ids is None:
            ids = self.merge(word.encode())
            if len(word) <= LONGEST_CACHED:
                if len(self._word_ids) >= CACHED_PARTS:
                    self._word_ids.clear()
                self._word_ids[word] = ids
        return ids

    def _encode_part(self, part: str) -> tuple[int, ...]:
        words = self._words(part)
        if len(words) == 1:
            return self.word_ids(words[0])
        return tuple(chain.from_iterable(map(self.word_ids, words)))

    def pieces(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids of text, part by part."""
        if not self.cacheable:
            return iter((self._encode_part(text),))
        first, *rest = _PART.split(text)
        return chain((self._encode_part(first),), map(self._parts.__getitem__, [" " + x for x in rest]))

    def encode(self, text: str | None) -> list[int]:
        """Ids of text without special tokens; none for None and for the empty text."""
        return list(chain.from_iterable(self.pieces(text))) if text else []

    def count(self, text: str | None) -> int:
        """How many ids encode(text) has."""
        return sum(map(len, self.pieces(text))) if text else 0

    def words(self, text: str) -> list[str]:
        return self._words(text)

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.symbols.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text again; ids cut within a character give U+FFFD there."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(vocabulary: bytes, pattern: str = WORD_PATTERN) -> ByteBpe:
    """The tokenizer of this vocabulary, built once in a Python worker."""
    key = hashlib.sha256(vocabulary + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(vocabulary, pattern)
    return _LOADED[key]


def read_vocabulary(name: str = "byte_bpe_50k", folder: str = VOCABULARY_FOLDER) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def encode_corpus(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARY_FOLDER
) -> DataFrame:
    """(id_col, ids ARRAY<INT>): the ids of every text, without special tokens.

    NULL and empty texts give an empty list, never NULL. Every row of docs gives one row: repeated ids and NULL ids stay.
    Texts of any length are encoded whole; texts of only white space have the ids of that white space. An empty table
    gives an empty table. Further columns of docs are ignored. One narrow pass; no shuffle, unless the scan has fewer parts than there are cores.
    """
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary.value)
        for batch in batches:
            start, flat, ends = 0, [], [0]
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                flat.append(np.fromiter(chain.from_iterable(bpe.pieces(text)), np.int32) if text else np.empty(0, np.int32))
                ends.append(ends[-1] + len(flat[-1]))
                if i + 1 == batch.num_rows or ends[-1] >= MOST_IDS:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), lists], [id_col, "ids"])
                    start, flat, ends = i + 1, [], [0]

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(
    docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "tokens", tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARY_FOLDER
) -> DataFrame:
    """The columns keep and the number of ids of text_col (0 for NULL and empty texts), in one pass like encode_corpus()."""
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary.value)
        for batch in batches:
            counts = [bpe.count(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], [*keep, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return spread(docs.select(text_col, *keep)).mapInArrow(run, f"{fields}, `{name}` bigint")
