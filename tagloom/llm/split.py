"""Splitting oversized texts: recursive bisection at the strongest boundary near the midpoint, then overlaps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.core import ship_package, spread
from tagloom.llm.bpe import VOCABULARY_FOLDER, ByteBpe, loaded, read_vocabulary

#: Natural places of a message, the strongest first. A cut is made where a match ends.
BOUNDARIES = (
    (7, re.compile(r"\n(?=--[^\s-][^\n]*\r?\n)")),  # part of a multipart body
    (6, re.compile(r"\n(?=(?:-{2,} ?(?:Original|Forwarded)[^\n]*|On [^\n]{5,200} wrote:|Am [^\n]{5,200} schrieb[^\n]*:)\r?\n)")),  # quoted or forwarded message
    (5, re.compile(r"\n(?=(?:-- ?|[_*=]{5,}|-{5,})\r?\n)")),  # signature or disclaimer
    (4, re.compile(r"\n[ \t\r]*\n(?=\S)")),  # paragraph
    (3, re.compile(r"\n(?=\S)|\r(?!\n)")),  # line
    (2, re.compile(r"""[.!?…。！？]["'”’)\]]*(?=\s)|[。！？]""")),  # sentence
    (1, re.compile(r"(?<=\S)(?=[ \t])")),  # word
)
#: A word of more tokens may be cut inside, after so many characters; fewer where a piece has no room for them.
_LONG_WORD, _WORD_CHARS = 64, 32
#: Tokens by which the ends of a stretch may change its number; nearer to the limit it is counted again.
_EDGE = 64


class Splitter:
    """Cuts one text after another."""

    def __init__(self, bpe: ByteBpe, limit: int, overlap: int):
        if not 0 <= overlap < limit or limit - overlap < 8:
            raise ValueError("limit must exceed overlap by 8 tokens at least")
        self.bpe, self.limit, self.overlap = bpe, limit, overlap
        # a character has four bytes at most, and a byte is a token at most
        self.long_word, self.word_chars = min(_LONG_WORD, limit - overlap), min(_WORD_CHARS, (limit - overlap) // 4)

    def _measure(self, text: str) -> int:
        """Take in the words of a text; gives its number of tokens."""
        bpe = self.bpe
        words = bpe.words(text)
        counts = list(map(len, map(bpe.word_ids, words)))
        total = sum(counts)
        if total <= self.limit:
            return total
        starts, tokens, chunks, at = [], [], [], 0
        for word, n in zip(words, counts, strict=True):
            if n > self.long_word:
                for i in range(0, len(word), self.word_chars):
                    starts.append(at + i)
                    tokens.append(len(bpe.merge(word[i : i + self.word_chars].encode())))
                    chunks.append(1)
            else:
                starts.append(at)
                tokens.append(n)
                chunks.append(0)
            at += len(word)
        self.text = text
        self.starts = np.array([*starts, at])
        self.upto = np.concatenate([[0], np.cumsum(tokens)])
        self.chunks = np.concatenate([[0], np.cumsum(chunks)])
        self.strength = np.zeros(len(starts) + 1, np.int8)
        for strength, pattern in reversed(BOUNDARIES):
            ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
            where = np.searchsorted(self.starts, ends)
            where = where[self.starts[np.minimum(where, len(self.starts) - 1)] == ends]
            self.strength[where] = strength
        return total

    def _bodies(self, i: int, j: int) -> Iterator[tuple[int, int]]:
        """Words i to j as consecutive ranges of at most limit - overlap tokens."""
        stack = [(i, j)]
        while stack:
            i, j = stack.pop()
            size = int(self.upto[j] - self.upto[i])
            most = self.limit - self.overlap
            # cut out of the text, a stretch may have a few tokens more or fewer at its ends; parts of a long word need not add up
            clear = size <= most - _EDGE and self.chunks[i] == self.chunks[j]
            if j - i == 1 or clear or size <= most and self.bpe.count(self.text[self.starts[i] : self.starts[j]]) <= most:
                yield i, j
                continue
            middle = (self.upto[i] + self.upto[j]) / 2
            low, high = np.searchsorted(self.upto, [middle - size / 4, middle + size / 4])
            low, high = max(i + 1, int(low)), min(j - 1, int(high))
            if low > high:
                low = high = min(max(i + 1, low), j - 1)
            near = np.arange(low, high + 1)
            cut = int(near[np.lexsort((np.abs(self.upto[near] - middle), -self.strength[near]))[0]])
            stack += [(cut, j), (i, cut)]

    def _overlap_start(self, word: int, first: int) -> int:
        """Character from which the overlap before this word runs, not before the character `first`."""
        if not self.overlap:
            return int(self.starts[word])
        at = int(np.searchsorted(self.upto, self.upto[word] - self.overlap, "right")) - 1
        at = max(at, 0)
        extra = int(self.upto[word] - self.overlap - self.upto[at])  # tokens of the word `at` that are too many
        start = int(self.starts[at])
        if extra > 0:
            ids = self.bpe.encode(self.text[start : self.starts[at + 1]])
            inside = int(self.starts[at + 1])
            for k in range(extra, len(ids)):
                try:
                    inside = start + len(self.bpe.decode_bytes(ids[:k]).decode())
                    break
                except UnicodeDecodeError:
                    continue
            start = inside
        return max(start, first)

    def split(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(overlap start, body start, end, tokens, tokens of the overlap) of each piece, in characters; [] if text fits."""
        if not text or len(text.encode()) <= self.limit or self._measure(text) <= self.limit:
            return []
        out: list[tuple[int, int, int, int, int]] = []
        for i, j in self._bodies(0, len(self.starts) - 1):
            body, end = int(self.starts[i]), int(self.starts[j])
            start = self._overlap_start(i, out[-1][0]) if out else body
            while (n := self.bpe.count(text[start:end])) > self.limit and start < body:
                start += 1
            out.append((start, body, end, n, self.bpe.count(text[start:body])))
        return out


def split_oversized(
    docs: DataFrame, limit: int = 3000, overlap: int = 150, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARY_FOLDER
) -> DataFrame:
    """(id_col, piece, char_start, char_body, char_end, tokens, overlap_tokens, text) of every text of more than limit tokens.

    piece counts from 0. A piece is text[char_start:char_end] (code points) and has at most limit tokens, overlap included;
    the bodies text[char_body:char_end] of a document follow each other without gap and make up the whole text. What lies
    before char_body repeats the end of the piece before: the number of tokens asked for, or a few fewer where a token
    ends within a character (overlap_tokens has the number). Cuts are made at the strongest natural boundary near the
    midpoint, else between words, else within a word that is too long. Of boundaries alike the one nearest to the
    midpoint is taken, of two as near the first. A single character of more than limit - overlap tokens can't occur.

    Texts of limit tokens or fewer, NULL and empty texts give no row. Repeated rows are split each. An empty table gives
    an empty result. Further columns are ignored. A text of no more than limit bytes has no more tokens than that and isn't
    encoded. One narrow pass; no shuffle, unless the scan has fewer parts than there are cores.
    """
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(tokenizer, folder))
    names = [id_col, "piece", "char_start", "char_body", "char_end", "tokens", "overlap_tokens", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(loaded(vocabulary.value), limit, overlap)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                of, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    for k, (start, body, end, n, shared) in enumerate(splitter.split(text)):
                        of.append(i)
                        rows.append((k, start, body, end, n, shared, text[start:end]))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return (
        spread(docs.select(id_col, text_col).where(F.octet_length(text_col) > limit))
        .mapInArrow(run, f"`{id_col}` {kind}, piece int, char_start bigint, char_body bigint, char_end bigint, tokens int, overlap_tokens int, text string")
    )
