import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm.bpe import WORD_PATTERN, ByteBpe, count_tokens, encode_corpus, read_vocabulary

NAMES = ("byte_bpe_50k", "byte_bpe_multi_50k")


@pytest.fixture(scope="module")
def both():
    out = []
    for name in NAMES:
        bpe = ByteBpe(read_vocabulary(name))
        out.append((bpe, tiktoken.Encoding(name, pat_str=WORD_PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})))
    return out


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200))
def test_any_text(both, text):
    for bpe, other in both:
        ids = bpe.encode(text)
        assert ids == other.encode_ordinary(text)
        assert bpe.count(text) == len(ids)
        assert bpe.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=" \n\t\r\x0b\x1c\x85\xa0 aZé1!'<|>世", max_size=60))
def test_white_space(both, text):
    for bpe, other in both:
        assert bpe.encode(text) == other.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 5000, "\n" * 5000, "0123456789" * 2000, "ab " * 20_000, "世界" * 3000, "<|endoftext|>", "!?" * 9000])
def test_long_runs(both, text):
    for bpe, other in both:
        assert bpe.encode(text) == other.encode_ordinary(text)


def test_caches_overflow(both, monkeypatch):
    import tagloom.llm.bpe as module

    monkeypatch.setattr(module, "CACHED_PARTS", 50)
    monkeypatch.setattr(module, "CACHED_PAIRS", 50)
    bpe, other = ByteBpe(read_vocabulary()), both[0][1]
    r = random.Random(1)
    for _ in range(50):
        text = " ".join("".join(r.choices("abcxyz0189-", k=r.randint(1, 12))) for _ in range(40))
        assert bpe.encode(text) == other.encode_ordinary(text)


def test_own_pattern():
    bpe = ByteBpe(read_vocabulary(), r"\S+|\s+")
    other = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=bpe.ranks, special_tokens={})
    assert bpe.encode("two words, more 12") == other.encode_ordinary("two words, more 12")


def test_ids_out_of_a_character(both):
    bpe = both[0][0]
    ids = bpe.encode("世")
    assert b"".join(bpe.symbols[i] for i in ids) == "世".encode()
    assert "�" in bpe.decode(ids[:1])


def test_corpus(spark, both):
    rows = [(1, "Hello world", "a"), (2, None, None), (3, "", "b"), (3, "", "b"), (None, " \n", "c"), (4, "x y " * 50_000, "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = encode_corpus(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = [(r.doc_id, r.ids) for r in out.collect()]
    bpe = both[0][0]
    assert sorted(got, key=repr) == sorted([(i, bpe.encode(t)) for i, t, _ in rows], key=repr)
    assert got[1][1] == [] and got[2][1] == []
    assert encode_corpus(df.limit(0)).count() == 0
    counts = count_tokens(df, keep=("doc_id", "ids")).collect()
    assert sorted((r.tokens for r in counts)) == sorted(len(x) for _, x in got)
    strange = spark.createDataFrame([("k", "b")], "`a doc` string, `the text` string")
    assert encode_corpus(strange, "a doc", "the text").first().ids == bpe.encode("b")
