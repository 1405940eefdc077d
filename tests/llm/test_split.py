import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.llm.bpe import loaded, read_vocabulary
from tagloom.llm.split import Splitter, split_oversized

BPE = loaded(read_vocabulary())


def check(text, limit, overlap):
    pieces = Splitter(BPE, limit, overlap).split(text)
    if BPE.count(text) <= limit:
        assert pieces == []
        return pieces
    assert len(pieces) > 1
    assert "".join(text[b:e] for _, b, e, _, _ in pieces) == text
    for i, (start, body, end, n, shared) in enumerate(pieces):
        assert n == BPE.count(text[start:end]) <= limit
        assert start <= body < end
        assert shared == BPE.count(text[start:body])
        if i:
            assert pieces[i - 1][2] == body and start >= pieces[i - 1][0]
    return pieces


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n.世é😀-1<"), min_size=40, max_size=600), st.integers(12, 60), st.integers(0, 4))
def test_any_text(text, limit, overlap):
    check(text, limit, overlap)


def _prose(n, seed=1):
    r = random.Random(seed)
    return "\n\n".join(" ".join("".join(r.choices("abcdefg", k=r.randint(2, 7))) for _ in range(r.randint(20, 80))) + "." for _ in range(n))


def test_paragraphs_are_kept(spark):
    text = _prose(60)
    pieces = check(text, 800, 40)
    assert all(text[b - 2 : b] == "\n\n" for _, b, _, _, _ in pieces[1:])
    assert all(35 <= s <= 40 for *_, s in pieces[1:])


def test_stronger_boundaries_win():
    text = "word " * 300 + "\n-- \nsignature\n\n" + "more " * 300
    pieces = check(text, 400, 0)
    assert any(text[b:].startswith("-- \n") for _, b, _, _, _ in pieces)


@pytest.mark.parametrize("text", ["a" * 40_000, "世" * 9000, "😀" * 4000, " " * 30_000, "x1" * 20_000, "\n" * 20_000, "--=_b\n" * 4000])
def test_without_natural_places(text):
    check(text, 3000, 150)


def test_table(spark):
    long_ = _prose(300, 2)
    rows = [(1, long_, "a", 1), (2, "short", "b", 2), (3, None, None, None), (4, "", "c", 4), (None, long_, "d", 5), (1, long_, "a", 1)]
    out = split_oversized(spark.createDataFrame(rows, "doc_id bigint, text string, piece string, tokens int"), 3000, 150).collect()
    assert {r.doc_id for r in out} == {1, None}
    mine = sorted((r for r in out if r.doc_id is None), key=lambda r: r.piece)
    assert "".join(r.text[r.char_body - r.char_start :] for r in mine) == long_
    assert [r.piece for r in mine] == list(range(len(mine))) and len(out) == 3 * len(mine)
    assert all(r.tokens <= 3000 and 140 <= r.overlap_tokens <= 150 for r in mine[1:])
    assert split_oversized(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_exactly_at_the_limit():
    assert Splitter(BPE, 100, 10).split(" a" * 100) == []
    assert Splitter(BPE, 100, 10).split(" a" * 101) != []
    with pytest.raises(ValueError, match="limit"):
        Splitter(BPE, 10, 5)


@pytest.mark.parametrize(("limit", "overlap"), [(8, 0), (12, 4), (60, 4), (60, 52), (100, 50), (130, 0)])
def test_long_words_under_small_limits(limit, overlap):
    r = random.Random(limit)
    odd = "".join(chr(r.randint(0x13000, 0x13400)) for _ in range(300))
    unlike = "".join(r.choices("qxzjvkwQXZJVK", k=400))
    for text in (odd, unlike, f"a {odd[:12]} b {unlike[:80]} c" * 5, "😀世" * 90, unlike[:90]):
        check(text, limit, overlap)
