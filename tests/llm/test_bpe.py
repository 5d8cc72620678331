import base64

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import bpe

with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
    RANKS = f.read()
OWN = bpe.Bpe(RANKS)
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})
PATTERN = regex.compile(public_tokenizers.PATTERN)


def check(texts):
    for text, (ids, said, cuts) in zip(texts, OWN.encode(texts), strict=True):
        assert ids.tolist() == TIK.encode_ordinary(text), text
        assert said.decode() == ",".join(map(str, ids))
        assert OWN.decode(ids).decode() == text
        raw = text.encode()
        assert [raw[a:b].decode() for a, b in zip(cuts, cuts[1:])] == PATTERN.findall(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'strevmldLS é1²  \n\t 　!|中😀"), max_size=40), max_size=6))
def test_as_the_pattern_and_tiktoken(texts):
    check(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_text(texts):
    check(texts)


def test_every_code_point():
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    check(["".join(map(chr, points[i : i + 997])) for i in range(0, len(points), 997 * 9)])


@pytest.mark.parametrize("text", ["", "'s", " 's", "\n's", "x's's", "!'re", "'re'v", "'ll'l", "a  b", "a   ", " \n ", "'", "don't 'tis"])
def test_cases(text):
    check([text, "", text])


def test_long_slices():
    check(["ab" * 3000 + "!" * 5000 + "é" * 2000, "x" * 70])


def test_query(spark):
    rows = spark.createDataFrame([(1, None, "z"), (2, "", None), (3, "the the", "q"), (3, "the the", "q"), (None, "a 'll", "")], "doc_id long, text string, ids string")
    out = bpe.ByteBpe().encode(rows)
    assert out.columns == ["doc_id", "text", "ids", "slice_offsets"]
    got = out.collect()
    assert [r.ids for r in got] == [TIK.encode_ordinary(t or "") for t in (None, "", "the the", "the the", "a 'll")]
    assert bpe.ByteBpe().digests(rows).count() == 5 and bpe.ByteBpe().digests(rows.limit(0)).count() == 0


def test_more_slices_than_the_cache_holds():
    small = bpe.Bpe(RANKS, cached=3)
    for text in ("one two three four five", "six seven eight", "one two"):
        assert [x.tolist() for x, _, _ in small.encode([text])] == [TIK.encode_ordinary(text)]
