import os

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwarp.llm.byte_bpe import DEFAULT_RANKS, ByteBpe

tokenizers = pytest.importorskip("tokenizers")
JSON = os.path.join(os.path.dirname(DEFAULT_RANKS), "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(JSON), reason="no vocabulary here")


@pytest.fixture(scope="module")
def pair():
    t = tokenizers.Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return ByteBpe(), t


HARD = ["", " ", "  a", "a  ", "a \n b", "don't we'll I'm they've you're he'd it's 's's ''s 'r 're'l 'lll 'S", "x y 　z　", "1½Ⅷ 2", "  \n\n\tx", "'s", " 's", "a's b", "\x1c\x1d a\x85b᠎", "<|endoftext|> x", "감염 병원 3곳", "日本語 テスト。", "👩🏽‍🚀🇰🇷", "é̈", "'ve'v'vee", "​ ‍"]


def test_hard_cases(pair):
    own, ref = pair
    got = own.encode_batch(HARD)
    assert got == [ref.encode(x, add_special_tokens=False).ids for x in HARD]
    assert [own.decode(g) for g in got] == HARD


def test_null_and_long(pair):
    own, ref = pair
    long = "ab" * 200_000
    assert own.encode_batch([None, "", long, None]) == [[], [], ref.encode(long, add_special_tokens=False).ids, []]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'strevld \n\t 1,. "), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40), max_size=5))
def test_random(pair, texts):
    own, ref = pair
    got = own.encode_batch(texts)
    assert got == [ref.encode(x, add_special_tokens=False).ids for x in texts]


def test_offsets(pair):
    own, _ = pair
    (ids, starts), (none, _) = own.encode_batch(["it's  fine", None], offsets=True)
    assert len(ids) == len(starts) and starts[0] == 0 and none == []
    assert sorted(set(starts)) == [0, 2, 4, 5]
