import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parchmill.llm import tokenize as K

FILE = f"{K.VOCAB_DIR}/byte_bpe_50k.tiktoken"
if not os.path.exists(FILE):
    pytest.skip("the vocabulary is not here", allow_module_level=True)
tiktoken = pytest.importorskip("tiktoken")
RANKS = K.parse_ranks(open(FILE, "rb").read())
BPE = K.RankArrayBPE(RANKS, K.default_pattern())
PLAIN = tiktoken.Encoding("own", pat_str=K.default_pattern(), mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_against_the_library(text):
    assert BPE.encode(text) == PLAIN.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, "<|endoftext|>", "ก" * 700, " \n\n \t x", "👩‍🌾🇺🇳", "ab" * 300, "x\x00y�"])
def test_hard_texts(text):
    assert BPE.encode(text) == PLAIN.encode_ordinary(text)


def test_both_ways_agree():
    for text in ("abab" * 20, "the the", "ÿþ" * 30, "zzzzzzzzzzzz"):
        raw = text.encode()
        assert BPE._long(raw) == BPE._short(raw)


def test_operator(spark, frame):
    df = frame([(1, "Hi there"), (2, ""), (3, None), (4, " "), (1, "Hi there")], "doc_id long, text string").selectExpr("*", "'clash' as ids")
    got = [(r["doc_id"], r["ids"]) for r in K.token_ids(spark, df).collect()]
    assert got == [(1, PLAIN.encode_ordinary("Hi there")), (2, []), (3, []), (4, PLAIN.encode_ordinary(" ")), (1, PLAIN.encode_ordinary("Hi there"))]
    assert K.token_ids(spark, df.limit(0)).count() == 0
