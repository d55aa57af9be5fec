from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from apilens.llm.byte_bpe import VOCABULARY, encode_documents, tokenizer


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path(VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tokenizer(path, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(both, text):
    ids = both[0].encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == both[1].encode_ordinary(text)
    assert both[0].decode(ids) == text.encode()


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abet ing'sTHE  \n\t\x1c\x85²Ⅷ09é中😀!-"), max_size=80))
def test_like_tiktoken(both, text):
    same(both, text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(both, text):
    same(both, text)


@pytest.mark.parametrize("text", ["", "a" * 3000, "ab" * 2000, "the" * 1500, "é" * 2000, "!?" * 1000, " " * 2000, "<|endoftext|>"])
def test_long_runs(both, text):
    same(both, text)


def test_frame(spark):
    df = spark.createDataFrame([(1, "Hello there", 7), (None, None, 8), (2, "", 9), (2, "", 9)], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, len(r.ids)) for r in encode_documents(df).collect()), key=str)
    none = hashlib.sha256(b"").hexdigest()
    assert [g for g in got if g[0] != 1] == [(2, 0, none, none, 0), (2, 0, none, none, 0), (None, 0, none, none, 0)]
    assert next(g for g in got if g[0] == 1)[3] == hashlib.sha256(b"Hello there").hexdigest()
    assert encode_documents(df.limit(0)).count() == 0
