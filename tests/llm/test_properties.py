"""Whatever the text: the same as the library, or as plain Python."""

import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidara.llm import bpe, pii, quality, sharding, token_store, toxicity

from . import test_pii, test_quality

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")

MANY = settings(max_examples=300, deadline=None)
TEXT = st.one_of(st.text(max_size=60), st.text(alphabet="ab e.,!'s\n\t0é|", max_size=80), st.text(alphabet=" \n\xa0 a", max_size=20))

with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
    RAW = f.read()
OWN = bpe.ByteBPE(RAW, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}, special_tokens={})
with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
    SPEC = f.read()
CHUNKED, WHOLE = token_store._Encoder(SPEC), tokenizers.Tokenizer.from_str(SPEC)


@MANY
@given(TEXT)
def test_bpe_is_tiktoken(text):
    ids = OWN.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == THEIRS.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


@MANY
@given(st.lists(TEXT, max_size=5))
def test_chunked_encoding_is_the_tokenizers_library(texts):
    want = [np.array(WHOLE.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert CHUNKED.encode_all(texts) == want


@MANY
@given(st.one_of(st.text(max_size=80), st.text(alphabet="a.@-+%_ 0123456789()é", max_size=60)))
def test_base_spans_are_finditer(text):
    assert pii.base_spans(text) == test_pii.brute(text)


@MANY
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab \n|#", max_size=60)))
def test_quality_counts(text):
    assert quality.base_counts(text) == test_quality.brute(text)


@MANY
@given(st.text(max_size=60))
def test_fold_keeps_places(text):
    assert len(toxicity.fold(text)) == len(text)


@MANY
@given(st.integers(1, 1 << 40), st.integers(0, 1 << 30), st.integers(0, 1 << 40))
def test_places_of_rows_come_back(n, seed, number):
    shard, slot = sharding.locate(number % n, n, 40, seed)
    assert sharding.row_at(shard, slot, n, 40, seed) == number % n


@MANY
@given(st.sets(st.integers(-(1 << 63), (1 << 63) - 1), max_size=200))
def test_perfect_hash_of_any_keys(keys):
    keys = np.array(sorted(keys), np.int64)
    mph = token_store.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
