"""Byte-level BPE against the tiktoken library, and exact round trips."""

import base64
import random

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from medallion.llm import bpe

from tests.llm.conftest import EDGE_ROWS, by_key, rows_of

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    with open(RANKS, "rb") as f:
        return bpe.load(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def encoded(own, texts):
    ids, lengths = own.encode(texts)
    return [a.tolist() for a in np.split(ids, np.cumsum(lengths)[:-1])] if texts else []


ALPHABET = "ab  cdet'sre\n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　é²Ⅷ٣漢😀_-.,!ſK019‍́﻿"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=40), min_size=1, max_size=8))
def test_any_text_as_the_library(own, library, texts):
    assert encoded(own, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_words_and_special_strings(own, library):
    rng = random.Random(2)
    texts = ["a" * 5000, "ab" * 3000, "".join(rng.choices("abc", k=2500)), "😀" * 800, "<|endoftext|>", "",
             " " * 50, "x " * 500, "".join(rng.choices("abcdefgh", k=1000))]
    assert encoded(own, texts) == [library.encode_ordinary(t) for t in texts]


def test_cache_limit_changes_nothing(own, library):
    small = bpe.ChunkEncoder(own.encode_parts, max_cached=3)
    texts = [t or "" for _, t in EDGE_ROWS]
    for text in texts * 2:
        ids, _ = small.encode([text])
        assert ids.tolist() == library.encode_ordinary(text)


def test_cache_is_bounded_by_characters_too(own, library):
    small = bpe.ChunkEncoder(own.encode_parts, max_chars=2000)
    for i in range(30):
        text = f"a{i} " + " ".join("xyz"[i % 3] * (i + k) for k in range(40)) + " " + "q" * (100 * i)
        assert small.encode([text])[0].tolist() == library.encode_ordinary(text)
        assert sum(len(c) for c in small.numbers) <= 2000 + 2 * len(text)


def test_pair_table_knows_its_pairs_only():
    table = bpe.PairTable(np.array([1, 2, 3]), np.array([4, 5, 6]), np.array([7, 8, 9], dtype=np.int32))
    left, right = np.array([[1, 2, 3, 1, -1]]), np.array([[4, 5, 6, 5, 4]])
    assert table.get(left, right).tolist() == [[7, 8, 9, bpe.NONE, bpe.NONE]]


def test_spark_round_trip(edge_docs, library):
    want = by_key([(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in EDGE_ROWS])
    for trip in (bpe.round_trip(edge_docs, RANKS, P.PATTERN), bpe.decode(bpe.encode(edge_docs, RANKS, P.PATTERN), RANKS)):
        assert by_key([(i, list(ids), bytes(b)) for i, ids, b in rows_of(trip)]) == want


def test_empty_table(no_docs):
    assert rows_of(bpe.round_trip(no_docs, RANKS, P.PATTERN)) == [] == rows_of(
        bpe.decode(bpe.encode(no_docs, RANKS, P.PATTERN), RANKS))


def test_rank_file_is_a_fixed_size(own):
    with open(RANKS, "rb") as f:
        assert len(own.ranks) == sum(1 for line in f if line.strip()) == 50256
    assert base64.b64decode(base64.b64encode(b"x")) == b"x"
