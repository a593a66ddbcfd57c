"""BPE by recursive queries (11): exact against the tiktoken library."""

import hashlib
import random

import numpy as np
import pytest
from llm_helpers import AWKWARD, documents, public_tokenizers

from recordlake.llm import recursive_bpe as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return B.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    return AWKWARD + ["".join(rng.choice("abcdeéß'!<|>   \n12²ñÑ▁日本՘　") for _ in range(200)) for _ in range(60)] + [
        "".join(rng.choice(["the", "ing", " ", "  ", "er", "ation", ",", ".", "\n", "un"]) for _ in range(150)) for _ in range(60)] + [
        "".join(map(chr, range(0x20, 0x3000))), "\U00012000\U00011da0 x\U0002ebf0\U0001e6c0 9\U00011bf0",
        "".join(rng.choice("abcdefghij") for _ in range(3000)), "abc" * 3000, "ab" * 2001 + "c" * 999]


def test_codec_is_the_library(spark, odd, library):
    got = {r.doc_id: r for r in B.encode_decode(documents(spark, odd), PATH, PATTERN).collect()}
    digests = {r.doc_id: r for r in B.encode_decode(documents(spark, odd), PATH, PATTERN, digests=True).collect()}
    for i, text in enumerate(odd):
        ids = library.encode_ordinary(text or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == digests[i].n_tokens == len(ids), i
        decoded = library.decode_bytes(ids)
        assert bytes(got[i].decoded) == decoded
        assert digests[i].ids_sha256 == hashlib.sha256(bytes(got[i].ids)).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded).hexdigest()


def test_words_are_the_library(own, library):
    rng = random.Random(5)
    tokens = [t.decode() for t in own.ranks if 1 < len(t) and t.isalpha()]
    words = ["".join(rng.choice(tokens) for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    words += ["".join(rng.choice("aeiournst") for _ in range(n)) for n in (127, 128, 129, 191, 192, 193, 700, 40_000)]
    words += ["".join(rng.choice("日本語学校生先大小中") for _ in range(n)) for n in (40, 60, 500)]
    words += [c * n for c in ("z", "ab", "aaab", "é", "xyzzy") for n in (129, 500, 5000)]
    for word, ids in zip(words, own.encode_words([w.encode() for w in words])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(word), word[:50]


def test_every_pair_at_once_is_one_after_the_other(own, library):
    rng = random.Random(6)
    assert own.merges.ordered
    for word in ["z" * 300, "abc" * 60, "".join(rng.choice("abcde") for _ in range(400)), "banana" * 40]:
        assert own._whole(word.encode()).tolist() == library.encode_ordinary(word)


def test_whole_words_in_few_rounds_at_a_time(own, library, monkeypatch):
    monkeypatch.setattr(B, "QUERY_ROWS", 1000)
    word = "".join(random.Random(7).choice("abcde") for _ in range(400))
    assert own._whole(word.encode()).tolist() == library.encode_ordinary(word)


def test_caches_and_groups_change_nothing(spark, odd, library, monkeypatch):
    fresh = B.Codec(PATH, PATTERN)
    monkeypatch.setattr(B, "CACHE_WORDS", 50)
    monkeypatch.setattr(B, "GROUP_WORDS", 100)
    for _ in range(2):
        found = [b""] * len(odd)
        for i, ids in fresh.encode_rows(odd):
            found[i] += ids
        for text, ids in zip(odd, found):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text or "")


def test_repeated_null_and_empty_tables(spark):
    rows = B.encode_decode(documents(spark, ["a b c", "a b c", None], ids=[7, 7, None]), PATH, PATTERN, digests=True).collect()
    assert len(rows) == 3 and rows[0] == rows[1] and rows[2].n_tokens == 0
    assert rows[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert B.encode_decode(documents(spark, []), PATH, PATTERN).collect() == []
