"""Brute-force versions and awkward inputs shared by the tests of recordlake.llm."""

import random
import re

import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, lower=True):
    data = (text or "").encode()
    return [w.decode() for w in WORD.findall(data.translate(LOWER) if lower else data)]


def shingles(w, size=5):
    if not w:
        return set()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def roots(ids, linked):
    """Smallest id reachable, by union of all linked pairs."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def prose(rng, n, vocabulary=2000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


#: Texts every operator must take: null, empty, blanks, one word, non-ASCII, special strings, one very long.
AWKWARD = [None, "", " \n\t ", "a", "Straße ΣΑΣ naïve — 日本語 \U0001f600", "x<|endoftext|>y <s> </s> ▁▁ a",
           "ab\x00cd\x85e\xa0f\x1cg", "the " * 30_000, "z" * 5_000]


def documents(spark, texts, ids=None):
    """Documents with clashing and surplus columns."""
    rows = [(i, t, "en", "score", 1, "x") for i, t in zip(ids if ids is not None else range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string, id long, `a b` string")


def rng(seed=1):
    return random.Random(seed)


public_tokenizers = pytest.importorskip("public_tokenizers")
