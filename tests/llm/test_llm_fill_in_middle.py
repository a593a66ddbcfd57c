"""Fill-in-the-middle (13): against a plain version over token lists, and exact round trips."""

import hashlib
import random
import re

import numpy as np
import pytest
from llm_helpers import AWKWARD, documents

from recordlake.llm import fill_in_middle as M

TOKENS = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    tokens = TOKENS.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(4)
    shared = " ".join(f"w{rng.randrange(500)}" for _ in range(3000))
    return AWKWARD + ["a <P> b", "x<M>", "<", "<P", "S>", "  lead", "trail\n\n", " wide\xa0", "a<S", "<S>" * 9] + [
        "".join(rng.choice(["a", "é", "日", " ", "\n", "\t", "<", ">", "P", "\U0001f600"]) for _ in range(rng.randrange(1, 80)))
        for _ in range(120)] + [f"{k} {shared} tail {k}" for k in range(20)] + [shared + " " * 20_000 + shared, "\n" * 9000]


def test_transform_is_the_plain_version(spark, odd):
    got = {r.doc_id: r for r in M.transform(documents(spark, odd)).collect()}
    digests = {r.doc_id: r for r in M.transform(documents(spark, odd), digests=True).collect()}
    forms = set()
    for i, text in enumerate(odd):
        want = plain_version(i, text)
        r, d = got[i], digests[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want, i
        assert (d.n, d.form, d.prefix_chars, d.middle_chars) == want[:4]
        assert d.output_sha256 == hashlib.sha256(want[4].encode()).hexdigest()
        assert d.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}


def test_restored_by_column_functions(spark, odd):
    rows = M.restored(M.transform(documents(spark, odd), plain_percent=0)).collect()
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert all(r.text == (odd[r.doc_id] or "") for r in rows)


def test_chunks_follow_the_content():
    rng = random.Random(8)
    shared = bytes(rng.randrange(97, 123) for _ in range(60_000))
    chunks = []
    for lead in (b"", b"x" * 777, bytes(rng.randrange(97, 123) for _ in range(5_000))):
        text = lead + shared
        ends = M.cut_places(text)
        assert ends[-1] == len(text) and max(np.diff([0, *ends])) <= M.MOST
        chunks.append({text[a:b] for a, b in zip([0, *ends], ends)})
    assert len(chunks[0] & chunks[1]) > 0.8 * len(chunks[0]) and len(chunks[0] & chunks[2]) > 0.8 * len(chunks[0])


def test_hash_does_not_depend_on_blocks(monkeypatch):
    rng = random.Random(9)
    text = bytes(rng.randrange(32, 64) for _ in range(50_000))
    whole = M.cut_places(text)
    for block in (64, 1000, 4097):
        monkeypatch.setattr(M, "BLOCK_BYTES", block)
        assert M.cut_places(text) == whole


def test_cache_is_used_bounded_and_exact():
    rng = random.Random(10)
    shared = " ".join(f"w{rng.randrange(900)}" for _ in range(20_000)).encode()
    cutter = M.Cutter()
    for k in range(5):
        cutter.tokens(f"{k} ".encode() + shared)
    assert cutter.cache.made < 1.2 * len(M.cut_places(shared)) + 10
    cutter.cache = M.ChunkCache(limit=10_000)
    for k in range(50):
        text = f"{k} ".encode() * 700 + shared[k * 100:k * 100 + 5000]
        assert cutter.tokens(text)[0] == len(TOKENS.findall(text.decode()))
    assert cutter.cache.held <= 10_000 + 2 * M.MOST + 200


def test_repeated_null_and_empty_tables(spark):
    rows = M.transform(documents(spark, ["a b c", "a b c", None], ids=[7, 7, None])).collect()
    assert len(rows) == 3 and rows[0] == rows[1]
    assert M.transform(documents(spark, [])).collect() == []
    assert M.transform(documents(spark, ["a"])).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
