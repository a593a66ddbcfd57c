"""Packing (5), token counts (7), BPE codec (10): exact against the libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import AWKWARD, documents, public_tokenizers

from recordlake.llm import bpe_codec, packing, token_counts


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    return AWKWARD + ["".join(rng.choice("abcdeéß'!<|>   \n12²ñÑ▁") for _ in range(200)) for _ in range(60)] + [
        "".join(rng.choice(["the", "ing", " ", "  ", "er", "ation", ",", ".", "\n", "un"]) for _ in range(150)) for _ in range(60)]


def test_codec_is_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe_codec.encode_decode(documents(spark, odd), path).collect()}
    digests = {r.doc_id: r for r in bpe_codec.encode_decode(documents(spark, odd), path, digests=True).collect()}
    for i, text in enumerate(odd):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        assert bytes(got[i].decoded) == decoded
        assert digests[i].ids_sha256 == hashlib.sha256(bytes(got[i].ids)).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded).hexdigest()


def test_pairs_against_plain_merging():
    own = bpe_codec.codec(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    names = {i: t for t, i in own.vocab.items()}
    usable = [i for i in names if i not in own.pairs.broken and not names[i].endswith("</w>")]
    rank = {(names[a], names[b]): k for (a, b), k in own.pairs.rank.items()}

    def merge(parts):
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[k], parts[k + 1]) not in rank:
                break
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    for _ in range(2000):
        a, b = rng.choice(usable), rng.choice(usable)
        assert own.pairs[a, b] == (merge([*names[a], *names[b]]) == [names[a], names[b]])


def test_long_words_are_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, rng = bpe_codec.codec(path), random.Random(8)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 60_000), ("ab", 60_000), ("z", 100_000), (["the", "ing", "er", "un"], 30_000)):
        word = "".join(rng.choices(letters, k=n))
        ids = np.frombuffer(own.encode(word), "<u4")
        assert ids.tolist() == own.library.encode(word, add_special_tokens=False).ids
        assert b"".join(own.decode(ids.tobytes())).decode() == own.library.decode(ids.tolist(), skip_special_tokens=False)
        assert word not in own.codes  # only short words are kept


def test_counts_are_the_library(spark, odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in token_counts.token_counts(documents(spark, odd), path, limit=100).collect()}
    for i, text in enumerate(odd):
        n = len(library.encode(text or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 100)


def test_chunk_maps_compose(monkeypatch, odd):
    own = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    whole = [own.count(t) for t in odd]
    for size in (1, 7, 64):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert [own.count(t) for t in odd if len(t or "") < 5000] == [n for n, t in zip(whole, odd) if len(t or "") < 5000]
    monkeypatch.setattr(token_counts, "MAX_STATES", 10)
    own.recent.clear(), own.older.clear()
    assert [own.count(t) for t in odd] == whole


def test_state_maps_of_chunks_without_blanks(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library, rng = token_counts.counter(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(4)
    texts = ["z" * 100_000, "".join(rng.choices(["the", "ing", "er", "un"], k=30_000)), "".join(rng.choices("abc日本é😀", k=40_000)),
             "x" * 20_000 + " y" + "ab" * 20_000 + "  "]
    for text in texts:
        assert own.count(text) == len(library.encode(text))
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)  # states are forgotten inside a word, too
    assert own.count(texts[2]) == len(library.encode(texts[2]))
    a, b, c = (own.chunk(t) for t in ("lo wer ne", "west", "ern  a b"))
    for entered in (token_counts.START, own.machine.run(token_counts.START, "fo")[0]):
        left = a.then(b, own.machine).then(c, own.machine)(entered, own.machine)
        assert left == a.then(b.then(c, own.machine), own.machine)(entered, own.machine)
        assert left[1] == own.machine.run(entered, "lo wer newestern  a b".replace(" ", token_counts.BLANK))[1]


def brute_bins(sizes, capacity):
    """Least number of bins, by trying every bin for every piece."""
    best = len(sizes)

    def place(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(sizes):
            best = len(free)
            return
        for j in {f: j for j, f in enumerate(free)}.values():
            if free[j] >= sizes[k]:
                place(k + 1, [*free[:j], free[j] - sizes[k], *free[j + 1:]])
        place(k + 1, [*free, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(3, 30) for _ in range(9)]
    found = packing.bin_completion(Counter(sizes), 40)
    assert sum(n for _, n in found) == brute_bins(sizes, 40) >= packing.lower_bound(Counter(sizes), 40)
    assert Counter({s: 0 for s in sizes}) + Counter([s for f, n in found for s in f * n]) == Counter(sizes)
    assert all(sum(f) <= 40 for f, _ in found)


def test_packing_covers_every_row(spark, odd):
    from tokenizers import Tokenizer

    texts = [*odd, "a", "a", *["same text"] * 40]
    ids = [*range(len(odd)), None, 3, *range(1000, 1040)]  # a null id, a repeated id
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(documents(spark, texts, ids).repartition(5), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                        capacity=64, with_ids=True).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    want = Counter()
    for i, t in zip(ids, texts):
        own = library.encode(t or "", add_special_tokens=False).ids + [2]
        for k, (a, n) in enumerate(packing.cuts(len(own), 64)):
            want[i, k, a, np.array(own[a:a + n], "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == want
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 64) + 2


def test_empty_tables(spark):
    none = documents(spark, []).limit(0)
    assert not bpe_codec.encode_decode(none, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert not token_counts.token_counts(none, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert not packing.pack(none, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
