"""Exact BPE encoding by backtracking over longest token matches, and decoding.

A token sequence is the one that BPE gives exactly if every pair of neighbours
stays as it is when BPE is run on that pair alone. So a word is encoded from
left to right: an Aho-Corasick automaton lists all tokens in it, the longest
that starts here and is compatible with its neighbour is taken, and a position
from which no way leads on is marked and never tried again. Each position is
thus visited a bounded number of times.

Decoding looks up each id's bytes in one table of bytes and offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from recordlake.llm import texts
from recordlake.llm.ship import ship

CACHE_WORDS = 250_000  # in each of two generations
CACHE_PAIRS = 1_000_000
CACHE_LETTERS = 256  # a longer word is not kept
DECODE_IDS = 1 << 16
SCHEMA = "{id} {id_type}, n_tokens long, ids binary, decoded binary"
DIGESTS = "{id} {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Code points from here on are normalised and split by the tokenizers library;
#: below it, NFC changes nothing and the classes of the pattern are the same.
WIDE = re.compile("[^\x00-ɏ]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = dict.fromkeys(plain)
    for b in plain:
        names[b] = chr(b)
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return [names[b] for b in range(256)]


class PairTable(dict):
    """(left id, right id) -> whether BPE leaves this pair as it is; filled on demand.

    A token's merges form a tree in which ranks rise towards the root. Between
    two tokens only the symbols at their common border can merge: the left
    token's right edge (its root, the root's right part, ...) with the right
    token's left edge. A symbol lives from its own merge to its parent's, so
    the pair breaks if two edge symbols have a merge whose rank comes before
    both parents' (equal ranks: the leftmost pair goes first).
    """

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        self.rank: dict[tuple[int, int], int] = {}
        right_edge: dict[int, list[tuple[int, float]]] = {}
        left_edge: dict[int, list[tuple[int, float]]] = {}
        for i in vocab.values():
            right_edge[i], left_edge[i] = [(i, float("inf"))], [(i, float("inf"))]
        self.made: set[int] = set()
        broken: set[int] = set()
        for k, (a, b) in enumerate(merges):
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = k
            self.made.add(token)
            right_edge[token] = [(token, float("inf")), (right, k), *right_edge[right][1:]]
            left_edge[token] = [(token, float("inf")), (left, k), *left_edge[left][1:]]
        self.right_edge, self.left_edge = right_edge, left_edge
        for a, b in merges:
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            if left in broken or right in broken or self.first_merge(left, right) != (left, right):
                broken.add(token)
        self.broken = broken  # tokens that BPE never gives

    def first_merge(self, left: int, right: int) -> tuple[int, int] | None:
        """The border symbols that merge first when BPE runs on this pair of tokens."""
        best, found = float("inf"), None
        for u, u_ends in self.right_edge[left]:
            for v, v_ends in self.left_edge[right]:
                r = self.rank.get((u, v))
                if r is not None and r < u_ends and r <= v_ends and r < best:
                    best, found = r, (u, v)
        return found

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= CACHE_PAIRS:
            self.clear()
        fits = self[pair] = self.first_merge(*pair) is None
        return fits


class WordCodes(dict):
    """Word -> its ids as little-endian 32-bit bytes, for the words met of late.

    When it is full, its words become the older generation, from which those
    still in use come back; so memory is bounded and frequent words stay. Words
    over ``CACHE_LETTERS`` are encoded anew each time.
    """

    def __init__(self, codec: Codec):
        self.codec, self.older = codec, {}

    def __missing__(self, word: str) -> bytes:
        value = self.older.get(word)
        if value is None:
            value = np.array(self.codec.encode_word(self.codec.to_symbols(word)), "<u4").tobytes()
        if len(word) > CACHE_LETTERS:
            return value
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


class Codec:
    """Encoder and decoder for a byte-level BPE with word ends, from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        strings = [""] * size
        for token, i in [*self.vocab.items(), *self.special.items()]:
            strings[i] = token
        self.pairs = PairTable(self.vocab, model["merges"])
        # A word ends in MARK; a token with the suffix matches the mark, too.
        self.mark = "\x00"
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            if token in self.special or i in self.pairs.broken:
                continue
            ends_word = self.end and token.endswith(self.end)
            body = token.removesuffix(self.end) if ends_word else token
            if i not in self.pairs.made and len(body) != 1:
                continue  # neither a merge nor a single byte
            key = body + self.mark if ends_word else body
            self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()
        #: Token -> the longest other token that it starts with, as (length, id).
        self.shorter: dict[int, tuple[int, int] | None] = {}
        for key, (length, i) in self.automaton.items():
            self.shorter[i] = next((self.automaton.get(key[:m]) for m in range(length - 1, 0, -1)
                                    if key[:m] in self.automaton), None)
        self.byte_names = {b: c for b, c in enumerate(byte_characters())}
        self.codes = WordCodes(self)
        joined = [(s + " ").encode() for s in strings]
        self.lengths = np.array([len(b) for b in joined], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(joined), np.uint8)
        # Fixed pattern of the vocabulary's file, with white space spelt out.
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r\x20\x85\xa0\p{L}\p{N}]+")

    def to_symbols(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.byte_names)

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word written in byte characters."""
        text = word + self.mark
        n = len(text)
        # Leftmost-longest matches throughout are right if all neighbours fit.
        matches = [match for _, match in self.automaton.iter_long(text)]
        ids = [i for _, i in matches]
        if sum(length for length, _ in matches) == n and all(map(self.pairs.__getitem__, zip(ids, ids[1:]))):
            return ids
        out: list[int] = []
        stack: list[tuple[int, int]] = []  # where each token of out starts, and the token
        dead: set[int] = set()
        pos, pairs, shorter = 0, self.pairs, self.shorter
        # One pass lists every token in the word; of those that start at one place, the longest ends last.
        longest: list[tuple[int, int] | None] = [None] * n
        for last, match in self.automaton.iter(text):
            longest[last - match[0] + 1] = match
        match = longest[0]
        while pos < n:
            while match is not None:
                length, token = match
                if pos + length not in dead and (not out or pairs[out[-1], token]):
                    break
                match = shorter[token]
            if match is None:
                if not stack:
                    raise ValueError(f"no encoding for {word!r}")
                dead.add(pos)
                pos, token = stack.pop()
                out.pop()
                match = shorter[token]
                continue
            stack.append((pos, token))
            out.append(token)
            pos += length
            if pos < n:
                match = longest[pos]
        return out

    def _plain(self, text: str) -> bytes:
        if WIDE.search(text):
            split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return b"".join(np.array(self.encode_word(piece), "<u4").tobytes() for piece, _ in split)
        return b"".join(map(self.codes.__getitem__, self.pattern.findall(text.lower())))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.split_special.search(text):
            return self._plain(text)
        out, pos = [], 0
        for found in self.split_special.finditer(text):
            out += [self._plain(text[pos:found.start()]), np.array([self.special[found[0]]], "<u4").tobytes()]
            pos = found.end()
        return b"".join([*out, self._plain(text[pos:])])

    def decode(self, ids: bytes):
        """Yields the decoded text's bytes: the tokens' strings, one blank between two."""
        every = np.frombuffer(ids, "<u4")
        for a in range(0, len(every), DECODE_IDS):
            part = every[a:a + DECODE_IDS]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            source = np.repeat(self.offsets[part] - ends + lengths, lengths) + np.arange(ends[-1])
            chunk = self.bytes[source].tobytes()
            yield chunk if a + DECODE_IDS < len(every) else chunk[:-1]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


@dataclass(frozen=True)
class _Task:
    path: str
    digests: bool

    def __call__(self):
        own = codec(self.path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            encoded = [own.encode(text) for text in batch.column(1).to_pylist()]
            counts = pa.array([len(x) // 4 for x in encoded], pa.int64())
            if self.digests:
                shas = []
                for x in encoded:
                    digest = hashlib.sha256()
                    for chunk in own.decode(x):
                        digest.update(chunk)
                    shas.append(digest.hexdigest())
                tail = [pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()), pa.array(shas, pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                tail = [pa.array(encoded, pa.binary()), pa.array([b"".join(own.decode(x)) for x in encoded], pa.binary())]
                names = ["n_tokens", "ids", "decoded"]
            return pa.RecordBatch.from_arrays([batch.column(0), counts, *tail], [batch.schema.names[0], *names])

        return work


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  digests: bool = False) -> DataFrame:
    """Per row: id, number of tokens, ids and decoded text, or (``digests``) their SHA-256.

    ``path`` is a tokenizers file (byte-level BPE with a word-end suffix) that
    every executor can open. Null text counts as empty: 0 tokens, empty bytes.
    Whole texts are encoded, however long. Repeated rows and null ids pass
    through row by row; other columns, whatever their names, are not read.
    No shuffle.
    """
    ship(docs.sparkSession)
    schema = (DIGESTS if digests else SCHEMA).format(id=id_col, id_type=docs.schema[id_col].dataType.simpleString())
    return texts.map_rows(docs, [id_col, text_col], _Task(path, digests), schema)
