"""Byte-level BPE from a rank file: recursive DuckDB queries in every task, and decoding by ordered aggregation.

A task keeps one DuckDB connection with two tables made from the rank file:
``merges`` (left, right, merged: a token's id is its rank) and ``vocabulary``
(id, bytes). The words of a slice that are not known yet become rows (word,
position, token), and a recursive query joins neighbours with ``merges`` and
contracts each word's leftmost pair of least rank, until no word has one left.
Decoding joins (text, position, token) rows with ``vocabulary`` and aggregates
them in order.

Long words. A round contracts one pair per word, so the rows of a word of n
bytes sum up to n * n / 2. Words over ``WORD_BYTES`` are therefore encoded as
overlapping blocks, which are words of the same query, and two blocks are
joined at a place that both have as a token border and whose two tokens stay as
they are when they are merged alone; a sequence is the one that BPE gives
exactly if that holds for all its neighbours. Words without such a place (they
repeat a short pattern) go whole through a query that contracts, in each round,
all of a word's pairs of least rank that do not overlap. That is the same as
one after the other because a merged token ranks after its parts, which is
checked when the table is made.
"""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from recordlake.llm import texts
from recordlake.llm.ship import ship

CACHE_WORDS = 250_000  # in each of two generations
WORD_BYTES = 128  # a longer word is encoded in blocks of this size
BLOCK_STEP = 64
QUERY_ROWS = 4_000_000  # of all rounds of a recursive query together
GROUP_WORDS = 200_000  # of a long text that are handled at a time
DUCKDB_MEMORY = "500MB"
#: Below it the classes of letters, numbers and blanks are the same in all Unicode versions in use.
WIDE = re.compile("[^\x00-ɏ]")
SCHEMA = "{id} {id_type}, n_tokens long, ids binary, decoded binary"
DIGESTS = "{id} {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Each round contracts the leftmost of every word's pairs of least rank; positions stay gapless.
LEFTMOST = """
WITH RECURSIVE run AS (
  SELECT 0 AS round, word, pos, token FROM symbols
  UNION ALL
  (WITH pair AS (
     SELECT l.word, min(m.merged::BIGINT * 4294967296 + l.pos) AS best
     FROM run l JOIN run r ON r.word = l.word AND r.pos = l.pos + 1 JOIN merges m ON m.a = l.token AND m.b = r.token
     GROUP BY l.word
   ), found AS (SELECT word, (best >> 32)::INTEGER AS merged, (best & 4294967295)::INTEGER AS place FROM pair)
   SELECT round + 1, word, CASE WHEN pos > place THEN pos - 1 ELSE pos END, CASE WHEN pos = place THEN merged ELSE token END
   FROM run JOIN found USING (word) WHERE pos <> place + 1)
)
SELECT word, token FROM run SEMI JOIN (SELECT word, max(round) AS round FROM run GROUP BY word) USING (word, round)
ORDER BY word, pos
"""

#: Each round contracts all of a word's pairs of least rank; in a row of overlapping ones, the odd ones.
EVERY = """
WITH RECURSIVE run AS (
  SELECT 0 AS round, word, pos, token FROM symbols
  UNION ALL
  (WITH pair AS (
     SELECT round, word, pos, token, merged
     FROM (SELECT *, lead(token) OVER (PARTITION BY word ORDER BY pos) AS after FROM run) r
     LEFT JOIN merges m ON m.a = r.token AND m.b = r.after
   ), least AS (
     SELECT word, min(merged) AS least FROM pair GROUP BY word HAVING min(merged) IS NOT NULL
   ), hit AS (
     SELECT pair.*, coalesce(merged = least, false) AS hit FROM pair JOIN least USING (word)
   ), streak AS (
     SELECT *, count(*) FILTER (NOT hit) OVER (PARTITION BY word ORDER BY pos) AS streak FROM hit
   ), taken AS (
     SELECT *, hit AND row_number() OVER (PARTITION BY word, streak, hit ORDER BY pos) % 2 = 1 AS take FROM streak
   ), gone AS (
     SELECT *, coalesce(lag(take) OVER (PARTITION BY word ORDER BY pos), false) AS gone FROM taken
   )
   SELECT round + 1, word, pos, CASE WHEN take THEN merged ELSE token END FROM gone
   WHERE NOT gone AND round < {rounds})
)
SELECT word, pos, token, last FROM (SELECT *, max(round) OVER (PARTITION BY word) AS last FROM run) WHERE round = last
ORDER BY word, pos
"""

DECODE = """
SELECT text, string_agg(chars, '' ORDER BY pos) AS chars FROM tokens JOIN vocabulary USING (token) GROUP BY text
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a tiktoken file: a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class MergeTable:
    """Pairs of ids and the id they merge to, so that every merged token ranks after its parts.

    A split of a token whose part ranks after the token itself is left out if
    the pair never comes about: merging its bytes alone never passes through
    it. ``ordered`` tells whether that holds for all such splits.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.ordered = ranks, True
        self.tokens = {i: t for t, i in ranks.items()}
        a, b, merged = [], [], []
        for token, i in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is None or right is None:
                    continue
                late = i <= max(left, right)
                if late and not self.passes(left, right):
                    continue
                self.ordered &= not late
                a.append(left)
                b.append(right)
                merged.append(i)
        self.columns = [pa.array(x, pa.int32()) for x in (a, b, merged)]
        self.fitting: dict[tuple[int, int], bool] = {}

    def _steps(self, data: bytes) -> Iterator[list[bytes]]:
        parts = [data[i:i + 1] for i in range(len(data))]
        while True:
            yield parts
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                return
            i = min(found)[1]
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2:]]

    def passes(self, left: int, right: int) -> bool:
        pair = [self.tokens[left], self.tokens[right]]
        return any(parts == pair for parts in self._steps(pair[0] + pair[1]))

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both alone ends in the pair."""
        if len(self.fitting) > 1_000_000:
            self.fitting.clear()
        found = self.fitting.get((left, right))
        if found is None:
            pair = [self.tokens[left], self.tokens[right]]
            *_, last = self._steps(pair[0] + pair[1])
            found = self.fitting[left, right] = last == pair
        return found


def splitter(pattern: str) -> tuple[regex.Pattern, regex.Pattern]:
    """The pattern for texts below ``WIDE``, and one for all, whose letters and numbers are those of the tiktoken
    library: the regular expressions here know a later Unicode version, and what they add is taken out."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    wide = pattern
    for name in (r"\p{L}", r"\p{N}"):
        own = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        known = set()
        for a in range(0, len(every), 1 << 16):
            known.update(own.decode(own.encode_ordinary(every[a:a + (1 << 16)])))
        here = set(regex.findall(name, every))
        if known - here:
            raise ValueError(f"{name} lacks characters that the library has")
        added = np.array(sorted(map(ord, here - known)))
        if not len(added):
            continue
        starts = np.flatnonzero(np.diff(added, prepend=-2) != 1)
        ranges = "".join(rf"\U{added[a]:08x}-\U{added[b - 1]:08x}" for a, b in zip(starts, [*starts[1:], len(added)]))
        # Inside a negated class, too: [^\s\p{L}\p{N}] becomes [^\s[\p{L}--[...]][\p{N}--[...]]].
        wide = wide.replace(name, rf"[{name}--[{ranges}]]")
    return regex.compile(pattern), regex.compile("(?V1)" + wide)


class Codec:
    """Encoder and decoder of one rank file; one per worker process."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern, self.narrow, self.wide = pattern, regex.compile(pattern), None
        self.merges = MergeTable(self.ranks)
        self.base = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.codes: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY,
                                                     "temp_directory": tempfile.gettempdir()})
        self._table("merges", pa.table(self.merges.columns, ["a", "b", "merged"]))
        ids = sorted(self.merges.tokens)
        self._table("vocabulary", pa.table({"token": pa.array(ids, pa.int32()),
                                            "chars": [self.merges.tokens[i].decode("latin-1") for i in ids]}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    # ------------------------------------------------------------- encoding

    def words(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, in groups for a long text."""
        if self.wide is None and WIDE.search(text):
            self.wide = splitter(self.pattern)[1]
        pattern = self.wide if self.wide is not None and WIDE.search(text) else self.narrow
        if len(text) <= GROUP_WORDS:
            yield pattern.findall(text)
            return
        found = (m[0] for m in pattern.finditer(text))
        while group := list(islice(found, GROUP_WORDS)):
            yield group

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Makes the words' ids known; the table holds them until the next call."""
        if len(self.codes) > CACHE_WORDS:
            self.older, self.codes = self.codes, {}
        new = []
        for word in words.difference(self.codes):
            known = self.older.get(word)
            if known is None:
                new.append(word)
            else:
                self.codes[word] = known
        if new:
            data = [w.encode() for w in new]
            self.codes.update(zip(new, self.encode_words(data)))
        return self.codes

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, little-endian 32-bit. A word that is a token is that token; the others are merged."""
        out = [b""] * len(words)
        pieces: list[bytes] = []
        places: list[tuple[int, int]] = []  # of a word's pieces
        rest = []
        for k, word in enumerate(words):
            token = self.ranks.get(word)
            if token is not None:
                out[k] = token.to_bytes(4, "little")
                continue
            begin = len(pieces)
            if len(word) <= WORD_BYTES:
                pieces.append(word)
            else:
                last = len(word) - WORD_BYTES
                pieces += [word[a:a + WORD_BYTES] for a in (*range(0, last, BLOCK_STEP), last)]
            rest.append(k)
            places.append((begin, len(pieces)))
        found = self._merged(pieces)
        for k, (a, b) in zip(rest, places):
            if b == a + 1:
                out[k] = found[a]
                continue
            ids = self._joined(len(words[k]), [np.frombuffer(x, "<u4") for x in found[a:b]])
            out[k] = (self._whole(words[k]) if ids is None else ids).astype("<u4").tobytes()
        return out

    def _symbols(self, pieces: list[bytes]) -> pa.Table:
        size = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.repeat(np.cumsum(size) - size, size)
        return pa.table({"word": np.repeat(np.arange(len(pieces), dtype=np.int32), size),
                         "pos": (np.arange(len(data)) - begin).astype(np.int32), "token": self.base[data]})

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of short pieces, by queries of at most ``QUERY_ROWS`` rows each."""
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
        out = [b""] * len(pieces)
        for a, b in texts.slices(np.array([len(pieces[k]) * (len(pieces[k]) + 1) // 2 for k in order]), QUERY_ROWS):
            part = order[a:b]
            rows = self._query(LEFTMOST, "symbols", self._symbols([pieces[k] for k in part]))
            tokens = rows.column("token").to_numpy().astype("<u4").tobytes()
            ends = 4 * np.searchsorted(rows.column("word").to_numpy(), np.arange(len(part) + 1))
            for k, x, y in zip(part, ends[:-1].tolist(), ends[1:].tolist()):
                out[k] = tokens[x:y]
        return out

    def _joined(self, n: int, blocks: list[np.ndarray]) -> np.ndarray | None:
        """The ids of a word from those of its overlapping blocks; None where two have no place to be joined."""
        size = {}

        def borders(ids: np.ndarray, at: int) -> np.ndarray:
            lengths = [size.setdefault(i, len(self.merges.tokens[i])) for i in ids.tolist()]
            return at + np.cumsum([0, *lengths])

        begins = [min(k * BLOCK_STEP, n - WORD_BYTES) for k in range(len(blocks))]
        ids, ends = blocks[0], borders(blocks[0], 0)
        out, done = [], 0  # ids before ``done`` are in out
        for block, begin in zip(blocks[1:], begins[1:]):
            own = borders(block, begin)
            common = np.intersect1d(ends[1:-1], own[1:-1])
            common = common[common > done]
            # From the middle of the overlap outwards: there neither side knows a rim.
            middle = begin + (WORD_BYTES - BLOCK_STEP) // 2
            for place in sorted(common.tolist(), key=lambda p: abs(p - middle)):
                left, right = int(np.searchsorted(ends, place)), int(np.searchsorted(own, place))
                if self.merges.fits(int(ids[left - 1]), int(block[right])):
                    break
            else:
                return None
            out.append(ids[:left])
            ids, ends, done = block[right:], own[right:], place
        return np.concatenate([*out, ids])

    def _whole(self, word: bytes) -> np.ndarray:
        """Ids of a word that blocks don't give; few rounds at a time, so that memory follows the word."""
        if not self.merges.ordered:
            raise ValueError("the rank file has a merged token that ranks before its parts")
        rows = self._symbols([word])
        rounds = max(1, QUERY_ROWS // len(word))
        while True:
            rows = self._query(EVERY.format(rounds=rounds), "symbols", rows)
            if rows.column("last")[0].as_py() < rounds:
                return rows.column("token").to_numpy()
            rows = rows.drop_columns(["last"])

    # ------------------------------------------------------------- decoding

    def decode(self, parts: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids (little-endian 32-bit)."""
        ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
        size = [len(p) // 4 for p in parts]
        out = [b""] * len(parts)
        if len(ids):
            rows = self._query(DECODE, "tokens", pa.table({
                "text": np.repeat(np.arange(len(parts), dtype=np.int32), size),
                "pos": np.arange(len(ids), dtype=np.int32), "token": ids}))
            for k, chars in zip(rows.column("text").to_pylist(), rows.column("chars").to_pylist()):
                out[k] = chars.encode("latin-1")
        return out

    def encode_rows(self, column: list[str | None]) -> Iterator[tuple[int, bytes]]:
        """(row, ids) of the texts; a long text comes in several parts, in order."""
        short = [(i, next(self.words(t))) for i, t in enumerate(column) if t and len(t) <= GROUP_WORDS]
        codes = self.learn(set().union(*(words for _, words in short)))
        for i, words in short:
            yield i, b"".join(map(codes.__getitem__, words))
        for i, t in enumerate(column):
            if t and len(t) > GROUP_WORDS:
                for words in self.words(t):
                    codes = self.learn(set(words))
                    yield i, b"".join(map(codes.__getitem__, words))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


@dataclass(frozen=True)
class _Task:
    path: str
    pattern: str
    digests: bool

    def __call__(self):
        own = codec(self.path, self.pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            counts = [0] * n
            ids = [hashlib.sha256() for _ in range(n)] if self.digests else [bytearray() for _ in range(n)]
            decoded = [hashlib.sha256() for _ in range(n)] if self.digests else [bytearray() for _ in range(n)]
            put = (lambda h, b: h.update(b)) if self.digests else (lambda held, b: held.extend(b))
            held: list[tuple[int, bytes]] = []

            def flush() -> None:
                for (i, _), text in zip(held, own.decode([code for _, code in held])):
                    put(decoded[i], text)
                held.clear()

            size = 0
            for i, code in own.encode_rows(batch.column(1).to_pylist()):
                counts[i] += len(code) // 4
                put(ids[i], code)
                held.append((i, code))
                size += len(code)
                if size >= 4 * GROUP_WORDS:
                    flush()
                    size = 0
            flush()
            if self.digests:
                tail = [pa.array([h.hexdigest() for h in part], pa.string()) for part in (ids, decoded)]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                tail = [pa.array([bytes(b) for b in part], pa.binary()) for part in (ids, decoded)]
                names = ["n_tokens", "ids", "decoded"]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *tail],
                                              [batch.schema.names[0], *names])

        return work


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  digests: bool = False) -> DataFrame:
    """Per row: id, number of tokens, ids (little-endian unsigned 32-bit) and the decoded bytes, or (``digests``)
    their SHA-256.

    ``path`` is a tiktoken rank file that every executor can open, ``pattern``
    the expression whose matches are encoded one by one. Special tokens are
    ordinary text. Null text counts as empty: 0 tokens, empty bytes. Whole
    texts, however long. Repeated rows and null ids pass through row by row;
    other columns, whatever their names, are not read. No shuffle.
    """
    ship(docs.sparkSession)
    schema = (DIGESTS if digests else SCHEMA).format(id=id_col, id_type=docs.schema[id_col].dataType.simpleString())
    return texts.map_rows(docs, [id_col, text_col], _Task(path, pattern, digests), schema, limit=2 << 20)
