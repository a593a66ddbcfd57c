"""Exact token counts by a finite-state transducer over characters.

The transducer's state after a prefix says, for every earlier position from
which some vocabulary piece could still be running, which piece ended there and
how the count there differs from the count now. Reading a character moves all
of them one step down the vocabulary's trie, finds the one last piece of the
longer prefix (the longest whose pair with the piece before it BPE leaves as it
is), and emits by how much the number of pieces grew. States and transitions
are compiled when first met and kept, up to a bound.

No piece spans certain borders (neighbours that stand in no piece together, a
character without a piece), and there the state forgets all that came before. So
a chunk of text maps a state to (state, count) as ``head, then constant``: up to
its first border at a blank it runs from the state it is entered with, and then
it adds a count and leaves a state, whatever came in. Such maps compose
associatively, and are composed as a balanced tree over a text's chunks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from recordlake.llm import texts
from recordlake.llm.ship import ship

CHUNK = 1 << 14  # characters
MAX_STATES = 150_000
CACHE_SEGMENTS = 200_000  # in each of two generations
BLANK = "▁"
State = tuple[str, tuple[tuple[int, str | None, int], ...]]
START: State = ("", ((0, None, 0),))


class Vocabulary:
    """Pieces, merge order and trie of a sentencepiece BPE model with identity normaliser."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.trie: list[dict[str, int]] = [{}]
        self.piece_at: list[str | None] = [None]
        self.joins: set[tuple[str, str]] = set()  # neighbours inside some piece
        for piece in self.score:
            if len(piece) > 1 and self.merged([*piece]) != [piece]:
                continue  # BPE never gives it
            node = 0
            for c in piece:
                if c not in self.trie[node]:
                    self.trie[node][c] = len(self.trie)
                    self.trie.append({})
                    self.piece_at.append(None)
                node = self.trie[node][c]
            self.piece_at[node] = piece
            self.joins.update(zip(piece, piece[1:]))

    def merged(self, parts: list[str]) -> list[str]:
        """Plain BPE: the pair with the best score first, the leftmost of equals."""
        none = float("-inf")
        while len(parts) > 1:
            scores = [self.score.get(a + b, none) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == none:
                break
            k = scores.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        pair = left, right
        if pair not in self.pairs:
            self.pairs[pair] = self.merged([*self.merged([*left]), *self.merged([*right])]) == [left, right] \
                if (left[-1], right[0]) not in self.joins else self.merged([*left, *right]) == [left, right]
        return self.pairs[pair]


class Transducer:
    """Lazily determinised: state id x character -> (state id, change of the count)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        # A state: (last character, ((trie node, piece that ended there or None, count there - count now), ...)).
        self.ids: dict[State, int] = {}
        self.keys: list[State] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.number(START)
        self.vocabulary.pairs.clear()

    def number(self, key: State) -> int:
        """The state's number until the next reset."""
        if key not in self.ids:
            self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        return self.ids[key]

    def border(self, before: str, after: str) -> bool:
        """No piece holds these neighbours, so the state forgets what lies before."""
        return (before, after) not in self.vocabulary.joins

    def compile(self, state: int, c: str) -> tuple[int, int]:
        v, (last, live) = self.vocabulary, self.keys[state]
        if c not in v.trie[0]:  # as many byte pieces as UTF-8 needs
            key, delta = START, len(c.encode("utf-8", "surrogatepass"))
        else:
            if last and self.border(last, c):
                live = ((0, None, 0),)
            moved = [(v.trie[node][c], piece, count) for node, piece, count in live if c in v.trie[node]]
            node, piece, count = next(m for m in moved if v.piece_at[m[0]] is not None
                                      and (m[1] is None or v.fits(m[1], v.piece_at[m[0]])))  # longest first
            delta = count + 1
            rest = tuple((n, p, k - delta) for n, p, k in moved if v.trie[n])
            key = (c, (*rest, (0, v.piece_at[node], 0)))
        self.moves[state][c] = self.number(key), delta
        return self.moves[state][c]

    def run(self, key: State, text: str) -> tuple[State, int]:
        """State after the text, and by how much the count has grown."""
        total, a = 0, 0
        while a < len(text):
            if len(self.keys) > MAX_STATES:
                self.reset()
            state, moves = self.number(key), self.moves
            for c in text[a:a + CHUNK]:
                move = moves[state].get(c)
                state, delta = move if move is not None else self.compile(state, c)
                total += delta
            key = self.keys[state]
            a += CHUNK
        return key, total


@dataclass(frozen=True)
class ChunkMap:
    """Maps a state to (state, count): runs ``heads`` from it and then, if there was a border, adds ``count`` and
    leaves ``state``."""

    heads: tuple[str, ...]
    count: int = 0
    state: State | None = None

    def __call__(self, state: State, machine: Transducer) -> tuple[State, int]:
        total = self.count
        for head in self.heads:
            state, count = machine.run(state, head)
            total += count
        return (state if self.state is None else self.state), total

    def then(self, after: ChunkMap, machine: Transducer) -> ChunkMap:
        """Associative composition: this chunk, and then the other."""
        if self.state is None:
            return ChunkMap(self.heads + after.heads, after.count, after.state)
        state, count = after(self.state, machine)
        return ChunkMap(self.heads, self.count + count, state)


def compose(maps: list[ChunkMap], machine: Transducer) -> ChunkMap:
    """The map of all chunks: neighbours are composed, then neighbours of these, and so on."""
    while len(maps) > 1:
        pairs = [a.then(b, machine) for a, b in zip(maps[::2], maps[1::2])]
        maps = pairs + maps[2 * len(pairs):]
    return maps[0]


class Counter:
    """Token counts of texts; segments between blanks are kept with their counts."""

    def __init__(self, path: str):
        self.machine = Transducer(Vocabulary(path))
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}
        # A border is certain where a blank follows something else.
        blank = ("x", BLANK)
        assert not any(a != BLANK and b == BLANK for a, b in self.machine.vocabulary.joins), blank
        self.cut = re.compile(" *[^ ]+|  *")

    def segment(self, text: str) -> int:
        """Tokens of a text entered with the start state."""
        count = self.recent.get(text)
        if count is None:
            count = self.older.get(text)
            if count is None:
                count = self.machine.run(START, text.replace(" ", BLANK))[1]
            if len(text) <= 64:
                if len(self.recent) >= CACHE_SEGMENTS:
                    self.older, self.recent = self.recent, {}
                self.recent[text] = count
        return count

    def segments(self, parts: list[str]) -> int:
        return sum(k if k is not None else self.segment(p) for k, p in zip(map(self.recent.get, parts), parts))

    def chunk(self, text: str) -> ChunkMap:
        # The first border: a blank after something else.
        parts = self.cut.findall(text)
        head = parts[0].replace(" ", BLANK)
        if len(parts) < 2:
            return ChunkMap((head,))
        state, count = self.machine.run(START, parts[-1].replace(" ", BLANK))
        return ChunkMap((head,), self.segments(parts[1:-1]) + count, state)

    def count(self, text: str | None) -> int:
        """As sentencepiece counts: a blank goes before the text, an empty text has no token."""
        if not text:
            return 0
        text = " " + text.replace(BLANK, " ")
        if len(text) <= CHUNK:
            return self.segments(self.cut.findall(text))
        maps = [self.chunk(text[a:a + CHUNK]) for a in range(0, len(text), CHUNK)]
        return compose(maps, self.machine)(START, self.machine)[1]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


@dataclass(frozen=True)
class _Task:
    path: str
    limit: int

    def __call__(self):
        own = counter(self.path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [own.count(text) for text in batch.column(1).to_pylist()]
            size = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(counts, pa.int64()), pa.array([n > self.limit for n in counts], pa.bool_())],
                [batch.schema.names[0], "n_bytes", "n_tokens", "over_limit"])

        return work


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` is a sentencepiece BPE model with byte fallback and identity
    normaliser that every executor can open; counts are those of its library
    without begin or end tokens. Null and empty texts have 0 bytes and tokens.
    Whole texts are read, however long; repeated rows and null ids pass through
    row by row; other columns, whatever their names, are not read. No shuffle.
    """
    ship(docs.sparkSession)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return texts.map_rows(docs, [id_col, text_col], _Task(path, limit), schema)
