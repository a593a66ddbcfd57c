"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds some labelled text. A text is parsed
against it greedily: from here, the longest run of letters that occurs anywhere
in the language's text is one phrase, and the next phrase begins after it. The
language that needs the fewest phrases, normalised by log2 of the size of its
sample over the number of letters (cross-entropy per letter), wins.

Texts are cut into lanes of equal length that are parsed side by side in numpy,
one character of every lane per step; a lane's end closes a phrase, for every
language alike.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlake.llm import texts
from recordlake.llm.ship import ship

LANE = 512  # characters
BLANK = 32
UNKNOWN = "und"


def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank for all that is no letter (first plane)."""
    out = np.full(0x10000, BLANK, np.uint32)
    for c in range(0x10000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_folding: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points, with one blank for each run of anything else."""
    if not _folding:
        _folding.append(_fold())
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = code >= 0x10000
    if wide.any():
        low = {c: (ord(chr(c).lower()) if unicodedata.category(chr(c))[0] == "L" else BLANK) for c in set(code[wide].tolist())}
        out = _folding[0][np.where(wide, BLANK, code)]
        out[wide] = [low[c] for c in code[wide].tolist()]
    else:
        out = _folding[0][code]
    keep = out != BLANK
    keep[1:] |= (out[1:] == BLANK) & (out[:-1] != BLANK)
    return out[keep]


@dataclass(frozen=True)
class Automaton:
    """Suffix automaton: next state by (state, letter's class), -1 where there is none; state 0 is the root."""

    moves: np.ndarray
    weight: float  # log2 of the size of the sample


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    alphabet: np.ndarray  # known code points, ascending
    automata: tuple[Automaton, ...]


def suffix_automaton(text: list[int], classes: int) -> np.ndarray:
    """Transition table of the automaton that accepts every substring of ``text``."""
    moves: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = new
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                size.append(size[at] + 1)
                link.append(link[to])
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    out = np.full((len(moves), classes), -1, np.int32)
    for state, row in enumerate(moves):
        for c, to in row.items():
            out[state, c] = to
    return out


def fit(samples: dict[str, list[str]], max_letters: int) -> Model:
    """A model of at most ``max_letters`` letters and blanks per language."""
    parts = {}
    for name in sorted(samples):
        text = np.concatenate([letters(t + "\n") for t in samples[name]] or [np.empty(0, np.uint32)])[:max_letters]
        if (text != BLANK).any():
            parts[name] = text
    alphabet = np.unique(np.concatenate([*parts.values(), np.array([BLANK], np.uint32)]))
    return Model(tuple(parts), alphabet, tuple(
        Automaton(suffix_automaton(np.searchsorted(alphabet, t).tolist(), len(alphabet) + 1), float(np.log2(max(2, len(t)))))
        for t in parts.values()))


def phrases(automaton: Automaton, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of phrases of each lane (class codes, steps x lanes; lanes sorted by length, longest first)."""
    moves, classes = automaton.moves.ravel(), automaton.moves.shape[1]
    state = np.zeros(lanes.shape[1], np.int32)  # the root: no phrase is under way
    count = np.zeros(lanes.shape[1], np.int64)
    active = lanes.shape[1]
    for step in range(len(lanes)):
        while active and lengths[active - 1] <= step:
            active -= 1
        c = lanes[step, :active]
        to = moves[state[:active] * classes + c]
        count[:active] += (state[:active] == 0) | (to < 0)
        stuck = np.flatnonzero(to < 0)
        # The next phrase begins here; a character that the language lacks is one by itself.
        to[stuck] = np.maximum(moves[c[stuck]], 0)
        state[:active] = to
    return count


def phrases_plain(automaton: Automaton, codes: list[int]) -> int:
    """The same for one lane, character by character (the definition)."""
    count, at = 0, 0
    while at < len(codes):
        state, begin = 0, at
        while at < len(codes) and automaton.moves[state, codes[at]] >= 0:
            state = automaton.moves[state, codes[at]]
            at += 1
        at += at == begin  # a character that the language lacks
        count += 1
    return count


def classify(model: Model, column: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score (how far the best language is ahead of the next) of each text."""
    codes = [letters(t) if t else np.empty(0, np.uint32) for t in column]
    has = np.array([bool((c != BLANK).any()) for c in codes])
    pieces, owner = [], []
    for i, code in enumerate(codes):
        if has[i]:
            at = np.searchsorted(model.alphabet, code)
            known = model.alphabet[np.minimum(at, len(model.alphabet) - 1)] == code
            code = np.where(known, at, len(model.alphabet)).astype(np.int32)
            for a in range(0, len(code), LANE):
                pieces.append(code[a:a + LANE])
                owner.append(i)
    best = [UNKNOWN] * len(codes)
    score = np.zeros(len(codes))
    if not pieces or not model.names:
        return best, score
    lengths = np.array([len(p) for p in pieces])
    order = np.argsort(-lengths, kind="stable")
    lanes = np.zeros((lengths.max(), len(pieces)), np.int32)
    for k, i in enumerate(order):
        lanes[:lengths[i], k] = pieces[i]
    owner = np.array(owner)[order]
    cost = np.stack([np.bincount(owner, phrases(a, lanes, lengths[order]), len(codes)) * a.weight for a in model.automata], 1)
    first = cost.argmin(1)
    rows = np.arange(len(codes))
    least = cost[rows, first]
    rest = cost.copy()
    rest[rows, first] = np.inf
    for i in np.flatnonzero(has):
        best[i] = model.names[first[i]]
        score[i] = 1.0 if len(model.names) == 1 else 1 - least[i] / max(rest[i].min(), 1e-9)
    return best, np.clip(score, 0, 1)


@dataclass(frozen=True)
class _Task:
    model: Model

    def __call__(self):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            best, score = classify(self.model, batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                                              [batch.schema.names[0], "lang_pred", "score"])

        return work


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          docs_per_language: int = 48, max_letters: int = 24_000, max_languages: int = 200) -> Model:
    """A model from labelled texts: of each language, up to ``docs_per_language`` texts (those with the
    smallest hashed ids), and of these up to ``max_letters`` letters. More languages than ``max_languages``
    are an error. Rows with a null id, language or text teach nothing."""
    spark = ship(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    order = F.xxhash64(F.lit("sample"), F.col(id_col))
    rank = F.row_number().over(Window.partitionBy(lang_col).orderBy(order, id_col))  # limited before the shuffle
    chosen = (known.select(id_col, lang_col).withColumn("rank", rank).where(F.col("rank") <= docs_per_language)
              .select(id_col, lang_col).limit(docs_per_language * max_languages + 1).collect())
    if len(chosen) > docs_per_language * max_languages:
        raise ValueError(f"more than {max_languages} languages")
    keys = spark.createDataFrame(chosen, known.select(id_col, lang_col).schema).distinct()
    part = F.substring(F.col(text_col), 1, 2 * max_letters).alias("text")
    rows = (known.select(id_col, lang_col, part).join(F.broadcast(keys), [id_col, lang_col])
            .select(lang_col, order.alias("o"), "text").limit(2 * len(chosen) + 1).collect())
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.o, r.text)):
        samples.setdefault(r[lang_col], []).append(r.text)
    return fit(samples, max_letters)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (0: the two best languages tie, to 1).

    ``und`` and 0 if the text is null, has no letter, or the model has no
    language. Of languages that tie, the first by name. Whole texts are parsed.
    Repeated rows and null ids pass through; other columns are not read. No shuffle.
    """
    ship(docs.sparkSession)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double"
    return texts.map_rows(docs, [id_col, text_col], _Task(model), schema, limit=2 << 20)
