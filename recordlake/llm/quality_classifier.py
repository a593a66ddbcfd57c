"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown in numpy from a bounded sample of labelled rows and kept as
flat arrays (feature, bin, leaf value), which numpy traverses for all documents
and trees of a slice at once. A feature is a statistic of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm import texts
from recordlake.llm.ship import ship

#: Byte classes, each given by its ASCII characters; the rest follow by code.
GROUPS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\r\v\f", ".", ",", "!", "?",
          "#*$%&", "|<>", ";:'\"()-")
FEATURES = 14 + len(GROUPS) + 2


def _classes() -> np.ndarray:
    out = np.full(256, len(GROUPS), np.int64)  # other ASCII
    out[128:] = len(GROUPS) + 1
    for k, group in enumerate(GROUPS):
        out[np.frombuffer(group.encode(), np.uint8)] = k
    return out


CLASS = _classes()


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of distinct values, and the count of the most frequent."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    begins = np.flatnonzero(new)
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, r[begins], np.diff(np.append(begins, len(r))))
    return np.bincount(r[begins], minlength=rows), most


def features(column: pa.Array) -> np.ndarray:
    """Statistics of whole texts, one row each; null counts as empty."""
    w = texts.Words(column, lower=False)
    rows = len(column)
    size = np.diff(w.offsets)
    row = np.repeat(np.arange(rows), size)
    kinds = len(GROUPS) + 2
    share = np.bincount(row * kinds + CLASS[w.data], minlength=rows * kinds).reshape(rows, kinds)
    n = np.diff(w.first)
    word_row = np.repeat(np.arange(rows), n)
    length = w.ends - w.starts
    some, words = np.maximum(size, 1), np.maximum(n, 1)
    mean = np.bincount(word_row, length, rows) / words
    spread = np.sqrt(np.maximum(np.bincount(word_row, length.astype(float) ** 2, rows) / words - mean ** 2, 0))
    last = w.data[w.ends - 1]
    first = w.data[w.starts]
    per_word = lambda mask: np.bincount(word_row[mask], minlength=rows) / words
    same = np.zeros(len(word_row), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (word_row[1:] == word_row[:-1])
    kinds_of_words, most = _distinct(word_row, w.hash, rows)
    shingle, begin = w.shingles(3)
    n_shingles = np.diff(begin)
    kinds_of_shingles, _ = _distinct(np.repeat(np.arange(rows), n_shingles), shingle, rows)
    lines = np.bincount(row[w.data == 10], minlength=rows) + 1
    return np.column_stack([
        np.log1p(size), np.log1p(n), mean, spread, kinds_of_words / words, most / words,
        kinds_of_shingles / np.maximum(n_shingles, 1), per_word(same), per_word(length <= 3), per_word(length == 1),
        per_word(CLASS[last] >= 4), per_word(CLASS[first] == 0), np.bincount(word_row, length, rows) / some,
        lines / words, share / some[:, None]])


@dataclass(frozen=True)
class Trees:
    """``depth``-level complete trees, flattened: node k's children are 2k + 1 and 2k + 2."""

    edges: np.ndarray  # features x (bins - 1), ascending
    feature: np.ndarray  # trees x inner nodes
    split: np.ndarray  # go right if the bin is greater
    leaf: np.ndarray  # trees x leaves
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(x), self.base)
        if len(self.feature):
            at, rows, trees = self.bins(x), np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
            inner = self.feature.shape[1]
            node = np.zeros((len(x), len(self.feature)), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (at[rows, self.feature[trees, node]] > self.split[trees, node])
            total += self.leaf[trees, node - inner].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15,
        smooth: float = 1.0) -> Trees:
    """Logistic loss, second-order gains from histograms. Without rows the score is 0.5; with one label, near it."""
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(prior / (1 - prior)))
    inner, width = 2 ** depth - 1, x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((width, 0)), np.zeros((0, inner), int), np.zeros((0, inner), int), np.zeros((0, inner + 1)), base)
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T
    model = Trees(edges, np.zeros((trees, inner), int), np.full((trees, inner), bins, int), np.zeros((trees, inner + 1)), base)
    at = model.bins(x)
    flat = at + np.arange(width) * bins
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), int)
        for level in range(depth):
            begin, count = 2 ** level - 1, 2 ** level
            cell = ((node - begin)[:, None] * (width * bins) + flat).ravel()
            shape = (count, width, bins)
            sums = [np.bincount(cell, np.repeat(v, width), count * width * bins).reshape(shape).cumsum(2) for v in (g, h)]
            (gl, hl), (ga, ha) = sums, [s[:, :, -1:] for s in sums]
            gain = gl ** 2 / (hl + smooth) + (ga - gl) ** 2 / (ha - hl + smooth) - ga ** 2 / (ha + smooth)
            gain[(hl < 1) | (ha - hl < 1)] = 0
            best = gain.reshape(count, -1).argmax(1)
            useful = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            model.feature[t, begin:begin + count] = best // bins
            model.split[t, begin:begin + count] = np.where(useful, best % bins, bins)
            node = 2 * node + 1 + (at[np.arange(len(y)), model.feature[t, node]] > model.split[t, node])
        leaf = node - inner
        value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + smooth) * rate
        model.leaf[t] = value
        total = total + value[leaf]
    return model


@dataclass(frozen=True)
class _Features:
    def __call__(self):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = features(batch.column(1))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

        return work


@dataclass(frozen=True)
class _Score:
    model: Trees

    def __call__(self):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = self.model.score(features(batch.column(1)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], [batch.schema.names[0], "score"])

        return work


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = 20_000, **options) -> Trees:
    """Trees fitted to at most ``max_rows`` labelled documents, those with the smallest hashed ids.

    Labels other than 0 and 1 and null ids are left out; an id with both labels
    counts as 1. Only ids and statistics of the sample reach the driver.
    """
    spark = ship(docs.sparkSession)
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(id_col).agg(F.max(label_col).cast("int").alias("y")))
    share = min(1.0, 1.2 * max_rows / max(1, known.count()))
    order = F.xxhash64(F.lit("sample"), F.col(id_col))
    sample = known.where(F.pmod(order, F.lit(1 << 20)) < share * (1 << 20)).orderBy(order, id_col).limit(max_rows)
    sample = spark.createDataFrame(sample.collect(), sample.schema)  # at most max_rows ids
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)
    made = texts.map_rows(rows, ["y", text_col], _Features(), "y int, x array<double>").limit(2 * max_rows).collect()
    made.sort(key=lambda r: (r.y, r.x))  # the fit doesn't depend on the order of tasks
    x = np.array([r.x for r in made]).reshape(len(made), FEATURES)
    return fit(x, np.array([r.y for r in made], float), **options)


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score, the probability of label 1 (0 to 1).

    Null and empty texts are scored from their statistics like any other.
    Repeated rows and null ids pass through row by row; other columns are not
    read. No shuffle.
    """
    ship(docs.sparkSession)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double"
    return texts.map_rows(docs, [id_col, text_col], _Score(model), schema)


@dataclass(frozen=True)
class _Keep:
    model: Trees
    threshold: float

    def __call__(self):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            good = self.model.score(features(batch.column(batch.num_columns - 1))) >= self.threshold
            return batch.select(list(range(batch.num_columns - 1))).filter(pa.array(good))

        return work


def accepted(docs: DataFrame, model: Trees, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches ``threshold``, with all their columns; row by row, no shuffle."""
    ship(docs.sparkSession)
    columns = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    kinds = [f.dataType.simpleString() for f in docs.schema.fields]
    rows = docs.select(*columns, F.col(text_col).cast("string").alias("text"))
    out = texts.map_rows(rows, rows.columns, _Keep(model, threshold), ", ".join(f"c{k} {t}" for k, t in enumerate(kinds)))
    return out.toDF(*docs.columns)
