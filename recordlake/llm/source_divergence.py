"""Divergence between the sources of a language, from their term counts.

Every (lang, source) group is a smoothed distribution over the terms that its
language keeps; all arithmetic is in integers. The divergence of a group p from
another distribution q is the sum of floor((p - q)^2 / (p + q)) over the terms.

* Tasks count terms in dictionaries that are bounded and handed on when full, so
  what is shuffled is (lang, source, term) with its counts, combined before.
* A language's kept terms are dealt to buckets of about ``BUCKET_TERMS`` by hash,
  and numbered in each bucket; a group's counts there are two sorted arrays (term
  number, count). So no array grows with the vocabulary, and a large language is
  many tasks.
* Pairs of groups meet per bucket: one row holds the arrays of both, for each
  unordered pair. A galloping intersection finds the terms that both have; they,
  the terms of one side and those of neither are priced apart. f is symmetric, so
  one price serves the pair both ways.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlake.llm import texts
from recordlake.llm.ship import ship
from recordlake.session import scratch_dir

SCALE_HIGH, SCALE_LOW = 31_250, 32_000  # their product is the scale of p, 10**9
LEAST_DOCUMENTS = 10
BUCKET_TERMS = 4096  # on average
BROADCAST_LANGS = 100_000  # rows of the table of languages, counted, up to which it is broadcast
TASK_TERMS = 200_000  # dictionary entries of a counting task before they are handed on
BLOCK_BYTES = 1 << 20  # of a text that are split into terms at a time
STRIDE = 256  # elements of the shorter array per galloping step

#: A term is a run of letters A-Z, a-z and of bytes above 0x7F (every non-ASCII character), with A-Z in lower case.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists, none cut."""
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK_BYTES)
        while end < len(text) and _TERM_BYTES[text[end]] != 32:
            end += 1
        yield text[at:end].translate(_TERM_BYTES).split()
        at = end


class _Counts:
    """Occurrences and documents per (lang, source) and term."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.n: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.docs: dict[tuple[str, str], Counter] = defaultdict(Counter)
        self.size = 0

    def add(self, group: tuple[str, str], text: bytes) -> None:
        n, seen = self.n[group], set()
        before = len(n)
        for terms in terms_of(text):
            n.update(terms)
            seen.update(terms)
        self.docs[group].update(seen)
        self.size += len(n) - before

    def batches(self) -> Iterator[pa.RecordBatch]:
        for group, n in self.n.items():
            docs, every = self.docs[group], list(n)
            for a in range(0, len(every), 1 << 16):
                part = every[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group[0]] * len(part), pa.string()), pa.array([group[1]] * len(part), pa.string()),
                     pa.array(part, pa.binary()).cast(pa.string()), pa.array([n[t] for t in part], pa.int64()),
                     pa.array([docs[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
        self.clear()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for batch in batches:
        data, offsets = texts.buffers(batch.column(2))
        ends = offsets.tolist()
        for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            counts.add(group, data[ends[i]:ends[i + 1]].tobytes())
            if counts.size >= TASK_TERMS:
                yield from counts.batches()
    yield from counts.batches()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n occurrences, docs rows that have it)."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
             for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "_text"))]
    parts = docs.select(*named).mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), in two steps that stay within 64 bits."""
    top, below = count + 2, total + 2 * kept
    high, rest = _div(top * SCALE_HIGH, below), (top * SCALE_HIGH) % below
    return 1 + high * SCALE_LOW + _div(rest * SCALE_LOW, below)


def _div(a: Column, b: Column) -> Column:
    """Integer division of non-negative numbers."""
    return F.call_function("div", a, b)


def price(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _probabilities(counts: np.ndarray, below: int) -> np.ndarray:
    top = (counts + 2) * SCALE_HIGH
    return 1 + top // below * SCALE_LOW + top % below * SCALE_LOW // below


def _prices(p: np.ndarray | int, q: np.ndarray | int) -> int:
    """Sum of the terms' prices; an array's sum is below 2**63, as a group's probabilities sum to about 10**9."""
    return int(np.sum((p - q) ** 2 // (p + q)))


def galloping(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common elements in two sorted arrays without repeats. For each stride of the shorter array the
    bound in the longer one is found by doubling steps from where the last stride ended, and only that reach is searched."""
    at, in_short, in_long = 0, [], []
    for begin in range(0, len(short), STRIDE):
        part = short[begin:begin + STRIDE]
        step, end = 1, at
        while end < len(long) and long[end] < part[-1]:
            end += step
            step *= 2
        reach = long[at:min(end + 1, len(long))]
        if not len(reach):
            break
        place = np.searchsorted(reach, part)
        hit = np.flatnonzero((place < len(reach)) & (reach[np.minimum(place, len(reach) - 1)] == part))
        in_short.append(begin + hit)
        in_long.append(at + place[hit])
        at += int(np.searchsorted(reach, part[-1], "right"))
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *in_short]), np.concatenate([empty, *in_long])


def pair_price(ids_a: np.ndarray, counts_a: np.ndarray, below_a: int, ids_b: np.ndarray, counts_b: np.ndarray, below_b: int,
               kept: int) -> int:
    """The divergence of two groups over a bucket of ``kept`` terms."""
    if len(ids_a) > len(ids_b):
        return pair_price(ids_b, counts_b, below_b, ids_a, counts_a, below_a, kept)
    p, q = _probabilities(counts_a, below_a), _probabilities(counts_b, below_b)
    none_p, none_q = (int(_probabilities(np.zeros(1, np.int64), below)[0]) for below in (below_a, below_b))
    a, b = galloping(ids_a, ids_b)
    only_a, only_b = np.ones(len(p), bool), np.ones(len(q), bool)
    only_a[a], only_b[b] = False, False
    absent = kept - len(p) - len(q) + len(a)
    return (_prices(p[a], q[b]) + _prices(p[only_a], none_q) + _prices(q[only_b], none_p)
            + absent * ((none_p - none_q) ** 2 // (none_p + none_q)))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


@dataclass(frozen=True)
class _PairTask:
    """Prices the pairs of a batch; columns as in ``_pairs``."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            lists = {n: _lists(col[n]) for n in ("a_ids", "a_counts", "b_ids", "b_counts")}
            below_a, below_b, kept = (col[n].to_numpy().tolist() for n in ("a_below", "b_below", "kept"))

            def part(name: str, i: int) -> np.ndarray:
                values, offsets = lists[name]
                return values[offsets[i]:offsets[i + 1]]

            found = [pair_price(part("a_ids", i), part("a_counts", i), below_a[i], part("b_ids", i), part("b_counts", i),
                                below_b[i], kept[i]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([col["lang"], col["a"], col["b"], pa.array(found, pa.int64())],
                                             ["lang", "a", "b", "value"])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_documents: int = LEAST_DOCUMENTS, top_terms: int = 10) -> DataFrame:
    """Per (lang, source): its divergence from every other source of the language (part ``pair``) and the terms
    that it has most in excess of the language (part ``term``, ranks to ``top_terms``).

    Returns lang, source, part, item, value, rank: value descending, then item
    by its UTF-8 bytes. Null text, lang and source are read as ''. Each row
    counts as a document, repeated ids included. Groups without a kept term are
    compared all the same; where a language keeps no term all values are 0. An
    empty table gives no row. Other columns, whatever their names, are not read.
    """
    spark = ship(docs.sparkSession)
    root = scratch_dir(spark, "divergence")
    counts = _written(term_counts(docs, text_col, lang_col, source_col), f"{root}/counts")
    # Kept terms, numbered in buckets; sizes of the languages.
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
    kept = _written(kept.where(F.col("docs") >= least_documents).select("lang", "term", "lang_n"), f"{root}/kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")).withColumn(
        "buckets", F.ceil(F.col("kept") / BUCKET_TERMS).cast("int"))
    langs = _written(langs, f"{root}/langs")
    if langs.count() <= BROADCAST_LANGS:
        langs = F.broadcast(langs)
    terms = kept.join(langs, "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int"))
    terms = terms.repartition("lang", "bucket")  # a join on lang alone would leave a language in one task
    number = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("term"))
    terms = _written(terms.withColumn("id", number), f"{root}/terms")
    own = _written(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), f"{root}/own")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                           for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"),
        F.coalesce("buckets", F.lit(1)).alias("buckets"))
    groups = _written(groups, f"{root}/groups")
    both = _pairs(groups, own, terms).mapInArrow(_PairTask(), "lang string, a string, b string, value long")
    both = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = both.select("lang", "value", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                         F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))
    return _ranked(both, "pair").unionByName(_ranked(_excess(own, groups), "term", top_terms))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _pairs(groups: DataFrame, own: DataFrame, terms: DataFrame) -> DataFrame:
    """Each unordered pair of a language's groups and each bucket, with both groups' arrays. The groups' arrays
    are shuffled once, by (lang, bucket); the join makes the pairs as they are read."""
    entries = own.groupBy("lang", "source", "bucket").agg(F.sort_array(F.collect_list(F.struct("id", F.col("n").alias("count")))).alias("e"))
    sizes = terms.groupBy("lang", "bucket").agg(F.count("*").alias("kept"))
    places = groups.select("lang", "source", (F.col("total") + 2 * F.col("kept")).alias("below"),
                           F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    rows = places.join(entries, ["lang", "source", "bucket"], "left").join(sizes, ["lang", "bucket"], "left").select(
        "lang", "source", "bucket", F.greatest("below", F.lit(1)).alias("below"), F.coalesce("kept", F.lit(0)).alias("kept"),
        F.coalesce(F.transform("e", lambda x: x["id"].cast("long")), F.array().cast("array<long>")).alias("ids"),
        F.coalesce(F.transform("e", lambda x: x["count"]), F.array().cast("array<long>")).alias("counts"))
    a = rows.select("lang", "bucket", "kept", *[F.col(c).alias(f"a_{c}") for c in ("below", "ids", "counts")], F.col("source").alias("a"))
    b = rows.select("lang", "bucket", *[F.col(c).alias(f"b_{c}") for c in ("below", "ids", "counts")], F.col("source").alias("b"))
    return a.join(b.hint("merge"), ["lang", "bucket"]).where(F.col("a") < F.col("b")).select(
        "lang", "a", "b", "kept", "a_below", "b_below", "a_ids", "a_counts", "b_ids", "b_counts")


def _excess(own: DataFrame, groups: DataFrame) -> DataFrame:
    """Terms that a group has and more often than its language."""
    rows = own.join(groups.select("lang", "source", "total"), ["lang", "source"])
    p = probability(F.col("n"), F.col("total"), F.col("kept"))
    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    return rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select(
        "lang", "source", "item", price(F.col("p"), F.col("q")).alias("value"))


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
