"""Near-duplicate passages across documents by compact windows.

The tokens of a document are its shingles (runs of a few words). Under a hash
function the Cartesian tree over the tokens' hashes groups the subsequences of
a text: the node at position c with subtree l..r holds all those whose min-hash
is c's (its compact window). Only windows at least as wide as the shortest
passage matter, about two in that many words. Passages that are alike share the
min-hash for most hash functions, so windows with equal min-hashes are brought
together; overlapping windows of two documents from ``enough`` hash functions
are a candidate region, and regions are verified token by token.

Many documents may share a passage. They meet its first document only, never
each other: windows are compared with the smallest document that has the
min-hash amid the same tokens on one side (left or right; a passage that is
repeated exactly has one side in common). Of a min-hash that many of a map
task's windows have, a few are shuffled; the others get the first by a join.

The first document may hold too little of the passage, a quoted part of it. So
windows that no verified passage covers go on to a second meeting, if a
document lies between them and the first one. There the runs of tokens around
the min-hash are the keys, ``exact`` ones as long as the shortest passage at every offset,
so that whoever shares one shares a whole passage, and shorter ones (``SHORT`` tokens)
at a few offsets for passages with changes; again each window meets a run's first
document only. However many documents share a line, that is a bounded number of rows each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.llm import texts
from recordlake.llm.groups import grouped
from recordlake.llm.ship import ship
from recordlake.session import scratch_dir

HASHES = 3
CONTEXT = 8  # tokens on one side of the min-hash that must be equal, too
DIRECT = 8  # windows of a min-hash that a task shuffles; more are joined with the first
HELD = 200_000  # windows that a task sorts at a time
GAPS = (15, 5, 0)  # unmatched tokens in a row that a passage may span, tried in this order
BROADCAST_ROWS = 400_000  # requests of 40 bytes
BROADCAST_PLACES = 2_000_000  # min-hashes asked for, of 8 bytes
SHORT = 20  # tokens of a short run in the second meeting
OFFSETS = (0, 6, 13, 19)  # of the min-hash in a short run


def compact_windows(h: np.ndarray, least: int, ties: bool) -> tuple[list[int], list[int], list[int]]:
    """Begin, end (exclusive) and min-hash position of the windows of at least ``least`` tokens.

    With ties, all occurrences of the minimum make one window, and the tree goes
    on between them.
    """
    begin, end, at = [], [], []
    stack = [(0, len(h))]
    while stack:
        a, z = stack.pop()
        if z - a < least:
            continue
        part = h[a:z]
        c = a + int(part.argmin())
        begin.append(a), end.append(z), at.append(c)
        if ties:
            cuts = (np.flatnonzero(part == h[c]) + a).tolist()
            stack += [(p + 1, q) for p, q in zip([a - 1, *cuts], [*cuts, z])]
        else:
            stack.append((a, c))
            stack.append((c + 1, z))
    return begin, end, at


WINDOWS = "key long, id long, a int, z int, f int, at int"
PAIRS = "id long, a int, z int, f int, ref long, ref_a int, ref_z int"
MET = f"{PAIRS}, key long, at int, later boolean"
RUNS = "run long, id long, a int, kind int"  # kind: 1 if it looks for a partner, 2 if the run is a short one


def _rows(schema: str, *columns) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    kind = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind[k]) for c, k in zip(columns, kinds)], list(names))


def _leaders(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: whether a row is the first of its key, and each row's first row."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return new, np.flatnonzero(new)[np.cumsum(new) - 1]


@dataclass(frozen=True)
class _Windows:
    """Windows of a task's documents; ``more`` marks those of a min-hash that come after its smallest few documents."""

    words: int
    least: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0
        for batch in batches:
            _, offsets = texts.buffers(batch.column(1))
            for a, z in texts.slices(np.diff(offsets)):
                part = self.windows(batch.slice(a, z - a))
                held.append(part)
                count += len(part[0])
                if count >= HELD:
                    yield from self.reduced(held)
                    held, count = [], 0
        if count:
            yield from self.reduced(held)
        held.clear()
        texts.release()

    def windows(self, batch: pa.RecordBatch) -> tuple:
        hashes, begin = texts.Words(batch.column(1)).shingles(self.words)
        ids = batch.column(0).to_numpy()
        salted = [texts.mix(hashes + np.uint64(f * 0x9E3779B97F4A7C15 % (1 << 64))) for f in range(1, HASHES + 1)]
        key, ident, first, last, number, place = [], [], [], [], [], []
        for i in np.flatnonzero(np.diff(begin) >= self.least):
            p, q = int(begin[i]), int(begin[i + 1])
            ties = len(np.unique(hashes[p:q])) < q - p
            # Hash of the tokens up to here, less those up to CONTEXT before (and after).
            sums = np.concatenate([[np.uint64(0)], np.cumsum(texts.mix(hashes[p:q] * np.uint64(2) + np.uint64(1)))])
            for f, h in enumerate(salted):
                own = h[p:q]
                a, z, at = compact_windows(own, self.least, ties)
                c = np.array(at)
                left = sums[c] - sums[np.maximum(c - CONTEXT, 0)]
                right = sums[np.minimum(c + CONTEXT + 1, q - p)] - sums[c + 1]
                key += [texts.mix(own[c] + left), texts.mix(own[c] ^ ~right)]
                first += a + a
                last += z + z
                number += [f] * (2 * len(a))
                place += at + at
                ident += [ids[i]] * (2 * len(a))
        if not key:
            return tuple(np.empty(0, np.int64) for _ in range(6))
        return (np.concatenate(key).view(np.int64), np.array(ident), np.array(first), np.array(last), np.array(number),
                np.array(place))

    def reduced(self, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, ident, a, z, f, at = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((z, a, ident, key))
        key, ident, a, z, f, at = (c[order] for c in (key, ident, a, z, f, at))
        _, lead = _leaders(key)
        yield _rows(f"{WINDOWS}, more boolean", key, ident, a, z, f, at, np.arange(len(key)) - lead >= DIRECT)


@dataclass(frozen=True)
class _Meet:
    """Streams windows sorted by min-hash and document: pairs each with its min-hash's first; only that one and the
    first of the second document are held, however many documents share it. ``later`` marks windows with a
    document between them and the first one."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "id", "a", "z", "f", "at")
        held: list[list] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in names]
            if held:
                columns = [np.concatenate([[row[i] for row in held], c]) for i, c in enumerate(columns)]
            key, ident, a, z, f, at = columns
            known = len(held)
            new, first = _leaders(key)
            other = ident != ident[first]
            # Where the second document of each key begins; keys without one point past the end.
            begins = np.flatnonzero(new)
            places = np.flatnonzero(other)
            second = np.append(places, len(key))[np.searchsorted(places, begins)]
            group = np.cumsum(new) - 1
            second = np.where(second < np.append(begins[1:], len(key)), second, len(key))
            later = other & (ident != np.append(ident, -1)[np.minimum(second[group], len(ident))])
            more = np.flatnonzero(other)
            more = more[more >= known]
            if len(more):
                to = first[more]
                yield _rows(MET, ident[more], a[more], z[more], f[more], ident[to], a[to], z[to], key[more], at[more], later[more])
            rows = [first[-1]] + ([second[-1]] if second[-1] < len(key) else [])
            held = [[c[r] for c in columns] for r in rows]


@dataclass(frozen=True)
class _Runs:
    """The runs of tokens around the min-hashes that a document is asked for; ``mine`` marks those of windows that
    look for a partner, the others are partners only."""

    words: int
    least: int

    def __call__(self):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, begin = texts.Words(batch.column(2)).shingles(self.words)
            ids, asked = batch.column(0).to_numpy(), batch.column(1)
            bounds, every = asked.offsets.to_numpy(), asked.flatten().to_numpy()
            at, f, mine = every >> 3, (every >> 1) & 3, every & 1
            base = bounds[0]
            out: list[tuple] = []
            for i, (p, q) in enumerate(zip(begin, begin[1:])):
                n = int(q - p)
                own = slice(bounds[i] - base, bounds[i + 1] - base)
                where, exact, wants = at[own], f[own] == 0, mine[own].astype(bool)
                inside = where < n
                where, exact, wants = where[inside], exact[inside], wants[inside]
                total, down = texts.prefix_hashes(hashes[p:q])
                short = np.ones(len(where), bool)
                for size, offsets, use, mark in ((self.least, range(self.least), exact, 0), (min(SHORT, self.least), OFFSETS, short, 2)):
                    starts, ask = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
                    for k in offsets:
                        s = where[use] - k
                        fits = (s >= 0) & (s + size <= n)
                        starts[s[fits]] = True
                        ask[s[fits & wants[use]]] = True
                    s = np.flatnonzero(starts)
                    if len(s):
                        run = texts.mix((total[s + size] - total[s]) * down[s] + np.uint64(size))
                        out.append((run.view(np.int64), np.full(len(s), ids[i]), s, ask[s] + mark))
            if not out:
                return _rows(RUNS, [], [], [], [])
            run, ident, a, kind = (np.concatenate(c) for c in zip(*out))
            order = np.lexsort((a, ident, run))
            # Of those that are partners only, the first of a run is enough.
            keep = order[_leaders(run[order])[0] | (kind[order] & 1 == 1)]
            return _rows(RUNS, run[keep], ident[keep], a[keep], kind[keep])

        return work


@dataclass(frozen=True)
class _MeetRuns:
    """Streams runs sorted by run and document: pairs those that look for a partner with the run's first document."""

    least: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("run", "id", "a", "kind")]
            if lead is not None:
                columns = [np.concatenate([[x], c]) for x, c in zip(lead, columns)]
            run, ident, a, kind = columns
            _, first = _leaders(run)
            mine = np.flatnonzero((kind & 1 == 1) & (ident != ident[first]))
            if len(mine):
                to = first[mine]
                size = np.where(kind[mine] & 2, min(SHORT, self.least), self.least)
                yield _rows(PAIRS, ident[mine], a[mine], a[mine] + size, np.zeros(len(mine)), ident[to], a[to], a[to] + size)
            lead = [c[first[-1]] for c in columns]


@dataclass(frozen=True)
class _Regions:
    """Interval join of the windows of two documents: overlapping ones from enough hash functions."""

    enough: int

    def __call__(self, table: pa.Table, starts: np.ndarray) -> pa.Table | None:
        ident, ref, a, z, f, ra, rz = (table.column(c).to_numpy() for c in ("id", "ref", "a", "z", "f", "ref_a", "ref_z"))
        # Sorted by a within a pair: a region goes on while windows overlap.
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        reach = np.maximum.accumulate(z + group * (1 << 40)) - group * (1 << 40)
        new = np.ones(len(a), bool)
        new[1:] = (group[1:] != group[:-1]) | (a[1:] >= reach[:-1])
        at = np.flatnonzero(new)
        if not len(at):
            return None
        kinds = np.bitwise_or.reduceat(1 << f.astype(np.int64), at)
        ok = np.array([k.bit_count() >= self.enough for k in kinds.tolist()])
        return pa.table({"id": ident[at], "ref": ref[at], "a": a[at], "z": np.maximum.reduceat(z, at),
                         "ref_a": np.minimum.reduceat(ra, at), "ref_z": np.maximum.reduceat(rz, at)}).filter(pa.array(ok))


@dataclass(frozen=True)
class _Slices:
    """The tokens (32 bits each) of a document that a region asks for."""

    words: int

    def __call__(self):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(4)
            hashes, begin = texts.Words(column).shingles(self.words)
            low = hashes.astype(np.uint32)
            a, z = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            found = [low[p + i:min(p + j, q)].tobytes() for p, q, i, j in zip(begin, begin[1:], a, z)]
            crc = [zlib.crc32(t.as_buffer()) if t.is_valid else 0 for t in column]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64()), pa.array(found, pa.binary())],
                                              ["region", "asked", "a", "crc", "tokens"])

        return work


def passages(d: np.ndarray, r: np.ndarray, words: int, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Passages of ``d`` that are alike to some of ``r``: (begin, end, begin in r, end in r, similarity), in tokens.

    The longest spans of tokens that ``r`` has, over gaps as long as the token
    sets of the passage and of its place in ``r`` keep the similarity; and runs
    over gaps of fixed lengths, at last such that go on in ``r`` token by token.
    """
    names, where = np.unique(r, return_index=True)
    at = np.minimum(np.searchsorted(names, d), max(0, len(names) - 1))
    hit = np.flatnonzero(names[at] == d) if len(names) else np.empty(0, int)
    out: list[tuple[int, int, int, int, float]] = []

    def check(own: np.ndarray, level: int) -> None:
        if own[-1] - own[0] + 1 < least:
            return
        place = where[at[own]]
        shift = place - own
        # Its place in r: all of it, or without tokens far off the others (they occur elsewhere, too).
        near = place[np.abs(shift - np.sort(shift)[len(shift) // 2]) <= (own[-1] - own[0]) // 4 + 16]
        x = np.unique(d[own[0]:own[-1] + 1])
        best = (0.0, 0, 0)
        for p in (place, near):
            y = np.unique(r[p.min():p.max() + 1])
            common = len(np.intersect1d(x, y, assume_unique=True))
            best = max(best, (common / (len(x) + len(y) - common), int(p.min()), int(p.max()) + 1))
        alike, ra, rz = best
        if alike >= similarity:
            out.append((int(own[0]), int(own[-1]) + 1, ra, rz, float(alike)))
        elif level < len(GAPS):
            split(own, level + 1)

    def split(own: np.ndarray, level: int) -> None:
        if level < len(GAPS):
            cut = np.flatnonzero(np.diff(own) > GAPS[level] + 1) + 1
        else:
            place = where[at[own]]
            follows = (np.diff(own) == 1) & ((np.diff(place) == 1) | _goes_on(d, r, own, where, at))
            cut = np.flatnonzero(~follows) + 1
        for part in np.split(own, cut):
            if len(part):
                check(part, level)

    if len(hit):
        for own in _spans(hit, where[at[hit]], least, similarity):
            check(own, len(GAPS))
        split(hit, 0)
    # Without those inside another one.
    out.sort(key=lambda o: (o[0], -o[1]))
    ends = np.maximum.accumulate([0, *(o[1] for o in out)])
    return [o for o, end in zip(out, ends) if o[1] > end]


def _spans(hit: np.ndarray, place: np.ndarray, least: int, similarity: float) -> list[np.ndarray]:
    """Longest spans of matched tokens that keep the similarity, as many as cover all such spans.

    Of m matched tokens in a span of n tokens, with a place of k tokens, the similarity is
    m / (n + k - m) where no token repeats; so a span keeps it if a running sum does not fall
    over it, and the furthest end for each begin comes from the sum's maxima from the right.
    """
    shift = place - hit
    # Tokens far off their neighbours occur elsewhere, too.
    around = np.lib.stride_tricks.sliding_window_view(np.pad(shift, 4, mode="edge"), 9)
    near = np.abs(shift - np.median(around, axis=1)) <= 16
    own, place = hit[near], place[near]
    if not len(own):
        return []
    way = np.concatenate([[0], np.cumsum(np.abs(np.diff(place)))])
    total = (1 + similarity) * np.arange(len(own)) - similarity * (own + way)
    ahead = np.maximum.accumulate(total[::-1])[::-1]
    end = len(own) - 1 - np.searchsorted(ahead[::-1], total + similarity - 1 - 1e-9)
    begin = np.arange(len(own))
    long = own[end] - own + 1 >= least
    begin, end = begin[long], end[long]
    out, reach, k = [], -1, 0
    while k < len(begin):
        # Of the spans that begin within reach (or the next one), the one that goes furthest.
        last = max(k + 1, int(np.searchsorted(begin, reach + 1, "right")))
        best = k + int(end[k:last].argmax())
        if end[best] > reach:
            out.append(own[begin[best]:end[best] + 1])
            reach = int(end[best])
        k = last
    return out


def _goes_on(d: np.ndarray, r: np.ndarray, own: np.ndarray, where: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the two neighbouring tokens of ``d`` are neighbours somewhere in ``r``."""
    both = (r[:-1].astype(np.uint64) << np.uint64(32)) | r[1:]
    pair = (d[own[:-1]].astype(np.uint64) << np.uint64(32)) | d[own[1:]]
    return np.isin(pair, both)


SPANS = ("id long, crc long, start_word int, end_word int, ref long, ref_start_word int, ref_end_word int, similarity double")


@dataclass(frozen=True)
class _Verify:
    words: int
    least: int
    similarity: float

    def __call__(self, table: pa.Table, starts: np.ndarray) -> pa.Table | None:
        asked, first = table.column("asked").to_pylist(), table.column("a").to_numpy()
        ident, crc, tokens = table.column("id").to_numpy(), table.column("crc").to_numpy(), table.column("tokens").chunk(0)
        rows = []
        for p, q in zip(starts, starts[1:]):
            mine = [i for i in range(p, q) if not asked[i]]
            theirs = [i for i in range(p, q) if asked[i]]
            for i in mine:
                for j in theirs:
                    d, r = (np.frombuffer(tokens[k].as_buffer(), np.uint32) for k in (i, j))
                    for a, z, ra, rz, alike in passages(d, r, self.words, self.least, self.similarity):
                        more = self.words - 1
                        rows.append((ident[i], crc[i], first[i] + a, first[i] + z + more, ident[j], first[j] + ra,
                                     first[j] + rz + more, alike))
        if not rows:
            return None
        names = [c.split()[0] for c in SPANS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def repeated_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, words: int = 5, enough: int = 1,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per passage: id, crc, start_word, end_word (exclusive), ref, ref_start_word, ref_end_word, similarity.

    A passage of at least ``min_words`` words of document ``id`` that is alike
    to one of document ``ref``, which has a smaller id: the Jaccard similarity
    of their sets of ``words``-word shingles (A-Z lower-cased) is at least
    ``similarity``. So a passage's first document keeps it unreported. Ids are
    integers; rows with a null id, null text or fewer words take no part. Rows
    that repeat an id are texts of one document, told apart by the text's crc32
    (``crc``), and no passages between them are sought. Other columns are not
    read; no documents give no rows.

    ``enough`` of the three hash functions must agree; with one, no exact copy
    is missed for that, and of passages of similarity 0.8 about one in a hundred.
    A passage repeated exactly is found whatever parts of it smaller documents
    quote: its run of tokens meets the first document that has the whole run.
    Passages with changes whose first document holds only a part are found if
    one of the short runs around their min-hashes has another first document.
    """
    spark = ship(docs.sparkSession)
    root = scratch_dir(spark, "passages")
    least = max(1, min_words - words + 1)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    source.mapInArrow(_Windows(words, least), f"{WINDOWS}, more boolean").write.parquet(f"{root}/windows")
    windows = spark.read.parquet(f"{root}/windows")
    few, more = windows.where("not more").drop("more"), windows.where("more").drop("more")
    met = few.repartition("key").sortWithinPartitions("key", "id", "a", "z").mapInArrow(_Meet(), MET)
    # Every task shuffles its first of a min-hash, so the first of all is among the few.
    more.select("key").distinct().write.parquet(f"{root}/hot")
    hot = spark.read.parquet(f"{root}/hot")
    count = hot.count()
    if count:
        small = F.broadcast if count <= BROADCAST_ROWS else lambda df: df
        few.join(small(hot), "key").groupBy("key").agg(F.min(F.struct(
            F.col("id").alias("ref"), F.col("a").alias("ref_a"), F.col("z").alias("ref_z"))).alias("first")).select(
            "key", "first.*").write.parquet(f"{root}/firsts")
        firsts = spark.read.parquet(f"{root}/firsts")
        met = met.union(more.join(small(firsts), "key").where("id <> ref").withColumn("later", F.lit(True)).select(*met.columns))
    met.write.parquet(f"{root}/met")
    met = spark.read.parquet(f"{root}/met")
    check = _Check(spark, root, source, words, least, similarity)
    first, regions = check(met.drop("key", "at", "later"), enough, "first")
    again = _second_meeting(spark, root, source, windows.drop("more"), met, first, regions, words, least)
    second, _ = check(again, 1, "second")
    return first.union(second).distinct()


@dataclass(frozen=True)
class _Check:
    """Candidate pairs to regions, regions to verified passages; both written down."""

    spark: SparkSession
    root: str
    source: DataFrame
    words: int
    least: int
    similarity: float

    def __call__(self, pairs: DataFrame, enough: int, name: str) -> tuple[DataFrame, DataFrame]:
        regions = grouped(pairs, ["id", "ref"], _Regions(enough), "id long, ref long, a int, z int, ref_a int, ref_z int", ("a",))
        path = f"{self.root}/{name}"
        regions.withColumn("region", F.xxhash64("id", "ref", "a")).write.parquet(f"{path}-regions")
        regions = self.spark.read.parquet(f"{path}-regions")
        mine = regions.select("id", "region", F.lit(False).alias("asked"), "a", "z")
        theirs = regions.select(F.col("ref").alias("id"), "region", F.lit(True).alias("asked"), F.col("ref_a").alias("a"), F.col("ref_z").alias("z"))
        requests = mine.union(theirs)
        if regions.count() * 2 <= BROADCAST_ROWS:
            requests = F.broadcast(requests)
        asked = self.source.join(requests, "id").select("region", "asked", "a", "z", "text", "id")
        found = grouped(_sliced(asked, self.words), ["region"], _Verify(self.words, self.least, self.similarity), SPANS)
        found.write.parquet(f"{path}-passages")
        return self.spark.read.parquet(f"{path}-passages"), regions


def _second_meeting(spark: SparkSession, root: str, source: DataFrame, windows: DataFrame, met: DataFrame, found: DataFrame,
                    regions: DataFrame, words: int, least: int) -> DataFrame:
    """Pairs of the windows that no passage found covers, with first documents of the runs around their min-hashes."""
    spans = found.select("id", "start_word", "end_word").distinct()
    covered = (F.col("at") >= F.col("start_word")) & (F.col("at") + words <= F.col("end_word"))
    left = met.where("later").select("key", "id", "f", "at")
    left = left.join(spans, (left["id"] == spans["id"]) & covered, "left_anti")
    left.write.parquet(f"{root}/left")
    left = spark.read.parquet(f"{root}/left")
    keys = left.select("key").distinct()
    keys.write.parquet(f"{root}/left-keys")
    keys = spark.read.parquet(f"{root}/left-keys")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    # Any window of these min-hashes may be a partner, covered or not.
    asked = windows.select("key", "id", "f", "at").join(keys, "key", "left_semi").select("id", "f", "at", F.lit(False).alias("mine"))
    asked = asked.union(left.select("id", "f", "at", F.lit(True).alias("mine"))).groupBy("id", "f", "at").agg(F.max("mine").alias("mine"))
    packed = F.shiftleft(F.col("at").cast("long"), 3) + F.shiftleft("f", 1) + F.col("mine").cast("int")
    asked.groupBy("id").agg(F.collect_list(packed).alias("asked")).write.parquet(f"{root}/asked")
    asked = spark.read.parquet(f"{root}/asked")
    if (asked.agg(F.sum(F.size("asked"))).first()[0] or 0) <= BROADCAST_PLACES:
        asked = F.broadcast(asked)
    runs = texts.map_rows(source.join(asked, "id"), ["id", "asked", "text"], _Runs(words, least), RUNS)
    pairs = runs.repartition("run").sortWithinPartitions("run", "id", "a").mapInArrow(_MeetRuns(least), PAIRS)
    seen = regions.select(F.col("id").alias("_id"), F.col("ref").alias("_ref"), F.col("a").alias("_a"), F.col("z").alias("_z"))
    return pairs.join(seen, (F.col("id") == F.col("_id")) & (F.col("ref") == F.col("_ref")) & (F.col("a") >= F.col("_a"))
                      & (F.col("z") <= F.col("_z")), "left_anti")


def _sliced(asked: DataFrame, words: int) -> DataFrame:
    return texts.map_rows(asked.withColumn("asked", F.struct("asked", "id")), ["region", "asked", "a", "z", "text"], _Slices(words),
                          "region long, asked struct<asked: boolean, id: long>, a int, crc long, tokens binary").select(
        "region", "asked.asked", "asked.id", "a", "crc", "tokens")


@dataclass(frozen=True)
class _Remove:
    columns: int

    def __call__(self, batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(self.columns).to_pylist(), batch.column(self.columns + 1).to_pylist()):
                if spans:
                    w = texts.Words(pa.array([text], pa.string()))
                    data, kept, at = bytes(w.data), [], 0
                    for a, z in sorted((s["a"], s["z"]) for s in spans):
                        begin = int(w.starts[a])
                        if begin > at:
                            kept.append(data[at:begin])
                        at = max(at, int(w.starts[z]) if z < len(w.starts) else len(data))
                    text = b"".join([*kept, data[at:]]).decode()
                out.append(text)
            names = batch.schema.names[:self.columns]
            yield pa.RecordBatch.from_arrays([*batch.columns[:self.columns], pa.array(out, pa.string())], [*names, "_text"])


def remove_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the passages found, with their columns; a passage's words go with the
    white space after them. Rows from which nothing goes are unchanged, null texts and ids too."""
    spark = ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    spans = found.groupBy(F.col("id").cast(kind).alias("_id"), F.col("crc").alias("_crc")).agg(
        F.collect_set(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("z"))).alias("_spans"))
    path = f"{scratch_dir(spark, 'passages')}/spans"
    spans.write.parquet(path)
    spans = spark.read.parquet(path)
    if (spans.agg(F.sum(F.size("_spans"))).first()[0] or 0) <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    names = docs.columns
    crc = F.crc32(docs[text_col].cast("binary"))
    joined = docs.join(spans, (docs[id_col] == spans["_id"]) & (crc == spans["_crc"]), "left")
    rest = [c for c in names if c != text_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest) + ", _text string"
    out = joined.select(*[docs[c] for c in rest], docs[text_col], spans["_spans"]).mapInArrow(_Remove(len(rest)), schema)
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in names])
