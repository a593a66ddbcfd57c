"""Packing of documents into sequences of equal capacity by bin completion.

Only the number of pieces of each length decides how to pack, and there are no
more lengths than tokens in a sequence. So the search works on that histogram,
on the driver, whatever the number of documents: a filling found for the
largest piece is applied as often as its pieces last. Spark tokenises, counts,
and deals the pieces out to the fillings' places.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlake.llm import texts
from recordlake.llm.ship import ship
from recordlake.session import scratch_dir

Filling = tuple[int, ...]  # lengths in one sequence, descending


# ------------------------------------------------------------------ the search


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and (Martello and Toth) for each
    threshold the pieces too large to share plus what doesn't fit beside them."""
    total = sum(s * c for s, c in counts.items())
    best = -(-total // capacity)
    for k in sorted({s for s in counts if 2 * s <= capacity} | {0}):
        alone = sum(c for s, c in counts.items() if s > capacity - k)
        halves = [(s, c) for s, c in counts.items() if capacity - k >= s and 2 * s > capacity]
        small = sum(s * c for s, c in counts.items() if k <= s and 2 * s <= capacity and s)
        beside = sum((capacity - s) * c for s, c in halves)
        best = max(best, alone + sum(c for _, c in halves) + max(0, -(-(small - beside) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over the histogram: equal bins are moved together."""
    free: dict[int, list[list]] = defaultdict(list)  # room left -> [filling, number of bins]
    for size in sorted((s for s in counts if counts[s]), reverse=True):
        left = counts[size]
        while left:
            room = next((r for r in range(size, capacity + 1) if free.get(r)), None)
            if room is None:
                each = capacity // size
                for filled, bins in ((each, left // each), (left % each, 1)):
                    if filled and bins:
                        free[capacity - filled * size].append([(size,) * filled, bins])
                left = 0
            else:
                filling, bins = free[room].pop()
                take = min(bins, left)
                if bins > take:
                    free[room].append([filling, bins - take])
                free[room - size].append([(*filling, size), take])
                left -= take
    return [(filling, bins) for groups in free.values() for filling, bins in groups]


def dominated(a: Filling, b: Filling) -> bool:
    """Whether ``a``'s pieces can be dealt to ``b``'s so that none is exceeded (then b is never worse)."""
    room = sorted(b, reverse=True)
    for piece in sorted(a, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= piece]
        if not fits:
            return False
        room[min(fits, key=lambda k: room[k])] -= piece
    return a != b


class Effort:
    """Steps that the search may still take."""

    def __init__(self, steps: int):
        self.left = steps


def completions(counts: dict[int, int], sizes: list[int], room: int, effort: Effort, most: int = 6, steps: int = 2000) -> list[Filling]:
    """Undominated fillings of ``room`` from the remaining pieces, the fullest first; those that
    leave room for another piece are dominated and not listed. The search ends with ``most`` exact
    fillings or after ``steps``."""
    found: list[Filling] = []
    exact = 0
    stop = effort.left - steps
    smallest = sizes[-1] if sizes else room + 1

    def extend(at: int, left: int, chosen: Filling) -> None:
        nonlocal exact
        effort.left -= 1
        if left < smallest:
            found.append(chosen)
            exact += not left
            return
        # Sizes descend: skip those that are too large.
        low, high = at, len(sizes)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if sizes[middle] > left else (low, middle)
        fitted = False
        for k in range(low, len(sizes)):
            size = sizes[k]
            if counts[size] > chosen.count(size):
                fitted = True
                extend(k, left - size, (*chosen, size))
                if effort.left <= stop or exact >= most:
                    return
        if not fitted:
            found.append(chosen)

    extend(0, room, ())
    ranked = sorted(set(found), key=lambda f: (-sum(f), tuple(-s for s in f)))[:3 * most]
    kept: list[Filling] = []
    for f in ranked:
        if len(kept) < most and not any(dominated(f, g) for g in kept):
            kept.append(f)
    return kept


def bin_completion(counts: dict[int, int], capacity: int, steps: int = 1_500_000) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used; every piece is used exactly once.

    Best fit is the incumbent. Depth-first, the largest remaining piece is
    completed by undominated fillings, the fullest first, as often as its
    pieces last; at most six are tried, of those that ``completions`` finds in
    its steps. A branch is left as soon as its sequences and the bound on the
    rest's waste cannot beat the incumbent. The search ends at the lower bound
    (then the result is optimal), when these fillings are searched, or after
    ``steps``; the best packing so far is the result.
    """
    counts = {s: c for s, c in counts.items() if c}
    incumbent = best_fit(counts, capacity)
    best = sum(n for _, n in incumbent)
    bound = lower_bound(counts, capacity)
    left = dict(counts)
    order = sorted(left, reverse=True)
    total = sum(s * c for s, c in left.items())
    effort = Effort(steps)
    used: list[tuple[Filling, int]] = []
    choices: list[list[Filling]] = []
    bins = 0
    while best > bound and effort.left > 0:
        sizes = [s for s in order if left[s]]
        effort.left -= len(order) // 8
        if not sizes or bins + -(-total // capacity) >= best:
            if not sizes and bins < best:
                incumbent, best = list(used), bins
            # Back to the last piece with another filling.
            while used:
                filling, n = used.pop()
                for s in filling:
                    left[s] += n
                bins -= n
                total += n * sum(filling)
                if choices[-1]:
                    break
                choices.pop()
            else:
                break
        else:
            largest = sizes[0]
            left[largest] -= 1
            fits = [s for s in sizes if s <= capacity - largest and left[s]]
            options = completions(left, fits, capacity - largest, effort)
            left[largest] += 1
            choices.append([(largest, *f) for f in reversed(options)])
        filling = choices[-1].pop()
        need = {s: filling.count(s) for s in filling}
        n = min(left[s] // k for s, k in need.items())
        for s, k in need.items():
            left[s] -= n * k
        used.append((filling, n))
        bins += n
        total -= n * sum(filling)
    return incumbent


@dataclass(frozen=True)
class Places:
    """Where the k-th piece of each length goes: sorted by (length, first k)."""

    key: np.ndarray
    per_bin: np.ndarray  # pieces of that length in the filling
    first_bin: np.ndarray
    offset: np.ndarray  # of the first of them

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + rank, "right") - 1
        k = (length << 48) + rank - self.key[at]
        return self.first_bin[at] + k // self.per_bin[at], self.offset[at] + k % self.per_bin[at] * length


def places(fillings: list[tuple[Filling, int]]) -> Places:
    taken: dict[int, int] = defaultdict(int)
    rows, bins = [], 0
    for filling, n in fillings:
        offset = 0
        for size in dict.fromkeys(filling):
            k = filling.count(size)
            rows.append(((size << 48) + taken[size], k, bins, offset))
            taken[size] += n * k
            offset += k * size
        bins += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Places(*table.T)


# ------------------------------------------------------------------ Spark side


class Ids:
    """Ids of a text as the tokenizers library gives them for a byte-level BPE file.

    ``path`` names the same vocabulary twice: as a .json for tokenizers, and as
    .tiktoken ranks beside it, which tiktoken encodes to the same ids faster.
    A special token's string in a text becomes its id, the library's default.
    """

    def __init__(self, path: str, pattern: str):
        import json
        import re

        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        with open(path, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.encoding = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not any(s in text for s in self.special):
            return self.encoding.encode_ordinary(text)
        return [i for part in self.split.split(text) if part
                for i in ([self.special[part]] if part in self.special else self.encoding.encode_ordinary(part))]


_ids: dict[str, Ids] = {}


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; of a longer one only the first piece may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


@dataclass(frozen=True)
class _Pieces:
    path: str
    pattern: str
    end: int
    capacity: int
    with_ids: bool

    def __call__(self):
        from pyspark import TaskContext

        if self.path not in _ids:
            _ids[self.path] = Ids(self.path, self.pattern)
        encode = _ids[self.path]
        chunk, seen = TaskContext.get().partitionId(), np.zeros(self.capacity + 1, np.int64)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = np.array([*encode(text), self.end], "<u4")
                for j, (a, n) in enumerate(cuts(len(own), self.capacity)):
                    data = own[a:a + n].tobytes()
                    row.append(k), piece.append(j), start.append(a), length.append(n), crc.append(zlib.crc32(data))
                    rank.append(seen[n])
                    seen[n] += 1
                    ids.append(data if self.with_ids else None)
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([chunk] * len(row), pa.int32()),
                 pa.array(rank, pa.int64()), pa.array(ids, pa.binary())],
                [batch.schema.names[0], "piece", "start", "length", "ids_crc32", "chunk", "rank", "ids"])

        return work


@dataclass(frozen=True)
class _Place:
    places: Places
    columns: tuple[str, ...]

    def __call__(self, batches):
        for batch in batches:
            cols = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            length = cols["length"].to_numpy(zero_copy_only=False)
            rank = cols["rank"].to_numpy(zero_copy_only=False)
            bins, offset = self.places.find(length, rank) if len(length) else (length, rank)
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in self.columns), pa.array(bins), pa.array(offset)],
                                             [*self.columns, "sequence_id", "offset"])


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end: int = 2, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    A document is its tokens and the id ``end``; null text counts as empty, so
    it has the end id alone. Every row is packed for itself, repeated rows and
    null ids too; an empty table gives no rows. Other columns are not read. The pieces are written once to
    the shared folder. Ranks among pieces of equal length are counted within
    each task and offset by the sums of the tasks before it, so a length that
    a third of all pieces share is no hot group.
    """
    spark = ship(docs.sparkSession)
    root = scratch_dir(spark, "packing")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (f"{id_col} {id_type}, piece int, start long, length long, ids_crc32 long, chunk int, rank long, ids binary")
    texts.map_rows(docs, [id_col, text_col], _Pieces(path, pattern, end, capacity, with_ids), schema).write.parquet(f"{root}/pieces")
    pieces = spark.read.parquet(f"{root}/pieces")
    pieces.groupBy("length", "chunk").agg(F.count("*").alias("n")).write.parquet(f"{root}/counts")
    counts = spark.read.parquet(f"{root}/counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    found = places(bin_completion(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts.select("length", "chunk", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(f"{root}/before")
    kept = (id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []))
    ranked = pieces.join(spark.read.parquet(f"{root}/before"), ["length", "chunk"]).select(
        *kept, (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_Place(found, kept), f"{id_col} {id_type}, piece int, start long, length long, ids_crc32 long, "
                             + ("ids binary, " if with_ids else "") + "sequence_id long, offset long")
