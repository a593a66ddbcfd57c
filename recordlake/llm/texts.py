"""Vectorised text helpers used inside tasks: words, shingles and their hashes.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Everything works
on slices of an Arrow column, so memory follows the slice and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 18  # the arrays of a slice take about 40 bytes a byte
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string column; null is empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` in total; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths):
        yield start, len(lengths)


def prefix_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, factors): ``(sums[j] - sums[i]) * factors[i]`` identifies the run i..j of the hashes, order included."""
    up, down = _power_tables(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes) * up[:len(hashes)], out=sums[1:])
    return sums, down[:len(hashes) + 1]


class Words:
    """The words of some rows: hashes, byte spans and the first word of each row."""

    def __init__(self, column: pa.Array, lower: bool = True):
        data, offsets = buffers(column)
        n = len(data)
        space = SPACE[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        edges = offsets[1:-1]
        before[edges[edges < n]] = True
        after[edges[(edges > 0)] - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        up, down = _power_tables(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[LOWER[data] if lower else data] * up[:n], out=total[1:])
        self.hash = mix((total[self.ends] - total[self.starts]) * down[self.starts])
        self.data, self.offsets = data, offsets
        self.first = np.searchsorted(self.starts, offsets)  # first[i]:first[i + 1] are row i's words

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every run of ``size`` words, and where each row's begin.

        A row with fewer words (but one at least) has its whole sequence as
        its only shingle.
        """
        n = len(self.hash)
        counts = np.diff(self.first)
        made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
        begin = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(made, out=begin[1:])
        total = np.zeros(n, np.uint64)
        factor = 1
        row_end = np.repeat(self.first[1:], counts)
        at = np.arange(n)
        for j in range(size):
            ok = at + j < row_end
            total[ok] += self.hash[at[ok] + j] * np.uint64(factor)
            factor = factor * _Q % (1 << 64)
        keep = at - np.repeat(self.first[:-1], counts) < np.repeat(made, counts)
        length = np.repeat(np.minimum(counts, size), counts)[keep].astype(np.uint64)
        return mix(total[keep] + length * np.uint64(0xA24BAED4963EE407)), begin


def release() -> None:
    """Gives freed memory back to the system: Spark keeps Python workers, and with them what their allocators hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
             schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices whose last column (a text) holds at most ``limit`` bytes.

    ``make`` runs once per task and returns the function for the slices.
    """
    def run(batches):
        work = make()
        try:
            for batch in batches:
                _, offsets = buffers(batch.column(batch.num_columns - 1))
                for a, b in slices(np.diff(offsets), limit):
                    out = work(batch.slice(a, b - a))
                    if out is not None and out.num_rows:
                        yield out
        finally:
            release()

    return df.select(*columns).mapInArrow(run, schema)
