"""Grouped work on sorted partitions, many small groups at a time.

``groupBy().applyInPandas`` calls Python once per group; here a task streams
its sorted rows, and the function gets batches of whole groups with the places
where they begin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recordlake.llm import texts

Work = Callable[[pa.Table, np.ndarray], pa.RecordBatch | pa.Table | None]


def boundaries(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Where the groups of a table sorted by its (integer) keys begin, with its length at the end."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        values = table.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


@dataclass(frozen=True)
class _Stream:
    keys: tuple[str, ...]
    work: Work

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the last group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            at = boundaries(table, self.keys)
            last = int(at[-2])
            same = held and all(held[-1].column(k)[-1].equals(table.column(k)[0]) for k in self.keys)
            if last == 0 and (same or not held):
                held += table.to_batches()
                continue
            yield from self.run(pa.Table.from_batches(held + table.slice(0, last).to_batches()) if held else table.slice(0, last))
            held = table.slice(last).to_batches()
        if held:
            yield from self.run(pa.Table.from_batches(held))
        held.clear()
        texts.release()

    def run(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            out = self.work(table.combine_chunks(), boundaries(table, self.keys))
            if out is not None and out.num_rows:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]


def grouped(df: DataFrame, keys: list[str], work: Work, schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Applies ``work(table, starts)`` to tables of whole groups; the keys are integer columns without nulls.

    A group must fit in a task's memory: callers split large ones beforehand.
    """
    return (df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(_Stream(tuple(keys), work), schema))


def forest(linked: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric boolean matrix, as the smallest row index in it."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(1, initial=n))
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least
