"""Segments and manifests: which compacted files stand for which small ones.

Compaction copies what is committed into a *segment*, a folder with one table per
store table, and then publishes a manifest, one small JSON file per generation::

    _segments/<name>/<table>/     rewritten tables, few files, sorted by key
    _manifest/<generation>.json   {"segments": [...], "covered": {log: [files]}}

A reader takes the manifest of the highest generation. Batches whose ledger
row is in a segment are read from there and nowhere else; files of the logs that
a manifest covers are read from the segment only. So until the manifest is there,
a rewrite changes no read, and once it is there, the small files are unread
whether they are deleted already or not.

A stream writes an epoch into a log as one file or, where it is large, as a set of
files that each name their place and the size of the set. Until the last one is there,
none of them is read.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from recordlake.session import list_files, path_exists, read_text_file, write_text_new

SEGMENTS, MANIFEST = "_segments", "_manifest"
#: Logs that a stream writes to; their readers name the files.
STREAMED_LOGS = {"command_events"}
EPOCH_FILE = re.compile(r"(stream-.*-\d+)(?:\.(\d+)of(\d+))?\.parquet")


class ConcurrentCompactionError(RuntimeError):
    """Another compaction has published the same generation."""


@dataclass(frozen=True)
class Segment:
    name: str
    tables: list[str]
    bytes: int


@dataclass(frozen=True)
class Manifest:
    generation: int = 0
    segments: list[Segment] = field(default_factory=list)
    covered: dict[str, list[str]] = field(default_factory=dict)


def _names(spark: SparkSession, root: str) -> list[str]:
    return [n for n in list_files(spark, f"{root}/{MANIFEST}") if n.endswith(".json")]


def current(spark: SparkSession, root: str) -> Manifest:
    """The manifest in force; an empty one for a store that was never compacted."""
    names = _names(spark, root)
    if not names:
        return Manifest()
    found = json.loads(read_text_file(spark, f"{root}/{MANIFEST}/{names[-1]}"))
    return Manifest(found["generation"], [Segment(**s) for s in found["segments"]], found["covered"])


def publish(spark: SparkSession, root: str, manifest: Manifest) -> None:
    path = f"{root}/{MANIFEST}/{manifest.generation:012d}.json"
    if not write_text_new(spark, path, json.dumps(asdict(manifest))):
        raise ConcurrentCompactionError(f"generation {manifest.generation} is published already")


def compacted(spark: SparkSession, root: str, table: str, schema: T.StructType,
              manifest: Manifest | None = None) -> DataFrame | None:
    """The rows of a table that segments hold; None without any."""
    manifest = manifest or current(spark, root)
    paths = [f"{root}/{SEGMENTS}/{s.name}/{table}" for s in manifest.segments if table in s.tables]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def both(*parts: DataFrame | None) -> DataFrame | None:
    """The union of the parts that there are."""
    out = None
    for part in parts:
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out


def epoch_of(name: str) -> str | None:
    """The stream and epoch that a log's file is named after; None for the files of other writers."""
    found = EPOCH_FILE.fullmatch(name)
    return found and found[1]


def epoch_file(epoch: str, part: int, parts: int) -> str:
    return f"{epoch}.parquet" if parts == 1 else f"{epoch}.{part:05d}of{parts:05d}.parquet"


def torn(files: list[str]) -> set[str]:
    """Of a log's files, those whose set is not whole: a writer is at it, or has died."""
    sets = defaultdict(list)
    for m in map(EPOCH_FILE.fullmatch, files):
        if m and m[3]:
            sets[m[1], int(m[3])].append(m[0])
    return {f for (_, size), found in sets.items() if len(found) < size for f in found}


def log_files(spark: SparkSession, root: str, table: str, manifest: Manifest) -> tuple[list[str], list[str]]:
    """(files of a log that are not covered, in whole sets; covered files that are still there)."""
    covered = set(manifest.covered.get(table, ()))
    files = list_files(spark, f"{root}/{table}")
    live = [f for f in files if f not in covered]
    broken = torn(live)
    return [f for f in live if f not in broken], [f for f in files if f in covered]


def live_log(spark: SparkSession, root: str, table: str, schema: T.StructType, manifest: Manifest) -> DataFrame | None:
    """The rows of a log that no segment holds."""
    path = f"{root}/{table}"
    if not path_exists(spark, path):
        return None
    files, covered = log_files(spark, root, table, manifest)
    if not covered and table not in STREAMED_LOGS:
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in files]) if files else None


def read_log(spark: SparkSession, root: str, table: str, schema: T.StructType) -> DataFrame:
    """All rows of an append-only log; empty when there is none."""
    manifest = current(spark, root)
    rows = both(compacted(spark, root, table, schema, manifest), live_log(spark, root, table, schema, manifest))
    return spark.createDataFrame([], schema) if rows is None else rows
