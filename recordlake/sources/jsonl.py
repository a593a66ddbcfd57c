"""JSON-lines source with exact line numbers.

A path may be one file, a folder or a glob; the files are one logical stream
in path order (like ``cat``), and line numbers are 1-based across it. Blank
lines keep their number but carry no record.

Numbering never funnels the data through one task. Each input split reports
``(file, block_start, count, first_row_id)``; a window over that metadata (one
row per split) turns counts into offsets, and every line gets
``offset + (row_id - first_row_id) + 1``. Rows of one split are contiguous
inside their task, so the difference of ``monotonically_increasing_id`` values
is the position within the split. The offsets table is broadcast only when
its size is bounded — from file-system metadata (bytes / minimum split size +
files) or, for globs and micro-batches, by counting it; beyond the bound it is
joined by a shuffle. Offsets inside a file come from a window partitioned by
file; the only single-task step is the running sum over one row per file, the
list of which Spark's own file index holds on the driver anyway.

``read_lines`` numbers lines lazily and so scans the text twice. Callers that
write what they make of the lines read the text once: ``place_lines`` gives
each line its place (``PLACE``), and ``number_staged`` numbers the written rows
from the place columns alone, of which a columnar scan reads nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from recordlake.session import configure, path_exists

#: Where a line stands: its file, its input split and its row in the scan.
PLACE = ("file_path", "block_start", "row_id")

# Split-offset rows that may be broadcast (one row per input split).
MAX_BROADCAST_SPLITS = 200_000


class InputPathError(ValueError):
    """Missing or unreadable input path (usage error)."""


def _is_glob(path: str) -> bool:
    return any(c in path for c in "*?[{")


def scan_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(line, file_path, block_start)`` rows of text files (S7: path, folder or glob)."""
    configure(spark)
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        if not _is_glob(p) and not path_exists(spark, p):
            raise InputPathError("input path is missing or unreadable")
    return spark.read.text(paths).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def _bytes(text: str) -> int:
    t = str(text).strip().lower().rstrip("b")
    mult = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(t[-1:], 1)
    return int(float(t[:-1] if t[-1:] in "kmgt" and t[-1:] else t) * mult)


def split_bound(spark: SparkSession, paths: list[str]) -> int | None:
    """Upper bound on the number of input splits, from file-system metadata only
    (total bytes / split size + file count); None for globs."""
    if any(_is_glob(p) for p in paths):
        return None
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    # Splits are never smaller than min(maxPartitionBytes, openCostInBytes).
    split = min(_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")),
                _bytes(spark.conf.get("spark.sql.files.openCostInBytes", "4m")))
    total, files = 0, 0
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        summary = hp.getFileSystem(conf).getContentSummary(hp)
        total += int(summary.getLength())
        files += int(summary.getFileCount())
    return total // max(split, 1) + files + 1


def place_lines(raw: DataFrame) -> DataFrame:
    """``(file_path, block_start, row_id, line)`` from ``(line, file_path, block_start)`` rows of one scan, blank lines included."""
    return raw.select("file_path", "block_start", F.monotonically_increasing_id().alias("row_id"), "line")


def split_offsets(placed: DataFrame) -> DataFrame:
    """Per split, the row id of its first line and the number of lines before it in the whole input."""
    splits = placed.groupBy("file_path", "block_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("row_id").alias("_rid0")
    )
    before = Window.unboundedPreceding, -1
    # Offset of a split inside its file: a window per file over its splits.
    in_file = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(*before)
    # Offset of a file in the stream: one row per file, in path order.
    files = splits.groupBy("file_path").agg(F.sum("_n").alias("_fn"))
    file_off = files.select(
        "file_path", F.coalesce(F.sum("_fn").over(Window.orderBy("file_path").rowsBetween(*before)),
                                F.lit(0)).alias("_foff"))
    return splits.select(
        "file_path", "block_start", "_rid0",
        F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_soff"),
    ).join(file_off, "file_path").select(
        "file_path", "block_start", "_rid0", (F.col("_foff") + F.col("_soff")).alias("_offset"))


def _numbered(placed: DataFrame, offsets: DataFrame, n_splits: int) -> DataFrame:
    side = F.broadcast(offsets) if n_splits <= MAX_BROADCAST_SPLITS else offsets
    line_no = (F.col("_offset") + F.col("row_id") - F.col("_rid0") + 1).alias("line_no")
    rest = [c for c in placed.columns if c not in PLACE]
    return placed.join(side, ["file_path", "block_start"]).select("file_path", line_no, *rest)


def number_lines(raw: DataFrame, bound: int | None = None) -> DataFrame:
    """``(file_path, line_no, line)`` from ``(line, file_path, block_start)`` rows of one scan.

    ``bound`` is a known upper bound on the number of splits; without one the
    split table is counted before deciding to broadcast it.
    """
    placed = place_lines(raw)
    offsets = split_offsets(placed)
    return _numbered(placed, offsets, bound if bound is not None else offsets.count())


def number_staged(spark: SparkSession, lines: str, splits: str) -> DataFrame:
    """The rows written at ``lines`` (all lines of an input, by place) with ``line_no`` instead of their place.

    The offsets are written at ``splits``, a row per input split, and counted as
    they are, so every later read of the result joins a small table and no text is
    scanned again. No rows: an empty result.
    """
    placed, n = spark.read.parquet(lines), Observation()
    split_offsets(placed.select(*PLACE)).observe(n, F.count(F.lit(1)).alias("n")).write.parquet(splits)
    return _numbered(placed, spark.read.parquet(splits), int(n.get["n"]))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file_path, line_no, line)`` for every physical line of the input."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = scan_lines(spark, paths)
    return number_lines(raw, split_bound(spark, paths))


def write_lines(df: DataFrame, path: str, order_col: str, column: str = "line", parts: int | None = None,
                mode: str = "overwrite") -> str:
    """Write one text line per row, files in ``order_col`` order (range-partitioned,
    sorted within each file) so that path order is stream order."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        df.repartitionByRange(n, order_col)
        .sortWithinPartitions(order_col)
        .select(column)
        .write.mode(mode)
        .text(path)
    )
    return path


def read_whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file, ``(file_path, body)`` — each file is one JSON document."""
    configure(spark)
    paths = [path] if isinstance(path, str) else list(path)
    for p in paths:
        if not _is_glob(p) and not path_exists(spark, p):
            raise InputPathError("fixture path is missing or unreadable")
    return spark.read.text(paths, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("body"))
