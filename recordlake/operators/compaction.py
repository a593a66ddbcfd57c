"""Compaction of a store: few large files instead of many small ones.

``compact`` copies the committed batches and the logs' files into one new segment
and publishes a manifest (``sources.snapshots``); ``vacuum`` then deletes what no
reader uses any more: compacted folders and log files, dead attempts, replaced
segments and staging folders. Both belong to the store's one writer. A crash
before the manifest leaves an unread segment, a crash after it leaves unread
small files; the next ``vacuum`` removes either.

Segments are tiered by size: a new one takes in the older ones that are at most
``FAN`` times as large as what it has so far, so a record is rewritten a
logarithmic number of times and there are few segments. A segment's tables are
range-partitioned by key into files of about ``target_bytes``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlake.operators import ingest as I
from recordlake.operators.keys import STORE_KEYS
from recordlake.plans.scheduled import STORED_RESULTS
from recordlake.schemas import COMMAND_EVENTS, CONFIG_EVENTS, RUN_EVENTS
from recordlake.session import configure, delete_path, list_dirs, list_files, path_bytes
from recordlake.sources import snapshots as S

TARGET_BYTES = 128 << 20
FAN = 4

#: Record table -> its schema, and what its files are sorted by.
RECORD_TABLES: dict[str, tuple[T.StructType, tuple[str, ...]]] = {
    "batches": (I.LEDGER, ("batch_id",)),
    "jobs": (I.STORE_JOBS, ("job_id",)),
    "job_skills": (I.STORE_SKILLS, ("job_id", "skill")),
    "job_keys": (STORE_KEYS, ("bucket", "job_id")),
    "rejects": (I.REJECTS, ("batch_id", "line_no")),
}
LOG_TABLES: dict[str, tuple[T.StructType, tuple[str, ...]]] = {
    "run_events": (RUN_EVENTS, ("run_id", "seq")),
    "run_results": (STORED_RESULTS, ("run_id", "query_ix")),
    "config_events": (CONFIG_EVENTS, ("key", "seq")),
    "command_events": (COMMAND_EVENTS, ("command_id", "seq")),
}


def _rewrite(df: DataFrame | None, path: str, order: tuple[str, ...], size: int, target: int) -> bool:
    """Writes the rows sorted into files of about ``target`` bytes; False when there is no row."""
    if df is None:
        return False
    files = max(1, -(-size // target))
    spread = df.repartitionByRange(files, *order) if files > 1 else df.coalesce(1)
    writer = spread.sortWithinPartitions(*order).write
    if "job_id" in order:
        writer = writer.option("parquet.bloom.filter.enabled#job_id", "true")
    writer.parquet(path)
    return bool(list_files(df.sparkSession, path))


def _taken(segments: list[S.Segment], size: int) -> list[S.Segment]:
    """The segments that a new one of this size takes in, newest first."""
    taken = []
    for segment in reversed(segments):
        if segment.bytes > FAN * max(size, 1):
            break
        taken.append(segment)
        size += segment.bytes
    return taken


def _last_epochs(covered: list[str], files: list[str]) -> list[str]:
    """Of the stream files that were covered, one of the last epoch of each stream: a restarted stream replays that
    epoch and must find that it was there."""
    found = [f for f in sorted({*covered, *files}) if S.epoch_of(f)]
    return list({S.epoch_of(f).rsplit("-", 1)[0]: f for f in found}.values())


def compact(spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES) -> S.Manifest:
    """One new segment with all committed batches and log files that no segment holds; returns the manifest in force."""
    configure(spark)
    before = S.current(spark, root)
    tables = [*RECORD_TABLES, *LOG_TABLES]
    live_bytes = {name: path_bytes(spark, f"{root}/{name}") for name in tables}
    taken = _taken(before.segments, sum(live_bytes.values()))
    own = S.Manifest(before.generation, taken)
    name = f"{before.generation + 1:012d}-{uuid.uuid4().hex[:8]}"
    base = f"{root}/{S.SEGMENTS}/{name}"

    def size(table: str) -> int:
        old = (path_bytes(spark, f"{root}/{S.SEGMENTS}/{s.name}/{table}") for s in taken if table in s.tables)
        return live_bytes[table] + sum(old)

    written = []
    # The ledger goes first: its copy says which batches the other tables take.
    live = I.live_ledger(spark, root, before)
    live = None if live is None else live.where(F.col("status") == "success")
    ledger = S.both(S.compacted(spark, root, "batches", I.LEDGER, own), live)
    if _rewrite(ledger, f"{base}/batches", RECORD_TABLES["batches"][1], size("batches"), target_bytes):
        written.append("batches")
        batches = spark.read.schema(I.LEDGER).parquet(f"{base}/batches").select("batch_id", "attempt")
        for table, (schema, order) in list(RECORD_TABLES.items())[1:]:
            if table == "job_keys":
                I.read_keys(spark, root, [])  # a store from before the index gets it now
            rows = I.live_committed(spark, root, table, schema, before)
            rows = None if rows is None else rows.join(batches, ["batch_id", "attempt"], "left_semi").select(schema.fieldNames())
            rows = S.both(S.compacted(spark, root, table, schema, own), rows)
            if _rewrite(rows, f"{base}/{table}", order, size(table), target_bytes):
                written.append(table)
    covered = {}
    for table, (schema, order) in LOG_TABLES.items():
        files, old = S.log_files(spark, root, table, before)
        rows = spark.read.schema(schema).parquet(*[f"{root}/{table}/{f}" for f in files]) if files else None
        rows = S.both(S.compacted(spark, root, table, schema, own), rows)
        if _rewrite(rows, f"{base}/{table}", order, size(table), target_bytes):
            written.append(table)
        covered[table] = sorted({*files, *old, *_last_epochs(before.covered.get(table, []), files)})
    kept = [s for s in before.segments if s not in taken]
    after = S.Manifest(before.generation + 1, [*kept, S.Segment(name, written, path_bytes(spark, base))], covered)
    S.publish(spark, root, after)
    return after


def vacuum(spark: SparkSession, root: str) -> int:
    """Deletes what no read of the current state uses; returns the number of files and folders deleted. To be
    called by the store's writer between batches: readers that began before may miss files."""
    manifest = S.current(spark, root)
    gone = []
    ledger = I.ledger(spark, root)
    if ledger is not None:
        state = ledger.select("batch_id", "attempt", "status")
        inside = S.compacted(spark, root, "batches", I.LEDGER, manifest)
        for table in RECORD_TABLES:
            folders = [d for d in list_dirs(spark, f"{root}/{table}") if d.startswith("batch_id=")]
            if not folders:
                continue
            here = spark.createDataFrame([(int(d.split("=")[1]), d) for d in folders], "batch_id long, folder string")
            if inside is not None:
                done = here.join(inside.select("batch_id"), "batch_id", "left_semi")
                gone += [f"{root}/{table}/{r.folder}" for r in done.collect()]
            if table == "batches":
                continue
            held = {f"{root}/{table}/{d}" for d in folders} - set(gone)
            names = [(int(p.rsplit("=", 1)[1]), a.split("=")[1], f"{p}/{a}")
                     for p in sorted(held) for a in list_dirs(spark, p) if a.startswith("attempt=")]
            if names:
                attempts = spark.createDataFrame(names, "batch_id long, attempt string, folder string")
                alive = state.where(F.col("status") == "success")
                gone += [r.folder for r in attempts.join(alive, ["batch_id", "attempt"], "left_anti").collect()]
    for table in LOG_TABLES:
        gone += [f"{root}/{table}/{f}" for f in S.log_files(spark, root, table, manifest)[1]]
    used = {s.name for s in manifest.segments}
    gone += [f"{root}/{S.SEGMENTS}/{d}" for d in list_dirs(spark, f"{root}/{S.SEGMENTS}") if d not in used]
    gone += [f"{root}/_staging/{d}" for d in list_dirs(spark, f"{root}/_staging")]
    gone += [f"{root}/{S.MANIFEST}/{n}" for n in list_files(spark, f"{root}/{S.MANIFEST}")
             if n != f"{manifest.generation:012d}.json"]
    for path in gone:
        delete_path(spark, path)
    return len(gone)
