"""Recurring and one-shot ingestion as Structured Streaming queries.

A file stream over a landing folder discovers new JSON-lines files; every
micro-batch runs the same validate → first-write-wins append as the batch
path. A micro-batch is known by (stream id, epoch): the stream id is the one
Structured Streaming keeps in the checkpoint, the store's batch id comes from
the store's one allocator. Structured Streaming re-delivers the same files under
the same epoch after a failure; an epoch that the ledger holds as committed is
skipped, so the pipeline is exactly-once, and a stream with a fresh checkpoint
gets new batch ids and never touches what is stored.

* R1 recurring run: ``trigger(processingTime=interval)``.
* R2 one-shot run: ``trigger(availableNow=True)`` (works while paused).
* R3 keyed dedupe state: the store itself (anti join per micro-batch); in front of it,
  if asked for, the digests of the lines seen of late (``dedupe_within``).
* R4 ledger: one row per micro-batch, written after its data.
* R6 failure tolerance: an expected validation failure (strict mode) is
  recorded as a failed batch and the stream continues; anything else stops it.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordlake.operators.ingest import ingest_checked, next_batch_id, record_failed_batch, stream_batch
from recordlake.operators.validate import RecordValidationError, validate
from recordlake.schemas import COMMAND_EVENTS, DEFAULT_SOURCE
from recordlake.session import configure, delete_path, list_files, move_new, path_bytes
from recordlake.sources.jsonl import place_lines, read_lines
from recordlake.sources.snapshots import current, epoch_file, epoch_of, read_log, torn
from recordlake.sources.store import settle_folding

SMALL_EPOCH_BYTES = 16 << 20  # up to which an epoch of a log is one file


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Structured Streaming keeps in a checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def _trigger(writer, interval: str | None):
    return writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)


def sightings(lines: DataFrame, within: str) -> DataFrame:
    """Of a stream of text lines, the digests not seen in the last ``within`` (of arrival), and the files of each micro-batch.

    One narrow row per new digest, and at least one per file (``file`` set, ``digest`` empty). The state holds
    digests only, forgets them by the watermark, and is shuffled by digest; the rows that name a file are
    spread by input split, so no file is one hot key. Arrival is the micro-batch's time, so no line is late.
    """
    path, split = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    line = F.struct(F.unhex(F.sha2("value", 256)).alias("digest"), F.lit("").alias("file"), F.lit(-1).cast("long").alias("split"))
    landed = F.struct(F.lit(b"").alias("digest"), path.alias("file"), split.alias("split"))
    return (lines.select(F.current_timestamp().alias("arrived"), F.explode(F.array(line, landed)).alias("seen"))
            .select("arrived", "seen.*").withWatermark("arrived", within)
            .dropDuplicatesWithinWatermark(["digest", "file", "split"]))


def new_lines(spark: SparkSession, sighted: DataFrame, path: str) -> DataFrame | None:
    """``(file_path, line_no, line)`` of a micro-batch's files, without the lines seen in earlier micro-batches; None
    without files. Lines are numbered before; of lines repeated within the micro-batch all are there, so first-wins
    goes by their order. ``path`` takes the sightings, so that the state is read once."""
    sighted.write.parquet(path)
    written = spark.read.schema(sighted.select("digest", "file").schema).parquet(path)
    # As many names as the file source itself keeps for a micro-batch (``max_files_per_trigger`` bounds them).
    files = [r.file for r in written.where(F.col("file") != "").select("file").distinct().collect()]
    if not files:
        return None
    names = [re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(f)) for f in files]
    digests = written.where(F.col("file") == "").select("digest")
    return (read_lines(spark, sorted(names)).withColumn("digest", F.unhex(F.sha2("line", 256)))
            .join(digests, "digest", "left_semi").drop("digest"))


def start_ingest_stream(spark: SparkSession, landing: str, store_root: str, checkpoint: str, *,
                        source: str = DEFAULT_SOURCE, mode: str = "quarantine", interval: str | None = None,
                        max_files_per_trigger: int | None = None, dedupe_within: str | None = None,
                        clock: dt.datetime | None = None) -> StreamingQuery:
    """Start the landing-folder → store stream; ``interval=None`` runs once over what is there.

    ``dedupe_within`` (an interval such as ``"1 day"``) drops lines that an earlier micro-batch of this stream
    held, byte for byte, within that time: they are not parsed, not counted as seen and never meet the store's
    keys. What is stored stays the same, as the store itself decides first-wins. Quarantine mode only, as a
    strict batch that failed must be read again when it is delivered again. For states beyond the executors' memory
    set Spark's RocksDB state store.
    """
    configure(spark)
    if dedupe_within and mode != "quarantine":
        raise ValueError("dedupe_within needs quarantine mode")
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(landing).select("value", "_metadata")
    if dedupe_within:
        stream = sightings(stream, dedupe_within)

    def lines_of(df: DataFrame, seen: str) -> DataFrame | None:
        if dedupe_within:
            found = new_lines(spark, df, seen)
            return None if found is None else found.withColumn("ord", F.col("line_no"))
        return place_lines(df.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_path"),
                                     F.col("_metadata.file_block_start").alias("block_start")))

    def on_batch(df: DataFrame, epoch_id: int) -> None:
        key = (stream_id(spark, checkpoint), epoch_id)
        known = stream_batch(spark, store_root, *key)
        if known is not None and known["status"] == "success":
            return
        seen = f"{store_root}/_staging/seen-{uuid.uuid4().hex}"
        try:
            lines = lines_of(df, seen)
            if lines is None:  # a micro-batch that only moves the watermark
                return
            batch_id = known["batch_id"] if known is not None else next_batch_id(spark, store_root)
            checked = validate(lines, source=source, exact_casefold=settle_folding(spark, store_root))
            try:
                ingest_checked(spark, store_root, checked, batch_id, clock=clock, mode=mode, input_path=landing,
                               stream=key)
            except RecordValidationError as exc:
                record_failed_batch(spark, store_root, batch_id, exc, clock=clock, stream=key)
        finally:
            if dedupe_within:
                delete_path(spark, seen)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return _trigger(writer, interval).start()


def run_ingest_once(spark: SparkSession, landing: str, store_root: str, checkpoint: str, **kw) -> None:
    """R2: process everything landed so far, then stop."""
    q = start_ingest_stream(spark, landing, store_root, checkpoint, interval=None, **kw)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def publish_epoch(spark: SparkSession, rows: DataFrame, folder: str, epoch: str) -> bool:
    """Writes rows as an epoch's files of a log; False, and nothing is written, when the epoch is there already.

    The tasks that read the rows write them, a file each, staged beside the log; a small epoch becomes one file. The
    files are renamed one by one, and readers take none of a set before all are there (``snapshots.torn``); what a
    crashed attempt left of its set goes first."""
    there = [f for f in list_files(spark, folder) if epoch_of(f) == epoch]
    left = torn(there)
    if len(there) > len(left):
        return False
    for name in left:
        delete_path(spark, f"{folder}/{name}")
    staging = f"{folder.rsplit('/', 1)[0]}/_staging/{epoch}-{uuid.uuid4().hex}"
    staged = f"{staging}/rows"
    try:
        rows.write.parquet(staged)
        if len(list_files(spark, staged)) > 1 and path_bytes(spark, staged) <= SMALL_EPOCH_BYTES:
            spark.read.schema(rows.schema).parquet(staged).coalesce(1).write.parquet(f"{staging}/one")
            staged = f"{staging}/one"
        parts = list_files(spark, staged)
        moved = [move_new(spark, f"{staged}/{part}", f"{folder}/{epoch_file(epoch, k, len(parts))}")
                 for k, part in enumerate(parts)]
        return bool(parts) and all(moved)
    finally:
        delete_path(spark, staging)


def start_command_stream(spark: SparkSession, landing: str, store_root: str, checkpoint: str, *,
                         interval: str | None = None) -> StreamingQuery:
    """Command events (JSON lines) appended to the store's command log, in the one layout
    that all its writers share. A micro-batch's files are named after (stream id, epoch): a
    replayed epoch finds them and writes nothing, so the log holds each event once."""
    configure(spark)
    stream = spark.readStream.schema(COMMAND_EVENTS).json(landing)

    def on_batch(df: DataFrame, epoch_id: int) -> None:
        epoch = f"stream-{stream_id(spark, checkpoint)}-{epoch_id:012d}"
        if epoch not in map(epoch_of, current(spark, store_root).covered.get("command_events", ())):
            publish_epoch(spark, df, f"{store_root}/command_events", epoch)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return _trigger(writer, interval).start()


def read_command_log(spark: SparkSession, store_root: str) -> DataFrame:
    return read_log(spark, store_root, "command_events", COMMAND_EVENTS).dropDuplicates(["command_id", "seq", "status"])
