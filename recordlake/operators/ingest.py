"""Keyed first-write-wins append into a Parquet record store.

Store layout under one root folder (``batch_id`` and ``attempt`` are partition columns)::

    jobs/batch_id=N/attempt=A/        first-written records (15 store columns + skills)
    job_skills/batch_id=N/attempt=A/  (job_id, skill) of those records
    rejects/batch_id=N/attempt=A/     quarantined lines
    job_keys/batch_id=N/attempt=A/    keys of those records in hash buckets (``operators.keys``)
    batches/batch_id=N/               ledger row: attempt, fingerprint, seen, inserted, skipped, ...
    _staging/A/                       validated copy of the input while attempt A runs

Commit protocol. Every attempt writes below a fresh attempt id, and the ledger
row, written last, names the attempt it commits; readers join the data with
the ledger on (batch_id, attempt). So what a crashed attempt leaves behind is
never read, whatever a later batch of that number holds. A committed batch is
never overwritten: the same input (by fingerprint) under its id returns the
ledger row and writes nothing, another input raises ``BatchConflictError``.
``next_batch_id`` is the one allocator (ledger maximum + 1) for callers,
scheduled runs and streams; one writer at a time is the contract.

First-wins inside a batch is a hash aggregation ``min(ord)`` per key over two
narrow columns, combined within each task before the shuffle, so a key repeated
in a third of the input costs one row per task. The narrow winners are
anti-joined with the keys of the store in the hash buckets that the batch
touches, and only then are the full records fetched from the staged batch. Where
the batch's keys are proven small (their bytes are counted while staging) those
keys are probed against a broadcast of them; otherwise both sides are shuffled
on the key. Compacted batches are read from segments (``sources.snapshots``).

The input is read, parsed and validated once, into the staged batch; line
numbers, statistics, first-wins and rejects use that columnar copy, which goes
when the batch is committed. The inserted count is an ``Observation`` on the jobs write itself.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlake.functions.text import clock_literal, second_clock
from recordlake.operators.keys import STORE_KEYS, in_buckets, touched_buckets, write_keys
from recordlake.operators.validate import RecordValidationError, diagnostic, failure_columns, validate
from recordlake.schemas import DEFAULT_SOURCE, JOBS
from recordlake.session import configure, delete_path, path_exists
from recordlake.sources.jsonl import PLACE, number_staged, place_lines, scan_lines
from recordlake.sources.snapshots import Manifest, both, compacted, current

MAX_BROADCAST_BYTES = 64 << 20  # of a batch's keys

STORE_JOBS = T.StructType([*JOBS.fields, T.StructField("skills", T.ArrayType(T.StringType())),
                           T.StructField("ord", T.LongType()), T.StructField("batch_id", T.LongType()),
                           T.StructField("attempt", T.StringType())])
STORE_SKILLS = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("skill", T.StringType()),
                             T.StructField("batch_id", T.LongType()), T.StructField("attempt", T.StringType())])
LEDGER = T.StructType([
    T.StructField("seen", T.LongType()), T.StructField("inserted", T.LongType()),
    T.StructField("skipped", T.LongType()), T.StructField("rejected", T.LongType()),
    T.StructField("source_query", T.StringType()), T.StructField("input_path", T.StringType()),
    T.StructField("committed_at", T.TimestampType()), T.StructField("status", T.StringType()),
    T.StructField("error_type", T.StringType()), T.StructField("redacted_error", T.StringType()),
    T.StructField("attempt", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("stream_id", T.StringType()), T.StructField("epoch", T.LongType()),
    T.StructField("batch_id", T.LongType()),
])
REJECTS = T.StructType([
    T.StructField("line_no", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("batch_id", T.LongType()), T.StructField("attempt", T.StringType()),
])
RECORD_OUT = ("job_id", "source", "title", "description", "url", "skills", "posted_at", "job_type",
              "contractor_tier", "hourly_min", "hourly_max", "fixed_amount", "raw_id")


def _table(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame | None:
    path = f"{root}/{name}"
    if not path_exists(spark, path):
        return None
    return spark.read.schema(schema).parquet(path)


class BatchConflictError(ValueError):
    """A committed batch id was given another input."""


def read_rejects(spark: SparkSession, root: str) -> DataFrame | None:
    """Quarantined lines of committed batches: ``(batch_id, line_no, status, reason, message)``."""
    rejects = _committed(spark, root, "rejects", REJECTS)
    return None if rejects is None else rejects.select("batch_id", "line_no", "status", "reason", "message")


def live_ledger(spark: SparkSession, root: str, manifest: Manifest) -> DataFrame | None:
    """Ledger rows of the batches that no segment holds."""
    live, old = _table(spark, root, "batches", LEDGER), compacted(spark, root, "batches", LEDGER, manifest)
    if live is None or old is None:
        return live
    return live.join(old.select("batch_id"), "batch_id", "left_anti")


def ledger(spark: SparkSession, root: str) -> DataFrame | None:
    manifest = current(spark, root)
    return both(compacted(spark, root, "batches", LEDGER, manifest), live_ledger(spark, root, manifest))


def live_committed(spark: SparkSession, root: str, name: str, schema: T.StructType, manifest: Manifest) -> DataFrame | None:
    """Rows of the committed batches that no segment holds."""
    df, led = _table(spark, root, name, schema), live_ledger(spark, root, manifest)
    if df is None or led is None:
        return None
    ok = led.where(F.col("status") == "success").select("batch_id", "attempt")
    return df.join(ok, ["batch_id", "attempt"], "left_semi")


def _committed(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame | None:
    manifest = current(spark, root)
    return both(compacted(spark, root, name, schema, manifest), live_committed(spark, root, name, schema, manifest))


def read_jobs(spark: SparkSession, root: str) -> DataFrame | None:
    """Committed jobs (NULL when the store has none)."""
    return _committed(spark, root, "jobs", STORE_JOBS)


def read_job_skills(spark: SparkSession, root: str) -> DataFrame | None:
    return _committed(spark, root, "job_skills", STORE_SKILLS)


def read_keys(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame | None:
    """Committed keys of some buckets. A store from before the index gets one from its records."""
    manifest = current(spark, root)
    if not path_exists(spark, f"{root}/job_keys/_SUCCESS") and not any("job_keys" in s.tables for s in manifest.segments):
        jobs = read_jobs(spark, root)
        if jobs is None or jobs.isEmpty():
            return None
        size = jobs.agg(F.sum(F.octet_length("job_id"))).first()[0]
        write_keys(jobs, f"{root}/job_keys", int(size))
    parts = [compacted(spark, root, "job_keys", STORE_KEYS, manifest), _table(spark, root, "job_keys", STORE_KEYS)]
    old, live = (None if p is None else in_buckets(p, buckets) for p in parts)
    led = live_ledger(spark, root, manifest)
    if live is not None and led is not None:
        live = live.join(led.where(F.col("status") == "success").select("batch_id", "attempt"), ["batch_id", "attempt"], "left_semi")
    return both(old, live if led is not None else None)


def next_batch_id(spark: SparkSession, root: str) -> int:
    """The id after all that the ledger holds, failed batches included."""
    led = ledger(spark, root)
    top = None if led is None else led.agg(F.max("batch_id")).first()[0]
    return 1 if top is None else int(top) + 1


def first_per_key(records: DataFrame, key: str = "job_id", order: str = "ord") -> DataFrame:
    """K1 within a batch: ``(key, order)`` of the earliest record per key."""
    return records.groupBy(key).agg(F.min(order).alias(order))


def new_only(candidates: DataFrame, existing: DataFrame | None, key: str = "job_id",
             candidate_bytes: int | None = None) -> DataFrame:
    """Candidates whose key is not in ``existing`` (left anti).

    ``candidate_bytes`` is a counted bound on the size of the candidates'
    keys; within ``MAX_BROADCAST_BYTES`` the store is only probed against
    broadcast batch keys.
    """
    if existing is None:
        return candidates
    store_keys = existing.select(key)
    if candidate_bytes is not None and candidate_bytes <= MAX_BROADCAST_BYTES:
        hit = store_keys.join(F.broadcast(candidates.select(key)), key, "left_semi")
        return candidates.join(F.broadcast(hit), key, "left_anti")
    return candidates.join(store_keys, key, "left_anti")


def plan_new_records(valid: DataFrame, existing: DataFrame | None, clock: dt.datetime,
                     candidate_bytes: int | None = None) -> DataFrame:
    """K1+S10: the store rows a batch would insert (first per key, absent from store)."""
    winners = new_only(first_per_key(valid.select("job_id", "ord")), existing, candidate_bytes=candidate_bytes)
    if candidate_bytes is not None and candidate_bytes <= MAX_BROADCAST_BYTES:
        winners = F.broadcast(winners)
    fresh = valid.select(*RECORD_OUT, "content_hash", "ord").join(winners, ["job_id", "ord"], "left_semi")
    ts = clock_literal(clock)
    return fresh.select(
        *[c for c in JOBS.fieldNames() if c not in ("first_seen_at", "created_at")],
        ts.alias("first_seen_at"), ts.alias("created_at"), "skills", "ord",
    )


def _staged_facts(staged: DataFrame) -> Row:
    """One pass over the staged batch: the counts and first error of Q1/Q2, a fingerprint of the input (order and
    content of every line), the bytes of its keys with their orders, and the hash buckets that they touch."""
    line = F.xxhash64("ord", "status", F.coalesce("content_hash", "message", F.lit("")))
    mark = F.concat_ws(":", F.count("*"), F.coalesce(F.bit_xor(line), F.lit(0)),
                       F.coalesce(F.sum(F.pmod(line, F.lit(1 << 31))), F.lit(0)))
    size = F.coalesce(F.sum(F.coalesce(F.octet_length("job_id"), F.lit(0)) + 24), F.lit(0))
    return staged.agg(*failure_columns(), mark.alias("fingerprint"), size.alias("key_bytes"),
                      touched_buckets("job_id").alias("buckets")).first()


def stage_lines(spark: SparkSession, checked: DataFrame, folder: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``validate``'s output over placed lines (``jsonl.place_lines``), written once below ``folder``
    and numbered there: with ``line_no`` and ``message``, from one scan of the text."""
    checked.select(*PLACE, *columns).write.option("compression", "zstd").parquet(f"{folder}/lines")
    rows = number_staged(spark, f"{folder}/lines", f"{folder}/splits")
    return rows.select("line_no", *columns, diagnostic().alias("message"))


def ingest_checked(spark: SparkSession, root: str, checked: DataFrame, batch_id: int | None = None, *,
                   clock: dt.datetime | None = None, mode: str = "strict",
                   source_query: str | None = None, input_path: str | None = None,
                   stream: tuple[str, int] | None = None) -> DataFrame:
    """K1–K5: append the valid lines of ``checked`` (output of ``validate`` with
    an ``ord`` column, or over placed lines, whose order is their number) as batch
    ``batch_id`` (None: the next id); returns the ledger row.

    ``strict``: any rejected line aborts before anything is written (Q1).
    ``quarantine``: rejected lines are kept (``read_rejects``) and the rest is
    ingested. ``stream`` is the (stream id, epoch) that the batch comes from.
    """
    if mode not in ("strict", "quarantine"):
        raise ValueError("mode must be 'strict' or 'quarantine'")
    configure(spark)
    clock = second_clock(clock)
    attempt = uuid.uuid4().hex
    staging = f"{root}/_staging/{attempt}"
    keep = ["status", "reason", *RECORD_OUT, "content_hash"]
    try:
        if "line_no" in checked.columns:
            checked.select("line_no", "ord", "message", *keep).write.option("compression", "zstd").parquet(staging)
            staged = spark.read.parquet(staging)
        else:
            staged = stage_lines(spark, checked, staging, keep).withColumn("ord", F.col("line_no"))
        stats = _staged_facts(staged)
        if mode == "strict" and stats["first_error"] is not None:
            raise RecordValidationError(stats["first_error"])
        fingerprint, key_bytes = stats["fingerprint"], int(stats["key_bytes"])
        batch_id = next_batch_id(spark, root) if batch_id is None else batch_id
        prior = committed_batch(spark, root, batch_id)
        if prior is not None:
            if prior["fingerprint"] != fingerprint:
                raise BatchConflictError(f"batch {batch_id} is already committed with another input")
            return ledger(spark, root).where(F.col("batch_id") == batch_id)
        inserted = write_attempt(spark, root, staged, batch_id, attempt, clock, key_bytes, int(stats["rejected"]),
                                 list(stats["buckets"]))
        seen = int(stats["seen"])
        write_ledger_row(spark, root, (seen, inserted, seen - inserted, int(stats["rejected"]), source_query, input_path,
                                       clock, "success", None, None, attempt, fingerprint, *(stream or (None, None)), batch_id))
    finally:
        delete_path(spark, staging)
    return ledger(spark, root).where(F.col("batch_id") == batch_id)


def write_attempt(spark: SparkSession, root: str, staged: DataFrame, batch_id: int, attempt: str, clock: dt.datetime,
                  key_bytes: int | None = None, rejected: int = 0, buckets: list[int] | None = None) -> int:
    """The data of one attempt, unread until the ledger names it; returns the number of new records."""
    named = [F.lit(batch_id).cast("long").alias("batch_id"), F.lit(attempt).alias("attempt")]

    def put(df: DataFrame, name: str, bloom: bool = True) -> None:
        writer = df.select("*", *named).write.mode("append").option("compression", "zstd").partitionBy("batch_id", "attempt")
        (writer.option("parquet.bloom.filter.enabled#job_id", "true") if bloom else writer).parquet(f"{root}/{name}")

    new = plan_new_records(staged.where(F.col("status") == "valid"), read_keys(spark, root, buckets), clock, key_bytes)
    counted = Observation(f"inserted-{attempt}")
    put(new.observe(counted, F.count(F.lit(1)).alias("inserted")).sortWithinPartitions("job_id"), "jobs")
    inserted = int(counted.get["inserted"])
    if inserted:
        written = spark.read.schema(T.StructType(STORE_JOBS.fields[:-2])).parquet(
            f"{root}/jobs/batch_id={batch_id}/attempt={attempt}")
        put(written.select("job_id", F.explode("skills").alias("skill")).sortWithinPartitions("job_id"), "job_skills")
        write_keys(written.select("job_id", *named), f"{root}/job_keys", key_bytes or 0)
    if rejected:
        put(staged.where(F.col("message").isNotNull()).select("line_no", "status", "reason", "message"), "rejects", False)
    return inserted


def committed_batch(spark: SparkSession, root: str, batch_id: int) -> Row | None:
    led = ledger(spark, root)
    return None if led is None else led.where((F.col("batch_id") == batch_id) & (F.col("status") == "success")).first()


def stream_batch(spark: SparkSession, root: str, stream_id: str, epoch: int) -> Row | None:
    """The ledger row of a stream's micro-batch, if it has one."""
    led = ledger(spark, root)
    return None if led is None else led.where((F.col("stream_id") == stream_id) & (F.col("epoch") == epoch)).first()


def write_ledger_row(spark: SparkSession, root: str, row: tuple) -> None:
    """One ledger row per batch; only the row of a failed batch is ever replaced."""
    (spark.createDataFrame([row], LEDGER).coalesce(1)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(f"{root}/batches"))


def record_failed_batch(spark: SparkSession, root: str, batch_id: int, error: BaseException,
                        clock: dt.datetime | None = None, source_query: str | None = None,
                        stream: tuple[str, int] | None = None) -> None:
    """K4: a failed batch leaves zero counters, its error type and a redacted message;
    nothing of it becomes visible. A committed batch stays as it is."""
    from recordlake.functions.redact import redact

    if committed_batch(spark, root, batch_id) is not None:
        raise BatchConflictError(f"batch {batch_id} is already committed")
    msg = spark.range(1).select(redact(F.lit(str(error))).alias("m")).first()["m"]
    write_ledger_row(spark, root, (0, 0, 0, 0, source_query, None, second_clock(clock), "failed", type(error).__name__, msg,
                                   None, None, *(stream or (None, None)), batch_id))


def ingest_jsonl(spark: SparkSession, root: str, path: str | list[str], batch_id: int | None = None, *,
                 source: str = DEFAULT_SOURCE, clock: dt.datetime | None = None, mode: str = "strict",
                 source_query: str | None = None, exact_casefold: bool | None = None) -> DataFrame:
    """CLI ``ingest``: JSON lines file(s) → validated → first-wins append. ``exact_casefold`` (X2) is the
    store's own, exact by default; a value that differs from it is an error, unless the store is still empty."""
    from recordlake.sources.store import settle_folding

    exact_casefold = settle_folding(spark, root, exact_casefold)
    lines = place_lines(scan_lines(spark, path))
    checked = validate(lines, source=source, exact_casefold=exact_casefold)
    return ingest_checked(spark, root, checked, batch_id, clock=clock, mode=mode, source_query=source_query,
                          input_path=path if isinstance(path, str) else ",".join(path))


def new_jobs(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """K5: the 13-column ingest response of the records a batch inserted."""
    jobs = read_jobs(spark, root)
    return jobs.where(F.col("batch_id") == batch_id).select(*RECORD_OUT)
