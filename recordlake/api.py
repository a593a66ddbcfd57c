"""Store-level entry points (the user-facing surface of §2.16).

Each read validates its limit first, then checks the store's readiness
(never creating anything), then returns a lazy DataFrame; envelopes
(``{ok, status, rows}``) are built only at the edge with ``reads.envelope``.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.operators import analytics as A
from recordlake.operators import compaction as K
from recordlake.operators import control as C
from recordlake.operators import ingest as I
from recordlake.operators import ledger as L
from recordlake.operators import normalize as N
from recordlake.operators import reads as R
from recordlake.operators import status as ST
from recordlake.plans import scheduled as SCH
from recordlake.schemas import COMMAND_EVENTS, COMMAND_TYPES, CONFIG_EVENTS
from recordlake.sources import store as S
from recordlake.functions.text import comma_list
from recordlake.session import delete_path
from recordlake.sources.jsonl import read_whole_files, write_lines
from recordlake.sources.snapshots import read_log

# Fixed value: the command line's diagnostic.
MSG_NO_QUERIES = "--queries must contain at least one query"


class NotReadyError(RuntimeError):
    def __init__(self, verdict: dict):
        super().__init__(verdict["reason"])
        self.verdict = verdict

    def to_dict(self) -> dict:
        nxt = "upgrade or migrate the store" if self.verdict["reason"] == "unsupported_schema" else "start the worker"
        return {"ok": False, "error": "not_ready", "reason": self.verdict["reason"],
                "details": self.verdict["details"], "next_action": nxt}


def ensure_ready(spark: SparkSession, root: str) -> None:
    """Q8: raise ``NotReadyError`` unless the store exists, is supported and complete."""
    v = S.readiness_verdict(spark, root, check_config=False)
    if not v["ok"]:
        raise NotReadyError(v)


def _jobs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    jobs, skills = I.read_jobs(spark, root), I.read_job_skills(spark, root)
    if jobs is None:
        jobs = spark.createDataFrame([], I.STORE_JOBS)
    if skills is None:
        skills = spark.createDataFrame([], I.STORE_SKILLS)
    return jobs, skills


def recent(spark: SparkSession, root: str, limit: int = 20) -> DataFrame:
    R.validate_limit(limit)
    ensure_ready(spark, root)
    return R.recent(*_jobs(spark, root), limit=limit)


def search(spark: SparkSession, root: str, title: str | None = None, skill: str | None = None,
           limit: int = 20) -> DataFrame:
    R.validate_limit(limit)
    ensure_ready(spark, root)
    return R.search(*_jobs(spark, root), title=title, skill=skill, limit=limit, exact_casefold=S.folding(spark, root))


def get(spark: SparkSession, root: str, job_id: str) -> DataFrame:
    ensure_ready(spark, root)
    return R.get(*_jobs(spark, root), job_id)


def analytics(spark: SparkSession, root: str, name: str, skill: str | None = None, title: str | None = None,
              limit: int | None = None) -> DataFrame:
    jobs, skills = _jobs(spark, root)
    return A.run_query(spark, name, jobs, skills, skill=skill, title=title, limit=limit,
                       exact_casefold=S.folding(spark, root))


def _log(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    rows = read_log(spark, root, name, schema)
    return rows.dropDuplicates(["command_id", "seq", "status"]) if schema is COMMAND_EVENTS else rows


def config(spark: SparkSession, root: str) -> DataFrame:
    """Effective worker config: persisted updates and applied commands over the defaults."""
    ensure_ready(spark, root)
    cfg = _log(spark, root, "config_events", CONFIG_EVENTS).withColumn("scope", F.lit("worker"))
    return C.config_after_commands(spark, cfg, _log(spark, root, "command_events", COMMAND_EVENTS))


def enqueue(spark: SparkSession, root: str, command_type: str, payload: dict | None = None,
            command_id: str | None = None, clock: dt.datetime | None = None,
            requested_by: str = "mcp") -> dict:
    """T4: append a queued command event; ``update_config`` payloads are validated first (Q6)."""
    if command_type not in COMMAND_TYPES:
        raise ValueError(C.MSG_UNSUPPORTED_COMMAND + command_type)
    text = json.dumps(payload or {})
    if command_type == "update_config":
        reason = C.update_error(spark, text)
        if reason is not None:
            raise ValueError(reason)
    ensure_ready(spark, root)
    cid = command_id or uuid.uuid4().hex
    ts = I.second_clock(clock)
    # Event order within the same clock second: a nanosecond counter, so two
    # commands queued back to back fold in the order they were queued.
    seq = time.time_ns()
    row = (cid, seq, ts, "queued", command_type, text, requested_by, None, None, None)
    spark.createDataFrame([row], COMMAND_EVENTS).write.mode("append").parquet(f"{root}/command_events")
    return {"ok": True, "command_id": cid, "status": "queued"}


def command_status(spark: SparkSession, root: str, command_id: str) -> DataFrame:
    ensure_ready(spark, root)
    return C.command_status(C.command_state(_log(spark, root, "command_events", COMMAND_EVENTS)), command_id)


def run_status(spark: SparkSession, root: str, limit: int = 5) -> dict[str, DataFrame]:
    """The parts of the status document as bounded DataFrames."""
    R.validate_limit(limit)
    ensure_ready(spark, root)
    ev, res = SCH.read_runs(spark, root)
    runs = L.runs(ev, res)
    cmds = C.command_state(_log(spark, root, "command_events", COMMAND_EVENTS))
    return {
        "last_run": L.latest_run(runs),
        "recent_runs": L.recent_runs(runs, limit),
        "recent_results": L.recent_results(res, run_rows=runs, limit=limit),
        "recent_commands": C.recent_commands(cmds, limit),
        "config": config(spark, root),
    }


def status_document(spark: SparkSession, root: str, limit: int = 5) -> DataFrame:
    """T7 as one row, every log scanned once (see ``operators.status``)."""
    ensure_ready(spark, root)
    ev, res = SCH.read_runs(spark, root)
    cfg = _log(spark, root, "config_events", CONFIG_EVENTS)
    return ST.status_document(ev, res, _log(spark, root, "command_events", COMMAND_EVENTS), cfg, limit)


def compact(spark: SparkSession, root: str) -> int:
    """Rewrites the store's small files and deletes what is unread then (``operators.compaction``); returns the
    manifest's generation. For the store's one writer, between batches."""
    ensure_ready(spark, root)
    generation = K.compact(spark, root).generation
    K.vacuum(spark, root)
    return generation


def ingest_jsonl(spark: SparkSession, root: str, path: str, batch_id: int | None = None, **kw) -> DataFrame:
    """CLI ``ingest``: one JSON-lines input as one atomic batch (strict by default)."""
    return I.ingest_jsonl(spark, root, path, batch_id, **kw)


def collect_fixture(spark: SparkSession, path: str, **kw) -> DataFrame:
    """CLI ``collect --fixture``: whole-file responses → normalised records (rejects raise)."""
    resp = read_whole_files(spark, path)
    norm = N.normalize(resp, **kw)
    bad = norm.where(F.col("status") == "rejected").agg(F.min_by("error", "file_path").alias("error")).first()["error"]
    if bad is not None:
        raise SCH.UpstreamSchemaOrTemporaryError(bad)
    return N.records(norm, ["file_path"], **kw)


def write_jsonl(records: DataFrame, path: str, order: str = "pos") -> str:
    """Records as compact JSON lines, nulls kept, in ``order``."""
    return write_lines(records.select(order, N.jsonl_value().alias("line")), path, order)


def is_expected_failure(spark: SparkSession, root: str, error: BaseException, trigger: str) -> bool:
    """Q10: collector errors are expected; a validation/ingest error only when a failed
    run with that trigger and error type is already recorded (F8)."""
    if isinstance(error, SCH.CollectorError):
        return True
    if isinstance(error, (I.RecordValidationError, ValueError)):
        from recordlake.session import path_exists

        if not path_exists(spark, f"{root}/run_events"):
            return False
        ev, res = SCH.read_runs(spark, root)
        return not L.failed_run_probe(L.runs(ev, res), trigger, type(error).__name__).isEmpty()
    return False


def worker_tick(spark: SparkSession, root: str, landing: str, *, run_id: str | None = None,
                clock: dt.datetime | None = None, trigger: str = "worker_interval") -> dict:
    """T5/T6/R1 one step: drain the pending commands in FIFO order, then, unless paused, one interval run.

    A ``run_once`` collects with the config valid at its place in the queue:
    commands before it are applied first, later ones after it. Every command has a
    ``running`` event before its outcome, so one whose worker dies stays
    running and is drained again by the next tick. A run that fails marks its
    command failed (with the redacted error) and the drain goes on. Recurrence is the
    caller's trigger (e.g. a Structured Streaming ``processingTime`` trigger
    or a job scheduler)."""
    ensure_ready(spark, root)
    rid = run_id or uuid.uuid4().hex
    ran: list[str] = []

    def collect(cfg: dict, why: str) -> BaseException | None:
        ran.append(rid if not ran else f"{rid}-{len(ran)}")
        try:
            SCH.run_collection(spark, root, landing, cfg.get("queries") or None, run_id=ran[-1], trigger=why, clock=clock,
                               max_pages=cfg.get("max_pages"), page_size=cfg.get("page_size"))
        except Exception as exc:  # noqa: BLE001
            return exc
        return None

    drained = runs = 0
    while True:
        path = f"{root}/_staging/plan-{uuid.uuid4().hex}"
        commands = _commands(spark, root)
        after = C.last_seq(commands)
        try:  # written down: events computed from the plan go to the log that it is made of
            C.drain_plan(commands, config(spark, root)).coalesce(1).write.parquet(path)
            plan = spark.read.parquet(path)
            head = plan.where(F.col("outcome") == "run").orderBy("position").limit(1).collect()
            before = plan if not head else plan.where(F.col("position") < head[0]["position"])
            drained += _append_events(spark, root, C.drain_events(before, I.second_clock(clock), after)) // 2
        finally:
            delete_path(spark, path)
        if not head:
            break
        one = head[0]["command_id"]
        _append_events(spark, root, C.started_event(C.command_status(_commands(spark, root), one), I.second_clock(clock)))
        error = collect(json.loads(head[0]["config_json"]), "mcp_run_once")
        _append_events(spark, root, C.finished_event(
            C.command_status(_commands(spark, root), one), I.second_clock(clock), {"run_id": ran[-1]},
            type(error).__name__ if error else None, SCH.redacted(spark, str(error)) if error else None))
        drained, runs = drained + 1, runs + 1
    cfg = {r.key: json.loads(r.value_json) for r in config(spark, root).collect()}
    if not cfg.get("paused"):
        error = collect(cfg, trigger)
        if error and not is_expected_failure(spark, root, error, trigger):
            raise error
    return {"ok": True, "ran": bool(ran), "run_id": ran[0] if ran else None, "runs": ran, "config": cfg, "drained": drained,
            "run_once": runs}


def _commands(spark: SparkSession, root: str) -> DataFrame:
    return C.command_state(_log(spark, root, "command_events", COMMAND_EVENTS))


def _append_events(spark: SparkSession, root: str, events: DataFrame) -> int:
    """Appends events computed from the log that they go to: staged first, then moved."""
    path = f"{root}/_staging/events-{uuid.uuid4().hex}"
    events.select(*COMMAND_EVENTS.fieldNames()).write.parquet(path)
    staged = spark.read.schema(COMMAND_EVENTS).parquet(path)
    n = staged.count()
    if n:
        staged.coalesce(1).write.mode("append").parquet(f"{root}/command_events")
    delete_path(spark, path)
    return n


def update_config(spark: SparkSession, root: str, updates: dict, **kw) -> dict:
    """``config_update``: validated, then queued as an ``update_config`` command."""
    return enqueue(spark, root, "update_config", {"updates": updates}, **kw)


def pause(spark: SparkSession, root: str, **kw) -> dict:
    return enqueue(spark, root, "pause", **kw)


def resume(spark: SparkSession, root: str, **kw) -> dict:
    return enqueue(spark, root, "resume", **kw)


def run_once(spark: SparkSession, root: str, **kw) -> dict:
    return enqueue(spark, root, "run_once", **kw)


def normalize_responses(responses: DataFrame, body: str = "body", **kw) -> tuple[DataFrame, DataFrame]:
    """CLI ``collect``: (records, rejected responses) of a DataFrame of response bodies."""
    norm = N.normalize(responses, body, **kw)
    keys = [c for c in responses.columns if c != body]
    return N.records(norm, keys, **kw), N.rejects(norm, keys)


def run_collection(spark: SparkSession, root: str, landing: str, queries: list[str] | None, *,
                   trigger: str = "scheduled", run_id: str | None = None, **kw) -> DataFrame:
    """CLI ``collect-scheduled``: one run over landed pages (see ``plans.scheduled``)."""
    return SCH.run_collection(spark, root, landing, queries, run_id=run_id or uuid.uuid4().hex,
                              trigger=trigger, **kw)


def parse_queries(spark: SparkSession, text: str) -> list[str]:
    """X14 (command-line form): the library's comma list, of which nothing left is an error.
    The config form (``plans.collection``) instead falls back to one unfiltered query (X15)."""
    found = spark.range(1).select(comma_list(F.lit(text)).alias("q")).first()["q"]
    if not found:
        raise ValueError(MSG_NO_QUERIES)
    return found
