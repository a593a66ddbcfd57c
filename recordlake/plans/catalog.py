"""The registered query catalogue: ``name -> (spark, sf_dir) -> DataFrame``.

Each entry builds its stand-in input from the test tables (see
:mod:`recordlake.sources.adapters`) and runs the library operator on it.
List-valued columns are rendered as comma-joined text so results compare
by value across engines.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlake.functions.canonical import canonical_json
from recordlake.functions.redact import redact
from recordlake.functions.text import integer_setting, truthy_setting
from recordlake import api
from recordlake.operators import analytics, compaction, ingest, reads
from recordlake.operators import control as C
from recordlake.operators import ledger as L
from recordlake.operators import normalize as N
from recordlake.operators import quality as Q
from recordlake.operators import validate as V
from recordlake.operators.status import status_document
from recordlake.sources import adapters
from recordlake.plans import scheduled as SCH
from recordlake.plans.collection import collection_plan, landed_pages, missing_pages, planned_pages
from recordlake.schemas import COMMAND_EVENTS
from recordlake.session import delete_path, list_files, move_new, scratch_dir
from recordlake.sources import store as S
from recordlake.sources.jsonl import place_lines, read_lines, read_whole_files, scan_lines
from recordlake.sources.snapshots import read_log
from recordlake.streaming import ingest_stream as R

QueryFn = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, QueryFn] = {}


def register(name: str) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        CATALOG[name] = fn
        return fn
    return deco


def flat(df: DataFrame, sep: str = ",") -> DataFrame:
    """Render array<string> columns as ``sep``-joined text."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(F.col(f.name), sep).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ------------------------------------------------------------ reads/analytics


@register("summary")
def q_summary(spark: SparkSession, sf: str) -> DataFrame:
    jobs, skills = adapters.jobs_store(spark, sf)
    return analytics.summary(spark, jobs, skills)


@register("skill_frequency")
def q_skill_frequency(spark: SparkSession, sf: str) -> DataFrame:
    _, skills = adapters.jobs_store(spark, sf)
    return analytics.skill_frequency(skills)


@register("budget_distribution")
def q_budget_distribution(spark: SparkSession, sf: str) -> DataFrame:
    jobs, _ = adapters.jobs_store(spark, sf)
    return analytics.budgets(jobs)


@register("jobs_list")
def q_jobs_list(spark: SparkSession, sf: str) -> DataFrame:
    jobs, skills = adapters.jobs_store(spark, sf)
    return analytics.run_query(spark, "jobs", jobs, skills)


@register("jobs_list_filtered")
def q_jobs_list_filtered(spark: SparkSession, sf: str) -> DataFrame:
    jobs, skills = adapters.jobs_store(spark, sf)
    return analytics.run_query(spark, "jobs", jobs, skills, skill=" Widget ", title="HIGH", limit=50)


@register("recent")
def q_recent(spark: SparkSession, sf: str) -> DataFrame:
    jobs, skills = adapters.jobs_store(spark, sf)
    return flat(reads.recent(jobs, skills, limit=20))


@register("search_title")
def q_search_title(spark: SparkSession, sf: str) -> DataFrame:
    jobs, skills = adapters.jobs_store(spark, sf)
    return flat(reads.search(jobs, skills, title="Urgent", limit=20))


@register("search_skill")
def q_search_skill(spark: SparkSession, sf: str) -> DataFrame:
    jobs, skills = adapters.jobs_store(spark, sf)
    return flat(reads.search(jobs, skills, skill="  RING ", limit=20))


@register("search_both")
def q_search_both(spark: SparkSession, sf: str) -> DataFrame:
    jobs, skills = adapters.jobs_store(spark, sf)
    return flat(reads.search(jobs, skills, title="low", skill="blue", limit=20))


@register("search_wildcard")
def q_search_wildcard(spark: SparkSession, sf: str) -> DataFrame:
    jobs, skills = adapters.jobs_store(spark, sf)
    return flat(reads.search(jobs, skills, title="1_urg%t", limit=20))


@register("get_one")
def q_get_one(spark: SparkSession, sf: str) -> DataFrame:
    jobs, skills = adapters.jobs_store(spark, sf)
    return flat(reads.get(jobs, skills, "7"))


@register("get_missing")
def q_get_missing(spark: SparkSession, sf: str) -> DataFrame:
    jobs, skills = adapters.jobs_store(spark, sf)
    return flat(reads.get(jobs, skills, "no-such-job"))


@register("skills_for_page")
def q_skills_for_page(spark: SparkSession, sf: str) -> DataFrame:
    jobs, skills = adapters.jobs_store(spark, sf)
    page = reads.top_recent(jobs, 100)
    return flat(reads.skills_for_page(skills, page).select("job_id", "skills"))


# ------------------------------------------------------ JSON lines & ingest


BATCH_CLOCK = _dt.datetime(2024, 1, 1, tzinfo=_dt.UTC)


def _landed(spark: SparkSession, sf: str, half: bool | None = None, root: str | None = None) -> str:
    docs = adapters.table(spark, sf, "documents")
    if half is not None:
        docs = adapters.source_half(docs, half)
    root = root or scratch_dir(spark, "raw")
    return adapters.write_raw_records(spark, docs, f"{root}/raw-{'all' if half is None else int(half)}")


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    return V.validate(read_lines(spark, _landed(spark, sf)))


@register("jsonl_parse_status")
def q_jsonl_parse_status(spark: SparkSession, sf: str) -> DataFrame:
    return V.parse_status(read_lines(spark, _landed(spark, sf)))


@register("validate_reasons")
def q_validate_reasons(spark: SparkSession, sf: str) -> DataFrame:
    placed = place_lines(scan_lines(spark, _landed(spark, sf)))
    c = ingest.stage_lines(spark, V.validate(placed), scratch_dir(spark, "checked"), ["status", "reason"])
    return c.where(F.col("message").isNotNull()).select("line_no", "status", "message")


@register("strict_first_error")
def q_strict_first_error(spark: SparkSession, sf: str) -> DataFrame:
    """Q1/Q2: what a strict ingest of the whole input reports before writing anything."""
    return V.first_failure(_checked(spark, sf))


@register("validate_accepted")
def q_validate_accepted(spark: SparkSession, sf: str) -> DataFrame:
    c = _checked(spark, sf).where(F.col("status") == "valid")
    return flat(c.select("line_no", "job_id", "source", "title", "description", "url", "skills",
                         "hourly_min", "fixed_amount", "raw_id"))


@register("private_field_rejects")
def q_private_field_rejects(spark: SparkSession, sf: str) -> DataFrame:
    c = _checked(spark, sf)
    return c.where(F.col("reason").startswith("collector payload contains disallowed private field")) \
            .select("line_no", "reason")


@register("unknown_field_rejects")
def q_unknown_field_rejects(spark: SparkSession, sf: str) -> DataFrame:
    c = _checked(spark, sf)
    return c.where(F.col("reason").startswith("collector payload contains unsupported fields")) \
            .select("line_no", "reason")


@register("skill_canonical")
def q_skill_canonical(spark: SparkSession, sf: str) -> DataFrame:
    c = _checked(spark, sf).where(F.col("status") == "valid")
    return c.select("line_no", F.posexplode("skills").alias("pos", "skill")) \
            .select("line_no", (F.col("pos") + 1).alias("pos"), "skill")


@register("content_hash")
def q_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    """The typed form's hash: one per logical record."""
    c = _checked(spark, sf).where(F.col("status") == "valid")
    return c.select("line_no", F.col("typed_hash").alias("content_hash"))


@register("raw_content_hash")
def q_raw_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of the payload's own canonical text, as stored."""
    c = _checked(spark, sf).where(F.col("status") == "valid")
    return c.select("line_no", "content_hash")


@register("canonical_nested")
def q_canonical_nested(spark: SparkSession, sf: str) -> DataFrame:
    """V10 on nested payloads: unsorted keys at each depth, non-ASCII, whole and fractional numbers, literals."""
    docs = adapters.table(spark, sf, "documents")
    n = F.col("n_chars")
    text = F.concat(F.lit('{ "z": {"b":'), n, F.lit(', "a" : [true, null, '), F.to_json(F.struct(F.substring("text", 1, 60).alias("t"))),
                    F.lit(']}, "é": ['), (n / 4).cast("string"), F.lit(", "), n, F.lit('.50, [], {}], "doc":'), F.col("doc_id"),
                    F.lit(', "A": "ß\\u000b"}'))
    return docs.select("doc_id", F.sha2(canonical_json(F.parse_json(text)), 256).alias("canonical_sha256"))


@register("skill_casefold")
def q_skill_casefold(spark: SparkSession, sf: str) -> DataFrame:
    """Skills with letters that ``lower`` and full case folding treat differently, one per document."""
    docs = adapters.table(spark, sf, "documents")
    letter = F.element_at(F.array(*map(F.lit, ("ß", "ẞ", "ſ", "ς", "İ", "ﬃ", "Ǆ", "Σ", "a"))), (F.col("doc_id") % 9 + 1).cast("int"))
    payload = F.struct(F.lit("feed").alias("source"), F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"),
                       F.lit("d").alias("description"), F.lit("u").alias("url"),
                       F.array(F.concat(F.lit(" X"), letter, F.lit("  "), F.upper("source"), F.lit(" "))).alias("skills"))
    lines = docs.select(F.col("doc_id").alias("line_no"), F.to_json(payload).alias("line"))
    return V.validate(lines, exact_casefold=True).select("line_no", F.col("skills")[0].alias("skill"))


def _single_batch_store(spark: SparkSession, sf: str) -> str:
    root = scratch_dir(spark, "store")
    ingest.ingest_jsonl(spark, root, _landed(spark, sf, root=root), 1, clock=BATCH_CLOCK, mode="quarantine")
    return root


def _two_batch_store(spark: SparkSession, sf: str, replay: bool = False) -> str:
    root = scratch_dir(spark, "store")
    first, second = _landed(spark, sf, True, root), _landed(spark, sf, False, root)
    ingest.ingest_jsonl(spark, root, first, 1, clock=BATCH_CLOCK, mode="quarantine")
    ingest.ingest_jsonl(spark, root, second, 2, clock=BATCH_CLOCK, mode="quarantine")
    if replay:
        ingest.ingest_jsonl(spark, root, first, 1, clock=BATCH_CLOCK, mode="quarantine")
    return root


LEDGER_COLS = ("batch_id", "seen", "inserted", "skipped", "rejected")


@register("ingest_counters")
def q_ingest_counters(spark: SparkSession, sf: str) -> DataFrame:
    root = _single_batch_store(spark, sf)
    return ingest.ledger(spark, root).select(*LEDGER_COLS)


@register("ingest_skill_frequency")
def q_ingest_skill_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: raw JSON lines → validate → first-write-wins append → skill frequency of the store."""
    root = _single_batch_store(spark, sf)
    return analytics.skill_frequency(ingest.read_job_skills(spark, root))


@register("new_jobs")
def q_new_jobs(spark: SparkSession, sf: str) -> DataFrame:
    root = _single_batch_store(spark, sf)
    return flat(ingest.new_jobs(spark, root, 1))


@register("new_job_skills")
def q_new_job_skills(spark: SparkSession, sf: str) -> DataFrame:
    root = _single_batch_store(spark, sf)
    return ingest.read_job_skills(spark, root).select("job_id", "skill")


@register("insert_if_new")
def q_insert_if_new(spark: SparkSession, sf: str) -> DataFrame:
    root = _two_batch_store(spark, sf)
    jobs = ingest.read_jobs(spark, root).where(F.col("batch_id") == 2)
    return flat(jobs.select("job_id", "ord", "title", "url", "skills", "hourly_min", "fixed_amount", "raw_id"))


@register("two_batch_first_wins")
def q_two_batch_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    root = _two_batch_store(spark, sf)
    return ingest.read_jobs(spark, root).select("job_id", "batch_id", "ord", "raw_id")


@register("replay_idempotent")
def q_replay_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    root = _two_batch_store(spark, sf, replay=True)
    jobs = ingest.read_jobs(spark, root).groupBy("batch_id").agg(F.count(F.lit(1)).alias("stored"))
    return ingest.ledger(spark, root).select(*LEDGER_COLS).join(jobs, "batch_id", "left")


# ------------------------------------------------- envelopes & normaliser


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    conv = adapters.table(spark, sf, "conversations")
    path = adapters.write_responses(spark, conv, f"{scratch_dir(spark, 'landing')}/responses")
    return read_lines(spark, path).select("line_no", F.col("line").alias("body"))


def _normalized(spark: SparkSession, sf: str) -> DataFrame:
    return N.normalize(_responses(spark, sf))


@register("envelope_audit")
def q_envelope_audit(spark: SparkSession, sf: str) -> DataFrame:
    return N.audit(_responses(spark, sf)).select("line_no", "audit_class")


@register("envelope_extract")
def q_envelope_extract(spark: SparkSession, sf: str) -> DataFrame:
    a = N.audit(_responses(spark, sf)).where(F.col("audit_class") == "ok")
    items = a.select("line_no", F.posexplode("_results").alias("pos", "_r"))
    return items.select("line_no", "pos", N.first_text(F.col("_r"), "$.id", "$.uid").alias("top_id"))


@register("normalize_records")
def q_normalize_records(spark: SparkSession, sf: str) -> DataFrame:
    r = N.records(_normalized(spark, sf), ["line_no"])
    return r.select("line_no", "pos", F.col("id").alias("job_id"), "source", "title", "description", "url",
                    "posted_at", "job_type", "contractor_tier", "raw_id")


@register("normalize_rejects")
def q_normalize_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return N.rejects(_normalized(spark, sf), ["line_no"])


@register("normalize_skills")
def q_normalize_skills(spark: SparkSession, sf: str) -> DataFrame:
    r = N.records(_normalized(spark, sf), ["line_no"])
    return flat(r.select("line_no", "pos", "skills"))


@register("normalize_budgets")
def q_normalize_budgets(spark: SparkSession, sf: str) -> DataFrame:
    r = N.records(_normalized(spark, sf), ["line_no"])
    return r.select("line_no", "pos", "hourly_min", "hourly_max", "fixed_amount")


@register("jsonl_roundtrip")
def q_jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised records → JSON lines (S9) → read back (S1) → validated records."""
    r = N.records(_normalized(spark, sf), ["line_no"]).withColumn("ord", F.struct("line_no", "pos"))
    out = f"{scratch_dir(spark, 'jsonl')}/records"
    from recordlake.sources.jsonl import write_lines
    write_lines(r.select("ord", N.jsonl_value().alias("line")), out, "ord")
    checked = V.validate(read_lines(spark, out)).where(F.col("status") == "valid")
    return flat(checked.select("job_id", "title", "url", "skills", "posted_at", "job_type", "contractor_tier",
                               "hourly_min", "hourly_max", "fixed_amount", "raw_id"))


# -------------------------------------------------- audit, ledger, control


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.table(spark, sf, "events")


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return Q.response_classes(adapters.http_log(_events(spark, sf)))


@register("response_class")
def q_response_class(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("event_id", "status", "response_class", "error_type", "exit_code")


@register("retry_verdict")
def q_retry_verdict(spark: SparkSession, sf: str) -> DataFrame:
    v = Q.retry_verdict(_classified(spark, sf))
    return v.select("event_id", "response_class", "attempt_no", "retry_cap", "retry", "exhausted",
                    "backoff_min_s", "backoff_max_s")


@register("attempt_rollup")
def q_attempt_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return Q.attempt_rollup(_classified(spark, sf), ["run_id", "query"])


@register("redacted_text")
def q_redacted_text(spark: SparkSession, sf: str) -> DataFrame:
    return Q.redacted_documents(adapters.table(spark, sf, "documents"))


@register("collection_plan")
def q_collection_plan(spark: SparkSession, sf: str) -> DataFrame:
    """One configured query list per customer (market segment and name; every
    fifth list is blank, i.e. the unfiltered default) × five pages."""
    customer = adapters.table(spark, sf, "customer")
    text = F.when(F.col("c_custkey") % 5 == 0, F.lit(" , , ")).otherwise(
        F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" , ,"), F.col("c_name"), F.lit(" ")))
    lists = customer.select("c_custkey", text.alias("queries"))
    return collection_plan(lists, "c_custkey", "queries", max_pages=5, page_size=50)


def _run_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ev = _events(spark, sf)
    results = adapters.run_results(ev)
    return L.runs(adapters.run_events(ev), results), results


@register("run_totals")
def q_run_totals(spark: SparkSession, sf: str) -> DataFrame:
    return L.run_totals(adapters.run_results(_events(spark, sf)))


@register("run_current_state")
def q_run_current_state(spark: SparkSession, sf: str) -> DataFrame:
    return _run_rows(spark, sf)[0]


@register("latest_run")
def q_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    return L.latest_run(_run_rows(spark, sf)[0])


@register("recent_runs")
def q_recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    return L.recent_runs(_run_rows(spark, sf)[0], 5)


@register("recent_results")
def q_recent_results(spark: SparkSession, sf: str) -> DataFrame:
    runs, results = _run_rows(spark, sf)
    return L.recent_results(results, run_rows=runs, limit=5)


@register("failed_run_probe")
def q_failed_run_probe(spark: SparkSession, sf: str) -> DataFrame:
    return L.failed_run_probe(_run_rows(spark, sf)[0], "worker_interval", "UpstreamSchemaOrTemporaryError")


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    return C.command_state(adapters.command_events(_events(spark, sf)))


CMD_COLS = ("command_id", "command_type", "payload_json", "status", "created_at", "started_at", "finished_at",
            "requested_by", "result_json", "error_type", "redacted_error")


@register("command_state")
def q_command_state(spark: SparkSession, sf: str) -> DataFrame:
    return _commands(spark, sf).select(*CMD_COLS)


@register("command_vocabulary")
def q_command_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return C.command_checks(adapters.command_events(_events(spark, sf)))


@register("command_status_one")
def q_command_status_one(spark: SparkSession, sf: str) -> DataFrame:
    return C.command_status(_commands(spark, sf), "cmd-000007").select(*CMD_COLS)


@register("command_fifo")
def q_command_fifo(spark: SparkSession, sf: str) -> DataFrame:
    return C.fifo_head(_commands(spark, sf)).select("command_id", "created_at")


@register("recent_commands")
def q_recent_commands(spark: SparkSession, sf: str) -> DataFrame:
    return C.recent_commands(_commands(spark, sf), 5).select(*CMD_COLS)


@register("config_validation")
def q_config_validation(spark: SparkSession, sf: str) -> DataFrame:
    ev = adapters.config_events(_events(spark, sf))
    return C.validate_config_events(ev).select("seq", "key", "error")


@register("config_current")
def q_config_current(spark: SparkSession, sf: str) -> DataFrame:
    return C.config_state(adapters.config_events(_events(spark, sf)))


@register("config_seeded")
def q_config_seeded(spark: SparkSession, sf: str) -> DataFrame:
    ev = adapters.config_events(_events(spark, sf))
    return C.seeded(C.config_state(ev), ev.select("scope").distinct())


@register("config_after_commands")
def q_config_after_commands(spark: SparkSession, sf: str) -> DataFrame:
    return C.config_after_commands(spark, None, adapters.command_events(_events(spark, sf)))


@register("status_document")
def q_status_document(spark: SparkSession, sf: str) -> DataFrame:
    """One row, every log scanned once."""
    ev = _events(spark, sf)
    doc = status_document(adapters.run_events(ev), adapters.run_results(ev), adapters.command_events(ev))
    text = ("recent_runs", "recent_results", "recent_commands", "config")
    return doc.select("status", "last_run_id", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in text])


@register("readiness_verdict")
def q_readiness_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of five stores built from the test tables; four of them ingest the same landed lines."""
    base = scratch_dir(spark, "ready")
    ev, raw = _events(spark, sf), _landed(spark, sf, root=base)
    partial, full, newer = f"{base}/partial", f"{base}/full", f"{base}/newer"
    for root in (partial, full, newer):
        ingest.ingest_jsonl(spark, root, raw, 1, clock=BATCH_CLOCK, mode="quarantine")
        S.init_store(spark, root, 2 if root == newer else 1, tables=False)
    for root in (full, newer):
        S.write_table(adapters.run_events(ev), root, "run_events")
        S.write_table(adapters.run_results(ev), root, "run_results")
        S.write_table(adapters.config_events(ev), root, "config_events")
        S.write_table(adapters.command_events(ev), root, "command_events")
    unseeded = f"{base}/unseeded"
    S.init_store(spark, unseeded)
    ingest.ingest_jsonl(spark, unseeded, raw, mode="quarantine")
    return S.readiness_table(spark, {"unseeded": unseeded, "missing": f"{base}/missing", "partial": partial, "full": full,
                                     "newer": newer})


# ----------------------------------------------------------------- streaming


def _stream_store(spark: SparkSession, sf: str) -> str:
    """Two one-shot stream runs over one landing folder: sources src0–9 land
    first, src10–19 later; a third run finds nothing new."""
    root = scratch_dir(spark, "stream")
    landing, ckpt = f"{root}/landing", f"{root}/_checkpoints/ingest"
    docs = adapters.table(spark, sf, "documents")
    for first in (True, False):
        adapters.write_raw_records(spark, adapters.source_half(docs, first), landing, mode="append")
        R.run_ingest_once(spark, landing, f"{root}/store", ckpt, clock=BATCH_CLOCK)
    R.run_ingest_once(spark, landing, f"{root}/store", ckpt, clock=BATCH_CLOCK)
    return f"{root}/store"


@register("stream_insert_if_new")
def q_stream_insert_if_new(spark: SparkSession, sf: str) -> DataFrame:
    store = _stream_store(spark, sf)
    return ingest.read_jobs(spark, store).select("job_id", "batch_id", "ord", "raw_id")


@register("stream_ledger")
def q_stream_ledger(spark: SparkSession, sf: str) -> DataFrame:
    store = _stream_store(spark, sf)
    return ingest.ledger(spark, store).select(*LEDGER_COLS)


@register("stream_watermark_dedupe")
def q_stream_watermark_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The first half is delivered again with the second; none of its lines is seen, parsed or skipped again."""
    root = scratch_dir(spark, "dedupe")
    landing, store = f"{root}/landing", f"{root}/store"
    docs = adapters.table(spark, sf, "documents")
    for halves in ([True], [True, False]):
        for first in halves:
            adapters.write_raw_records(spark, adapters.source_half(docs, first), landing, mode="append")
        R.run_ingest_once(spark, landing, store, f"{root}/_checkpoints/ingest", clock=BATCH_CLOCK, dedupe_within="1 day")
    return ingest.ledger(spark, store).select(*LEDGER_COLS)


@register("stream_command_state")
def q_stream_command_state(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_dir(spark, "cmdstream")
    landing = f"{root}/landing"
    adapters.command_events(_events(spark, sf)).write.mode("overwrite").json(landing)
    q = R.start_command_stream(spark, landing, f"{root}/store", f"{root}/_checkpoints/commands")
    q.awaitTermination()
    return C.command_state(R.read_command_log(spark, f"{root}/store")).select(*CMD_COLS)


# ---------------------------------------------------------- scheduled run


def _scheduled_store(spark: SparkSession, sf: str) -> str:
    root = scratch_dir(spark, "sched")
    queries = adapters.land_query_pages(spark, adapters.table(spark, sf, "conversations"), f"{root}/landing")
    SCH.run_collection(spark, f"{root}/store", f"{root}/landing", queries, run_id="run-0001",
                       clock=BATCH_CLOCK, raise_on_failure=False)
    return f"{root}/store"


@register("scheduled_run_results")
def q_scheduled_run_results(spark: SparkSession, sf: str) -> DataFrame:
    ev, res = SCH.read_runs(spark, _scheduled_store(spark, sf))
    return L.result_rows(res).select("id", "query", "status", "seen_count", "inserted_count", "skipped_count",
                                     "error_type", "redacted_error")


@register("scheduled_run_state")
def q_scheduled_run_state(spark: SparkSession, sf: str) -> DataFrame:
    ev, res = SCH.read_runs(spark, _scheduled_store(spark, sf))
    return L.runs(ev, res)


# ------------------------------------------------ whole-file responses, S8


@register("fixture_audit")
def q_fixture_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every envelope landed as its own JSON file, read whole and audited."""
    root = scratch_dir(spark, "fixtures")
    rows = adapters.response_rows(adapters.table(spark, sf, "conversations"))
    # Pretty-printed where the response is JSON at all, so most files span lines.
    pretty = F.coalesce(F.to_json(F.try_parse_json("line"), {"pretty": "true"}), F.col("line"))
    rows.select("ord.conv_id", pretty.alias("value")) \
        .write.partitionBy("conv_id").text(f"{root}/files")
    norm = N.normalize(read_whole_files(spark, f"{root}/files"))
    return norm.select(F.regexp_extract("file_path", r"conv_id=(\d+)", 1).cast("long").alias("conv_id"),
                       "audit_class", "error")


@register("recent_envelope")
def q_recent_envelope(spark: SparkSession, sf: str) -> DataFrame:
    jobs, skills = adapters.jobs_store(spark, sf)
    env = reads.envelope(reads.recent(jobs, skills, limit=20))
    line = F.transform("rows", lambda r: F.concat_ws("|", r["job_id"], r["title"], r["url"], F.array_join(r["skills"], ","),
                                                     r["first_seen_at"]))
    return env.select("ok", "status", F.size("rows").alias("n_rows"), F.array_join(line, ";").alias("content"))


@register("get_missing_envelope")
def q_get_missing_envelope(spark: SparkSession, sf: str) -> DataFrame:
    jobs, skills = adapters.jobs_store(spark, sf)
    env = reads.get_envelope(reads.get(jobs, skills, "no-such-job"), "no-such-job")
    return env.select("ok", "error", "job_id")


# ------------------------------------------------- reads on an ingested store


def _store_page(df: DataFrame) -> DataFrame:
    return flat(df.select("job_id", "title", "url", "skills", "hourly_min", "fixed_amount", "raw_id",
                          "first_seen_at"))


@register("store_recent")
def q_store_recent(spark: SparkSession, sf: str) -> DataFrame:
    """O1/J2 on a real Parquet store: key-column top-k, then key-pruned row and skill fetch."""
    root = _single_batch_store(spark, sf)
    return _store_page(reads.recent(ingest.read_jobs(spark, root), ingest.read_job_skills(spark, root), 20))


@register("store_search")
def q_store_search(spark: SparkSession, sf: str) -> DataFrame:
    """O2/F1–F3/J1 on a real Parquet store."""
    root = _single_batch_store(spark, sf)
    return _store_page(reads.search(ingest.read_jobs(spark, root), ingest.read_job_skills(spark, root),
                                    title="the", skill=" EN ", limit=20))


@register("store_get")
def q_store_get(spark: SparkSession, sf: str) -> DataFrame:
    """F4 on a real Parquet store: the key filter reaches the scan and its bloom filter."""
    root = _single_batch_store(spark, sf)
    jobs, skills = ingest.read_jobs(spark, root), ingest.read_job_skills(spark, root)
    first = jobs.agg(F.min("job_id").alias("k")).first()["k"]
    return _store_page(reads.get(jobs, skills, first))


def _store_analytics(spark: SparkSession, sf: str, name: str) -> DataFrame:
    root = _single_batch_store(spark, sf)
    return analytics.run_query(spark, name, ingest.read_jobs(spark, root), ingest.read_job_skills(spark, root))


@register("store_summary")
def q_store_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A1 on a real Parquet store."""
    return _store_analytics(spark, sf, "summary")


@register("store_skills")
def q_store_skills(spark: SparkSession, sf: str) -> DataFrame:
    """A2 on a real Parquet store."""
    return _store_analytics(spark, sf, "skills")


@register("store_budgets")
def q_store_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """A3 on a real Parquet store."""
    return _store_analytics(spark, sf, "budgets")


@register("redaction_cases")
def q_redaction_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Q9: quoted keys, whole header values and further key endings, with a secret per document."""
    docs = adapters.table(spark, sf, "documents")
    secret = F.concat(F.lit("S"), F.col("doc_id").cast("string"))
    texts = [F.concat(F.lit('{"token": "'), secret, F.lit('"} end')),
             F.concat(F.lit("Cookie: a="), secret, F.lit("; b="), secret, F.lit("\nend")),
             F.concat(F.lit("Authorization: Basic "), secret, F.lit("\nend")),
             F.concat(F.lit("secret_key="), secret, F.lit(" end")),
             F.concat(F.lit("tokens="), secret, F.lit("; end"))]
    rows = docs.select("doc_id", secret.alias("secret"), F.posexplode(F.array(*texts)).alias("kind", "t"))
    return rows.select("doc_id", "kind", redact("t").alias("redacted"), redact("t").contains(F.col("secret")).alias("leaks"))


@register("crash_then_duplicate")
def q_crash_then_duplicate(spark: SparkSession, sf: str) -> DataFrame:
    """K2: the second batch's data is written and its ledger row is not; the next batch takes its
    number with duplicates only. The dead attempt stays unread."""
    root = scratch_dir(spark, "store")
    first, second = _landed(spark, sf, True, root), _landed(spark, sf, False, root)
    ingest.ingest_jsonl(spark, root, first, clock=BATCH_CLOCK, mode="quarantine")
    checked = V.validate(read_lines(spark, second)).withColumn("ord", F.col("line_no"))
    ingest.write_attempt(spark, root, checked, 2, "crashed", BATCH_CLOCK)
    again = f"{root}/again"  # the first input with a marker line more: another input, the same records
    spark.read.text(first).write.text(again)
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("append").text(again)
    led = ingest.ingest_jsonl(spark, root, again, clock=BATCH_CLOCK, mode="quarantine")
    row = led.first()
    return ingest.read_jobs(spark, root).agg(F.count("*").alias("stored")).select(
        "stored", F.lit(row.inserted).cast("long").alias("inserted_after"), F.lit(row.batch_id).cast("long").alias("batch_id"))


@register("results_of_a_run")
def q_results_of_a_run(spark: SparkSession, sf: str) -> DataFrame:
    """the newest results of one run, named by its id (the smallest)."""
    results = _run_rows(spark, sf)[1]
    run_id = results.agg(F.min("run_id").alias("r")).first()["r"]
    return L.recent_results(results, run_id=run_id, limit=5)


@register("results_of_all_runs")
def q_results_of_all_runs(spark: SparkSession, sf: str) -> DataFrame:
    """the newest results without a run filter."""
    return L.recent_results(_run_rows(spark, sf)[1], limit=100)


@register("settings_parse")
def q_settings_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-number and boolean settings, one text of each per customer."""
    key = F.col("c_custkey")
    number = F.when(key % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), key.cast("string"), F.lit(" ")))
    flag = F.element_at(F.array(*[F.lit(t) for t in ("True", "no", "", "1", "off", "YES")]), (key % 6 + 1).cast("int"))
    return adapters.table(spark, sf, "customer").select(
        "c_custkey", integer_setting(number).alias("pages"), truthy_setting(flag).alias("paused"))


@register("command_log_mixed_writers")
def q_command_log_mixed_writers(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the command events through the stream, half appended as ``enqueue`` does; all are read."""
    root = scratch_dir(spark, "mixed")
    store, landing = f"{root}/store", f"{root}/landing"
    S.init_store(spark, store)
    events = adapters.command_events(_events(spark, sf))
    events.where(F.col("seq") % 2 == 0).write.json(landing)
    S.write_table(events.where(F.col("seq") % 2 == 1), store, "command_events")
    R.start_command_stream(spark, landing, store, f"{root}/_checkpoints/commands").awaitTermination()
    return C.command_state(R.read_command_log(spark, store)).select(*CMD_COLS)


@register("stream_after_batch")
def q_stream_after_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A stream with a fresh checkpoint on a store that a batch has filled: nothing stored is lost."""
    root = scratch_dir(spark, "store")
    first, second = _landed(spark, sf, True, root), _landed(spark, sf, False, root)
    ingest.ingest_jsonl(spark, root, first, clock=BATCH_CLOCK, mode="quarantine")
    R.run_ingest_once(spark, second, root, f"{root}/_checkpoints/fresh", clock=BATCH_CLOCK)
    return ingest.read_jobs(spark, root).select("job_id", "batch_id", "ord", "raw_id")


# ------------------------------------------------------------ command drain


def _drain(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(command events, command state, drain plan) of the event-derived log."""
    events = adapters.command_events(_events(spark, sf))
    state = C.command_state(events)
    return events, state, C.drain_plan(state, C.config_after_commands(spark, None, events))


@register("command_fifo_drain")
def q_command_fifo_drain(spark: SparkSession, sf: str) -> DataFrame:
    """T5: place, outcome and as-of config of every pending command; updates lie before and after runs."""
    return _drain(spark, sf)[2].select("command_id", "position", "command_type", "outcome", "error", "config_json")


@register("command_status_after_drain")
def q_command_status_after_drain(spark: SparkSession, sf: str) -> DataFrame:
    """All commands after the pending config commands' events are in the log."""
    events, state, plan = _drain(spark, sf)
    added = C.drain_events(plan, DRAIN_CLOCK, C.last_seq(state))
    return C.command_state(events.select(*added.columns).unionByName(added)).select(*CMD_COLS)


@register("command_recovery")
def q_command_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Config commands that a dead worker left running, drained again; they keep their first start."""
    events, state, plan = _drain(spark, sf)
    left = plan.where(F.col("was") == "running")
    added = C.drain_events(left, DRAIN_CLOCK, C.last_seq(state))
    after = C.command_state(events.select(*added.columns).unionByName(added))
    return after.join(left.where("outcome <> 'run'").select("command_id", "position"), "command_id").select(
        "command_id", "position", "status", "started_at", "finished_at", "error_type")


DRAIN_CLOCK = _dt.datetime(2030, 1, 1, tzinfo=_dt.UTC)


# ------------------------------------------------- compaction, planned pages


@register("store_after_compaction")
def q_store_after_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """A batch, a compaction, a batch that repeats keys, another compaction, and old files deleted."""
    root = scratch_dir(spark, "store")
    for half in (True, False):
        ingest.ingest_jsonl(spark, root, _landed(spark, sf, half, root), clock=BATCH_CLOCK, mode="quarantine")
        compaction.compact(spark, root)
    compaction.vacuum(spark, root)
    return ingest.read_jobs(spark, root).select("job_id", "batch_id", "ord", "raw_id")


def _page_landing(spark: SparkSession, sf: str, root: str) -> str:
    """``query=q<conv mod 10>/page=<conv div 10 mod 4>/``: clean envelopes of all conversations."""
    rows = adapters.response_rows(adapters.table(spark, sf, "conversations"), faults=False)
    conv = F.col("ord.conv_id")
    rows.select(F.concat(F.lit("q"), (conv % 10).cast("string")).alias("query"), (F.floor(conv / 10) % 4).cast("int").alias("page"),
                F.col("line").alias("value")).write.partitionBy("query", "page").text(f"{root}/landing")
    return f"{root}/landing"


def _page_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Three pages of each landed query and of one that nobody fetched."""
    conv = adapters.table(spark, sf, "conversations").select((F.col("conv_id") % 10).alias("k")).distinct()
    lists = conv.select(F.col("k").cast("long").alias("list"), F.concat(F.lit("q"), F.col("k").cast("string"), F.lit(", never"), F.col("k").cast("string")).alias("queries"))
    return collection_plan(lists, "list", "queries", max_pages=3)


@register("planned_pages")
def q_planned_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The plan against the landed page folders."""
    landing = _page_landing(spark, sf, scratch_dir(spark, "pages"))
    return planned_pages(_page_plan(spark, sf), landed_pages(spark, landing)).select("list", "query", "page", "landed")


@register("missing_pages")
def q_missing_pages(spark: SparkSession, sf: str) -> DataFrame:
    landing = _page_landing(spark, sf, scratch_dir(spark, "pages"))
    return missing_pages(_page_plan(spark, sf), landed_pages(spark, landing)).select("list", "query", "page", "offset")


@register("planned_run_results")
def q_planned_run_results(spark: SparkSession, sf: str) -> DataFrame:
    """A run over page folders that reads the first two pages of its queries only."""
    root = scratch_dir(spark, "sched")
    SCH.run_collection(spark, f"{root}/store", _page_landing(spark, sf, root), ["q1", "q2", "q1"], run_id="run-0001",
                       clock=BATCH_CLOCK, max_pages=2)
    return L.result_rows(SCH.read_runs(spark, f"{root}/store")[1]).select("id", "query", "status", "seen_count", "inserted_count")


@register("command_stream_replay")
def q_command_stream_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The last micro-batch is done again, as after a crash before its commit; raw rows of the log."""
    root = scratch_dir(spark, "cmdstream")
    landing, ckpt, store = f"{root}/landing", f"{root}/_checkpoints/commands", f"{root}/store"
    adapters.command_events(_events(spark, sf)).write.json(landing)
    R.start_command_stream(spark, landing, store, ckpt).awaitTermination()
    for name in ("0", ".0.crc"):
        delete_path(spark, f"{ckpt}/commits/{name}")
    R.start_command_stream(spark, landing, store, ckpt).awaitTermination()
    return read_log(spark, store, "command_events", COMMAND_EVENTS).groupBy("status").agg(F.count("*").alias("events"))


# ------------------------------------------------------------- through the API


def _api_store(spark: SparkSession, sf: str) -> str:
    root = scratch_dir(spark, "store")
    S.init_store(spark, root)
    api.ingest_jsonl(spark, root, _landed(spark, sf, root=root), clock=BATCH_CLOCK, mode="quarantine")
    return root


@register("api_recent")
def q_api_recent(spark: SparkSession, sf: str) -> DataFrame:
    """API1 over an initialised store."""
    return _store_page(api.recent(spark, _api_store(spark, sf), 20))


@register("api_get")
def q_api_get(spark: SparkSession, sf: str) -> DataFrame:
    """API3: the smallest key."""
    root = _api_store(spark, sf)
    return _store_page(api.get(spark, root, ingest.read_jobs(spark, root).agg(F.min("job_id")).first()[0]))


@register("api_summary")
def q_api_summary(spark: SparkSession, sf: str) -> DataFrame:
    """API8."""
    return api.analytics(spark, _api_store(spark, sf), "summary")


@register("api_search_casefold")
def q_api_search_casefold(spark: SparkSession, sf: str) -> DataFrame:
    """API2/X2: skills written with ß, with SS and otherwise; the search writes a capital ẞ."""
    root = scratch_dir(spark, "store")
    S.init_store(spark, root)
    docs = adapters.table(spark, sf, "documents")
    skill = F.element_at(F.array(F.lit("Straße"), F.lit(" STRASSE "), F.lit("Strase")), (F.col("doc_id") % 3 + 1).cast("int"))
    payload = F.struct(F.lit("feed").alias("source"), F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"),
                       F.lit("d").alias("description"), F.lit("u").alias("url"), F.array(skill).alias("skills"))
    docs.select(F.to_json(payload).alias("value")).write.text(f"{root}/_staging/in")
    api.ingest_jsonl(spark, root, f"{root}/_staging/in", clock=BATCH_CLOCK)
    return flat(api.search(spark, root, skill="straẞe", limit=20).select("job_id", "skills"))


@register("api_run_status")
def q_api_run_status(spark: SparkSession, sf: str) -> DataFrame:
    """API4/API12: the status document of a store after a scheduled run of four queries."""
    root = scratch_dir(spark, "sched")
    queries = adapters.land_query_pages(spark, adapters.table(spark, sf, "conversations"), f"{root}/landing")
    S.init_store(spark, f"{root}/store")
    SCH.run_collection(spark, f"{root}/store", f"{root}/landing", queries, run_id="run-0001", clock=BATCH_CLOCK, raise_on_failure=False)
    doc = api.status_document(spark, f"{root}/store")
    asked = ingest.ledger(spark, f"{root}/store").agg(F.array_join(F.sort_array(F.collect_set("source_query")), ",")).first()[0]
    return doc.select("status", "last_run_id", F.array_join(F.col("recent_results").cast("array<string>"), ",").alias("recent_results"),
                      F.array_join("config", ",").alias("config"), F.lit(asked).alias("source_queries"))


@register("api_collect_fixture")
def q_api_collect_fixture(spark: SparkSession, sf: str) -> DataFrame:
    """API10: clean responses, one file each, as records."""
    root = scratch_dir(spark, "fixtures")
    rows = adapters.response_rows(adapters.table(spark, sf, "conversations"), faults=False)
    rows.select("ord.conv_id", F.to_json(F.try_parse_json("line"), {"pretty": "true"}).alias("value")) \
        .write.partitionBy("conv_id").text(f"{root}/files")
    return api.collect_fixture(spark, f"{root}/files").select(F.col("id").alias("job_id"), "title", "url", "hourly_min", "raw_id")


@register("command_enqueue")
def q_command_enqueue(spark: SparkSession, sf: str) -> DataFrame:
    """T4/API5: an update queued for every region, and one refused for its key."""
    root = scratch_dir(spark, "store")
    S.init_store(spark, root)
    for r in adapters.table(spark, sf, "region").orderBy("r_regionkey").collect():
        api.update_config(spark, root, {"queries": [r.r_name], "max_pages": r.r_regionkey + 1}, command_id=f"cmd-{r.r_regionkey}", clock=BATCH_CLOCK)
        try:
            api.update_config(spark, root, {r.r_name: 1}, clock=BATCH_CLOCK)
        except ValueError:
            continue
        raise RuntimeError("an unknown key was queued")
    return api._commands(spark, root).select("command_id", "command_type", "payload_json", "status", "created_at", "requested_by")


@register("expected_failure")
def q_expected_failure(spark: SparkSession, sf: str) -> DataFrame:
    """Q10: by trigger and error, whether a run's failure is an expected one; the run log's failures are ValueErrors."""
    root = scratch_dir(spark, "store")
    failed = F.when(F.col("status") == "failed", "ValueError")
    ev = _events(spark, sf)
    S.write_table(adapters.run_events(ev).withColumn("error_type", failed), root, "run_events")
    S.write_table(adapters.run_results(ev), root, "run_results")
    errors = {"CollectorError": SCH.CollectorError("x"), "RecordValidationError": ingest.RecordValidationError("x"),
              "ValueError": ValueError("x"), "TypeError": TypeError("x")}
    rows = [(trigger, name, bool(api.is_expected_failure(spark, root, error, trigger)))
            for trigger in ("scheduled", "worker_interval", "mcp_run_once", "other") for name, error in errors.items()]
    return spark.createDataFrame(rows, "trigger string, error_type string, expected boolean")


@register("exit_codes")
def q_exit_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Q11: the exit code of every event's error, over all error types and none."""
    kinds = F.array(*[F.lit(n) for n in (*sorted(Q.ERROR_EXIT_CODE), "KeyError")], F.lit(None).cast("string"))
    rows = _events(spark, sf).select("event_id", F.element_at(kinds, (F.col("event_id") % F.size(kinds) + 1).cast("int")).alias("error_type"))
    return rows.select("event_id", "error_type", Q.exit_code("error_type").alias("exit_code"))


@register("input_glob")
def q_input_glob(spark: SparkSession, sf: str) -> DataFrame:
    """The raw lines again, their files named by a pattern of folders and files."""
    root = scratch_dir(spark, "raw")
    _landed(spark, sf, root=root)
    return V.parse_status(read_lines(spark, f"{root}/raw-{{all,none}}/part-?????-*"))


@register("stream_interval")
def q_stream_interval(spark: SparkSession, sf: str) -> DataFrame:
    """A recurring stream picks up the second half of the files when they land."""
    root = scratch_dir(spark, "stream")
    landing, store = f"{root}/landing", f"{root}/store"
    docs = adapters.table(spark, sf, "documents")
    adapters.write_raw_records(spark, adapters.source_half(docs, True), landing, mode="append")
    query = R.start_ingest_stream(spark, landing, store, f"{root}/_checkpoints/ingest", interval="1 second", clock=BATCH_CLOCK)
    try:
        query.processAllAvailable()
        adapters.write_raw_records(spark, adapters.source_half(docs, False), f"{root}/second")
        for name in list_files(spark, f"{root}/second"):
            move_new(spark, f"{root}/second/{name}", f"{landing}/{name}")
        query.processAllAvailable()
    finally:
        query.stop()
    return ingest.read_jobs(spark, store).select("job_id", "raw_id")


@register("stream_strict_failure")
def q_stream_strict_failure(spark: SparkSession, sf: str) -> DataFrame:
    """A strict stream records its first, faulty micro-batch as failed and goes on with a clean one."""
    root = scratch_dir(spark, "stream")
    landing, ckpt, store = f"{root}/landing", f"{root}/_checkpoints/ingest", f"{root}/store"
    adapters.write_raw_records(spark, adapters.table(spark, sf, "documents"), landing, mode="append")
    R.run_ingest_once(spark, landing, store, ckpt, clock=BATCH_CLOCK, mode="strict")
    clean = V.validate(read_lines(spark, landing)).where(F.col("status") == "valid")
    clean.select("line").write.text(f"{root}/clean")
    for name in list_files(spark, f"{root}/clean"):
        move_new(spark, f"{root}/clean/{name}", f"{landing}/{name}")
    R.run_ingest_once(spark, landing, store, ckpt, clock=BATCH_CLOCK, mode="strict")
    return ingest.ledger(spark, store).select("batch_id", "status", "error_type", "seen", "inserted")
