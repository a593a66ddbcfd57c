"""Configuration and command state folded from append-only event logs
(T2–T6, T8, J5, O7, O8, F6, Q6, Q7, U2, A7).

Config events ``(scope, key, value_json, ts, seq, updated_by)`` and command
events ``(command_id, seq, ts, status, command_type, payload_json, ...)`` are
only ever appended. Current state is a per-key ``max_by`` over
``(ts, rank, seq)``: a sort-based aggregation (its buffers are structs), combined
within each task before the shuffle, so even a key updated by a third of all
events costs one partial row per task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlake.functions import jsonx as J
from recordlake.functions.text import clock_literal, iso_utc, py_strip
from recordlake.operators.reads import validate_limit
from recordlake.schemas import COMMAND_STATUSES, COMMAND_TYPES, CONFIG_KEYS, TERMINAL_STATUSES

# Config-update diagnostics.
MSG_UNSUPPORTED_KEYS = "unsupported config keys: "
MSG_UNSUPPORTED_COMMAND = "unsupported command type: "
MSG_UPDATE_SHAPE = "update_config payload must be an object"
MSG_POSITIVE_INT = " must be a positive integer"
MSG_PAUSED_BOOL = "paused must be a boolean"
MSG_QUERIES_LIST = "queries must be a list of non-empty strings"

# Worker defaults persisted when a key has no value yet.
DEFAULT_CONFIG = {"interval_seconds": 3600, "queries": [], "max_pages": 5, "page_size": 50, "paused": False}
INT_KEYS = ("interval_seconds", "max_pages", "page_size")


def config_value_error(key: Column, value_json: Column) -> Column:
    """Q6: reason an update (key, JSON value) is refused, NULL when valid."""
    v = J.parse(value_json)
    t = J.vtype(v)
    is_int = t.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
    positive = F.coalesce(is_int & (F.try_variant_get(v, "$", "long") >= 1), F.lit(False))
    arr = F.when(J.is_array(v), F.try_variant_get(v, "$", "array<variant>"))
    strings_ok = F.forall(arr, lambda e: J.is_string(e) & (py_strip(J.typed_str(e)) != ""))
    return (
        F.when(~key.isin(*CONFIG_KEYS), F.concat(F.lit(MSG_UNSUPPORTED_KEYS), key))
        .when(key.isin(*INT_KEYS) & ~positive, F.concat(key, F.lit(MSG_POSITIVE_INT)))
        .when((key == "paused") & ~F.coalesce(t == "BOOLEAN", F.lit(False)), F.lit(MSG_PAUSED_BOOL))
        .when((key == "queries") & ~F.coalesce(strings_ok, F.lit(False)),
              F.lit(MSG_QUERIES_LIST))
    )


def validate_config_events(events: DataFrame) -> DataFrame:
    return events.withColumn("error", config_value_error(F.col("key"), F.col("value_json")))


def config_state(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Last valid value per (scope, key) — last writer wins on (ts, seq)."""
    keys = keys or ["scope", "key"]
    valid = validate_config_events(events).where(F.col("error").isNull())
    return valid.groupBy(*keys).agg(
        F.max_by(F.struct("value_json", "ts", "updated_by"), F.struct("ts", "seq")).alias("_l")
    ).select(*keys, "_l.value_json", iso_utc("_l.ts").alias("updated_at"), "_l.updated_by")


def default_rows() -> Column:
    """The defaults as an array of (key, value_json) structs, JSON text as ``json.dumps`` writes it."""
    return F.array(*[
        F.struct(F.lit(k).alias("key"), F.lit(json.dumps(v)).alias("value_json")) for k, v in DEFAULT_CONFIG.items()
    ])


def seeded(current: DataFrame, scopes: DataFrame) -> DataFrame:
    """Every scope gets every default key; a persisted value wins over the default.

    Defaults are exploded per scope row (no cross join), then left-joined to the
    folded state on (scope, key).
    """
    base = scopes.select("scope", F.explode(default_rows()).alias("_d")).select(
        "scope", F.col("_d.key").alias("key"), F.col("_d.value_json").alias("default_json"))
    j = base.join(current, ["scope", "key"], "full_outer")
    return j.select(
        "scope", "key", F.coalesce("value_json", "default_json").alias("value_json"),
        F.when(F.col("value_json").isNull(), "default").otherwise("persisted").alias("origin"),
    )


# ----------------------------------------------------------------- commands


def _rank(c: Column) -> Column:
    return F.when(c == "queued", 0).when(c == "running", 1).otherwise(2)


def command_state(events: DataFrame) -> DataFrame:
    """Current status per command with the time of each transition, and of the
    last event its result and error (N13: 11 columns)."""
    for name in ("result_json", "error_type", "redacted_error"):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast("string"))
    order = F.struct(F.col("ts"), _rank(F.col("status")), F.col("seq"))
    first = F.struct("ts", "seq")
    st = F.col("status")
    return events.groupBy("command_id").agg(
        F.max_by("status", order).alias("status"),
        F.max(order).alias("_last"),
        F.max_by(F.struct("result_json", "error_type", "redacted_error"), order).alias("_end"),
        F.min_by("command_type", first).alias("command_type"),
        F.min_by("payload_json", first).alias("payload_json"),
        F.min_by("requested_by", first).alias("requested_by"),
        F.coalesce(F.min(F.when(st == "queued", F.col("ts"))), F.min("ts")).alias("_created"),
        F.min(F.when(st == "running", F.col("ts"))).alias("_started"),
        F.min(F.when(st.isin(*TERMINAL_STATUSES), F.col("ts"))).alias("_finished"),
    ).select(
        "command_id", "command_type", "payload_json", "status",
        iso_utc("_created").alias("created_at"), iso_utc("_started").alias("started_at"),
        iso_utc("_finished").alias("finished_at"), "requested_by",
        "_end.result_json", "_end.error_type", "_end.redacted_error",
        F.col("_last.ts").alias("_applied_ts"), F.col("_last.seq").alias("_applied_seq"),
    )


def command_checks(events: DataFrame) -> DataFrame:
    """Q7: type and status vocabulary checks per event."""
    return events.select(
        "command_id", "seq",
        F.col("command_type").isin(*COMMAND_TYPES).alias("type_ok"),
        F.col("status").isin(*COMMAND_STATUSES).alias("status_ok"),
    )


def fifo_head(state: DataFrame) -> DataFrame:
    """The oldest queued command (created_at ASC, command_id ASC)."""
    q = state.where(F.col("status") == "queued")
    return q.orderBy(F.col("created_at").asc(), F.col("command_id").asc()).limit(1)


def recent_commands(state: DataFrame, limit: int = 5) -> DataFrame:
    """Newest commands (created_at DESC, command_id DESC)."""
    return state.orderBy(F.col("created_at").desc(), F.col("command_id").desc()).limit(validate_limit(limit))


def command_status(state: DataFrame, command_id: str) -> DataFrame:
    """One command or no row (not found)."""
    return state.where(F.col("command_id") == command_id)


def payload_updates(payload: Column | str = "payload_json") -> Column:
    """The updates of an ``update_config`` payload: its ``updates`` object, or the payload itself
    where it has none (a bare payload). NULL when that is not an object."""
    v = J.parse(F.col(payload) if isinstance(payload, str) else payload)
    inner = F.try_variant_get(v, "$.updates", "variant")
    return F.when(inner.isNull(), F.try_variant_get(v, "$", "map<string, variant>")).otherwise(
        F.try_variant_get(v, "$.updates", "map<string, variant>"))


def config_changes_from_commands(state: DataFrame) -> DataFrame:
    """Applied commands as config updates (scope ``worker``).

    pause → paused=true, resume → paused=false, update_config → each key of
    ``updates``; an update whose keys or values are invalid changes nothing
    (the command fails as a whole, U2).
    """
    applied = state.where(F.col("status") == "applied")
    pairs = command_changes()
    ex = applied.select("command_id", "_applied_ts", "_applied_seq", F.explode(pairs).alias("key", "value_json"))
    ex = ex.withColumn("error", config_value_error(F.col("key"), F.col("value_json")))
    bad = ex.where(F.col("error").isNotNull()).select("command_id").distinct()
    good = ex.join(bad, "command_id", "left_anti")
    return good.select(
        F.lit("worker").alias("scope"), "key", "value_json", F.col("_applied_ts").alias("ts"),
        F.col("_applied_seq").alias("seq"), F.lit("worker").alias("updated_by"),
    )


def config_after_commands(spark: SparkSession, config_events: DataFrame | None, command_events: DataFrame) -> DataFrame:
    """Worker config after draining every applied command in (ts, seq) order."""
    changes = config_changes_from_commands(command_state(command_events))
    if config_events is not None:
        changes = config_events.select(*changes.columns).unionByName(changes)
    current = config_state(changes)
    scopes = spark.range(1).select(F.lit("worker").alias("scope"))
    return seeded(current.where(F.col("scope") == "worker"), scopes)


def readiness(present_tables: set[str], schema_version: int | None, required: set[str],
              supported_version: int, config_rows: int | None = None) -> dict:
    """Store verdict, checked in order db_missing → unsupported_schema →
    schema_missing → config_empty → ready."""
    if schema_version is None and not present_tables:
        return {"ok": False, "reason": "db_missing", "details": "database file does not exist"}
    if schema_version is not None and schema_version > supported_version:
        return {"ok": False, "reason": "unsupported_schema",
                "details": "database schema version is newer than this build supports"}
    missing = sorted(required - present_tables)
    if missing:
        return {"ok": False, "reason": "schema_missing", "details": "runtime schema is missing required tables"}
    if config_rows is not None and config_rows == 0:
        return {"ok": False, "reason": "config_empty", "details": "no collector config rows"}
    return {"ok": True, "reason": "ready", "details": None}


READINESS_SCHEMA = T.StructType([
    T.StructField("store", T.StringType()), T.StructField("ok", T.BooleanType()),
    T.StructField("reason", T.StringType()), T.StructField("details", T.StringType()),
])


def command_error(payload: Column | str = "payload_json") -> Column:
    """Why a config command is refused (U2: first refused key), NULL when it is valid."""
    upd = payload_updates(payload)
    errs = F.filter(
        F.transform(F.map_entries(F.coalesce(upd, F.create_map().cast("map<string, variant>"))),
                    lambda e: config_value_error(e["key"], F.to_json(e["value"]))),
        lambda x: x.isNotNull(),
    )
    update = F.col("command_type") == "update_config"
    return F.when(update & upd.isNull(), F.lit(MSG_UPDATE_SHAPE)).when(update, F.try_element_at(errs, F.lit(1)))


def command_changes(payload: Column | str = "payload_json") -> Column:
    """The config updates of a command as a map key → JSON value; NULL for ``run_once``."""
    return (F.when(F.col("command_type") == "pause", F.create_map(F.lit("paused"), F.lit("true")))
            .when(F.col("command_type") == "resume", F.create_map(F.lit("paused"), F.lit("false")))
            .when(F.col("command_type") == "update_config", F.transform_values(payload_updates(payload), lambda k, v: F.to_json(v))))


def drain_plan(state: DataFrame, config: DataFrame) -> DataFrame:
    """T5: what draining the pending commands in FIFO order does, as an as-of fold.

    Pending are queued commands, and running ones: with one worker per store,
    a command that is running when a drain begins was left by a worker that died
    (T3). Each gets its ``position`` (from 1, created_at then command_id), its
    outcome (``applied``, ``failed`` with the reason, or ``run`` for ``run_once``)
    and ``config_json``, the whole config valid after it: per key the last value
    that a valid command up to it has set, else that of ``config`` (rows of
    ``config_after_commands``). So an update queued after a run does not
    reach back to it, and one queued before it does.

    The window over positions holds pending commands only; the fold of values is a
    window per config key.
    """
    pending = state.where(F.col("status").isin("queued", "running"))
    error = command_error()
    ranked = pending.select(
        "*", F.row_number().over(Window.orderBy("created_at", "command_id")).cast("long").alias("position"),
        error.alias("error"))
    ranked = ranked.withColumn("changes", F.when(F.col("error").isNull(), command_changes()))
    keys = F.array(*[F.lit(k) for k in sorted(CONFIG_KEYS)])
    per_key = ranked.select("command_id", "position", F.explode(keys).alias("key"), "changes").select(
        "command_id", "position", "key", F.col("changes")[F.col("key")].alias("value_json"))
    asof = F.last("value_json", ignorenulls=True).over(
        Window.partitionBy("key").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    base = config.select("key", F.col("value_json").alias("base_json"))
    valid = per_key.select("command_id", "key", asof.alias("asof")).join(base, "key", "left").groupBy("command_id").agg(
        F.sort_array(F.collect_list(F.struct("key", F.coalesce("asof", "base_json").alias("value")))).alias("pairs"))
    shown = F.transform("pairs", lambda p: F.concat(F.lit('"'), p["key"], F.lit('":'), p["value"]))
    return ranked.join(valid, "command_id").select(
        "command_id", "position", "command_type", F.col("status").alias("was"), "created_at",
        F.when(F.col("command_type") == "run_once", "run").when(F.col("error").isNull(), "applied").otherwise("failed").alias("outcome"),
        F.col("error").alias("error"), F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}")).alias("config_json"),
        "payload_json", "requested_by")


def drain_events(plan: DataFrame, clock_ts, after_seq: int) -> DataFrame:
    """T5/T3 as one set operation: a ``running`` and a terminal event for every config command of a
    ``drain_plan``. An applied command's result is the config valid after it (T8), a failed one has the
    reason; ``run_once`` commands end with their run, see ``finished_event``.

    The events carry the drain clock; ``seq`` follows the FIFO position after
    ``after_seq``, the largest one so far (``last_seq``), so that folds by (ts, seq)
    see the commands in that order.
    """
    done = plan.where(F.col("command_type") != "run_once")
    ts = clock_literal(clock_ts)
    seq = F.lit(after_seq).cast("long") + 2 * F.col("position")
    failed = F.col("outcome") == "failed"
    none = F.lit(None).cast("string")
    started = F.struct(seq.alias("seq"), F.lit("running").alias("status"), none.alias("result_json"),
                       none.alias("error_type"), none.alias("redacted_error"))
    ended = F.struct((seq + 1).alias("seq"), F.col("outcome").alias("status"),
                     F.when(~failed, F.concat(F.lit('{"config":'), F.col("config_json"), F.lit("}"))).alias("result_json"),
                     F.when(failed, F.lit("ValueError")).alias("error_type"), F.col("error").alias("redacted_error"))
    rows = done.select("command_id", "command_type", "payload_json", "requested_by", F.array(started, ended).alias("events"))
    return rows.select("command_id", "command_type", "payload_json", "requested_by", ts.alias("ts"), F.inline("events")).select(
        "command_id", "seq", "ts", "status", "command_type", "payload_json", "requested_by", "result_json", "error_type",
        "redacted_error")


def last_seq(state: DataFrame) -> int:
    """The largest ``seq`` of a command log; 0 for an empty one."""
    return int(state.agg(F.coalesce(F.max("_applied_seq"), F.lit(0))).first()[0])


def update_error(spark: SparkSession, payload_json: str) -> str | None:
    """Why an ``update_config`` payload is refused, or None. Unknown keys come first, all of
    them in order; then the first key whose value is refused."""
    row = spark.createDataFrame([(payload_json,)], "payload_json string").select(payload_updates().alias("u"))
    pairs = row.select(F.explode(F.map_entries(F.transform_values("u", lambda k, v: F.to_json(v))))).select("col.*")
    if row.where("u is not null").isEmpty():
        return MSG_UPDATE_SHAPE
    unknown = pairs.where(~F.col("key").isin(*CONFIG_KEYS)).agg(F.array_join(F.sort_array(F.collect_set("key")), ", ").alias("k")).first()["k"]
    if unknown:
        return MSG_UNSUPPORTED_KEYS + unknown
    bad = pairs.select("key", config_value_error(F.col("key"), F.col("value")).alias("e")).where("e is not null")
    return bad.agg(F.min_by("e", "key").alias("e")).first()["e"]


def started_event(command: DataFrame, clock_ts) -> DataFrame:
    """The ``running`` event of a command (a row of ``command_state``), written before its run."""
    none = F.lit(None).cast("string")
    return command.select(
        "command_id", (F.col("_applied_seq") + 1).alias("seq"), clock_literal(clock_ts).alias("ts"), F.lit("running").alias("status"),
        "command_type", "payload_json", "requested_by", none.alias("result_json"), none.alias("error_type"), none.alias("redacted_error"))


def finished_event(command: DataFrame, clock_ts, result: dict | None = None, error_type: str | None = None,
                   redacted_error: str | None = None) -> DataFrame:
    """The terminal event of a command (a row of ``command_state``) after its run: applied with
    its result, or failed with its error."""
    failed = error_type is not None
    return command.select(
        "command_id", (F.col("_applied_seq") + 1).alias("seq"), clock_literal(clock_ts).alias("ts"),
        F.lit("failed" if failed else "applied").alias("status"), "command_type", "payload_json", "requested_by",
        F.lit(None if failed else json.dumps(result or {})).cast("string").alias("result_json"),
        F.lit(error_type).cast("string").alias("error_type"), F.lit(redacted_error).cast("string").alias("redacted_error"))
