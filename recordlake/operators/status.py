"""The status document (T7): newest runs, the newest run's results, newest commands and the worker's config.

Every log is scanned once. A run's totals and its newest results come from one
window per run; run rows then go through one top-k. The command fold is spread
into one group for the newest commands and one per config key, and a row number
per group keeps the first few rows of each: Spark applies that bound in every task
before the shuffle, so what reaches the last task is a few rows per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlake.functions.text import iso_utc
from recordlake.operators import control as C
from recordlake.operators import ledger as L
from recordlake.operators.reads import validate_limit


def _newest_runs(run_events: DataFrame, run_results: DataFrame, limit: int) -> DataFrame:
    """The newest runs, each with its totals and its newest results."""
    each = Window.partitionBy("run_id")
    newest = each.orderBy(F.col("started_at").desc(), F.col("query_ix").desc())
    ok = F.col("status") == "success"
    totals = {f"total_{c}": F.sum(F.when(ok, F.col(f"{c}_count"))).over(each) for c in ("seen", "inserted", "skipped")}
    rows = run_results.select("*", F.row_number().over(newest).alias("_n"), F.count("*").over(each).alias("_queries"),
                              *[c.alias(n) for n, c in totals.items()]).where(F.col("_n") <= limit)
    shown = F.struct(F.col("started_at").alias("_at"), F.col("query_ix").alias("id"), "query", "status", "attempts", "seen_count",
                     "inserted_count", "skipped_count", "error_type", iso_utc("finished_at").alias("finished_at"))
    per_run = rows.groupBy("run_id").agg(F.sort_array(F.collect_list(shown), asc=False).alias("results"), F.max("_queries").alias("_queries"),
                                         *[F.max(n).alias(n) for n in totals])
    state = L.run_state(run_events).join(per_run, "run_id", "left")
    return state.select(
        "run_id", iso_utc("_started").alias("started_at"), "status", "trigger",
        F.coalesce("_planned", "_queries", F.lit(0)).cast("long").alias("query_count"),
        *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in totals], "error_type", "redacted_error", "results",
    ).orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def _entry(group: Column, ts: Column, seq: Column, name: Column, value: Column) -> Column:
    return F.struct(group.alias("g"), ts.alias("ts"), seq.cast("long").alias("seq"), name.cast("string").alias("name"),
                    value.cast("string").alias("value"))


def _newest_commands(command_events: DataFrame, config_events: DataFrame | None, limit: int) -> DataFrame:
    """(g, n, name, value): the newest commands (g ``command``), and the last value of each config key (g its name)."""
    state = C.command_state(command_events)
    changes = F.when((F.col("status") == "applied") & C.command_error().isNull(), C.command_changes())
    sets = F.transform(F.map_entries(changes), lambda e: _entry(
        e["key"], F.col("_applied_ts"), F.col("_applied_seq"), F.lit(None), e["value"]))
    command = F.array(_entry(F.lit("command"), F.to_timestamp("created_at"), F.lit(0), F.col("command_id"), F.col("status")))
    rows = state.select(F.inline(F.concat(command, F.coalesce(sets, F.filter(command, lambda x: F.lit(False))))))
    if config_events is not None:
        valid = C.validate_config_events(config_events).where(F.col("error").isNull())
        rows = rows.unionByName(valid.select(F.inline(F.array(_entry(F.col("key"), F.col("ts"), F.col("seq"), F.lit(None), F.col("value_json"))))))
    order = Window.partitionBy("g").orderBy(F.col("ts").desc(), F.col("seq").desc(), F.col("name").desc())
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)


def status_document(run_events: DataFrame, run_results: DataFrame, command_events: DataFrame,
                    config_events: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """One row: ``status`` and ``last_run_id`` of the newest run (``empty`` and NULL without one), and as arrays,
    newest first, ``recent_runs`` (run ids), ``recent_results`` (result ids of the newest run), ``recent_commands``
    (command ids), and ``config`` (``key=value`` of every key, defaults included, sorted)."""
    validate_limit(limit)
    runs = _newest_runs(run_events, run_results, limit).select(
        F.struct("started_at", "run_id", "status", F.transform("results", lambda r: r["id"]).alias("ids")).alias("run"),
        F.lit(None).cast("struct<n:int,name:string>").alias("command"), F.lit(None).cast("struct<key:string,value:string>").alias("setting"))
    # The top-k and the group limits leave at most limit * 7 rows for this aggregate.
    commands = _newest_commands(command_events, config_events, limit).select(
        F.lit(None).cast(runs.schema["run"].dataType).alias("run"),
        F.when(F.col("g") == "command", F.struct("n", "name")).alias("command"),
        F.when((F.col("g") != "command") & (F.col("n") == 1), F.struct(F.col("g").alias("key"), "value")).alias("setting"))
    all_rows = runs.unionByName(commands).agg(
        F.sort_array(F.collect_list("run"), asc=False).alias("runs"), F.sort_array(F.collect_list("command")).alias("commands"),
        F.map_from_entries(F.collect_list("setting")).alias("settings"))
    newest = F.try_element_at("runs", F.lit(1))
    pairs = F.transform(F.array_sort(C.default_rows()), lambda d: F.concat(
        d["key"], F.lit("="), F.coalesce(F.try_element_at(F.col("settings"), d["key"]), d["value_json"])))
    return all_rows.select(
        F.coalesce(newest["status"], F.lit("empty")).alias("status"), newest["run_id"].alias("last_run_id"),
        F.transform("runs", lambda r: r["run_id"]).alias("recent_runs"),
        F.coalesce(newest["ids"], F.array().cast("array<long>")).alias("recent_results"),
        F.transform("commands", lambda c: c["name"]).alias("recent_commands"), F.array_sort(pairs).alias("config"))
