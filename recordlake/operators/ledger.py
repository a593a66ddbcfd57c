"""Run ledger: totals, current state and recency reads.

The ledger is append-only: ``run_events`` (status updates) and ``run_results``
(one row per query of a run). Current state is folded on read with
``max_by(..., (ts, rank, seq))`` per run; totals are sums over successful
results. Both are hash aggregations on ``run_id`` (partial aggregation first)
and their outputs are co-partitioned for the join that assembles a run row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.redact import redact
from recordlake.functions.text import duration_seconds, iso_utc
from recordlake.operators.reads import validate_limit

RUN_COLUMNS = ("run_id", "started_at", "finished_at", "duration_seconds", "status", "trigger", "query_count",
               "total_seen", "total_inserted", "total_skipped", "error_type", "redacted_error")
RESULT_COLUMNS = ("id", "run_id", "query", "status", "attempts", "seen_count", "inserted_count", "skipped_count",
                  "error_type", "redacted_error", "started_at", "finished_at")


def _status_rank(c: Column) -> Column:
    return F.when(c == "running", 0).otherwise(1)


def run_totals(results: DataFrame) -> DataFrame:
    """A4: per run — queries recorded and Σ seen / inserted / skipped of successful ones."""
    ok = F.col("status") == "success"
    return results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("query_count"),
        F.coalesce(F.sum(F.when(ok, F.col("seen_count"))), F.lit(0)).cast("long").alias("total_seen"),
        F.coalesce(F.sum(F.when(ok, F.col("inserted_count"))), F.lit(0)).cast("long").alias("total_inserted"),
        F.coalesce(F.sum(F.when(ok, F.col("skipped_count"))), F.lit(0)).cast("long").alias("total_skipped"),
    )


def run_state(events: DataFrame) -> DataFrame:
    """Last status per run (ties on the 1-second clock broken by rank, then seq)."""
    order = F.struct(F.col("ts"), _status_rank(F.col("status")), F.col("seq"))
    last = F.max_by(F.struct("status", "ts", "error_type", "error_text"), order)
    planned = F.max("query_count") if "query_count" in events.columns else F.lit(None).cast("long")
    return events.groupBy("run_id").agg(
        F.min("ts").alias("_started"),
        F.min_by("trigger", F.struct("ts", "seq")).alias("trigger"),
        planned.alias("_planned"),
        last.alias("_last"),
    ).select(
        "run_id", "_started", "trigger", "_planned",
        F.col("_last.status").alias("status"),
        F.when(F.col("_last.status") != "running", F.col("_last.ts")).alias("_finished"),
        F.when(F.col("_last.status") == "failed", F.col("_last.error_type")).alias("error_type"),
        F.when(F.col("_last.status") == "failed", redact(F.col("_last.error_text"))).alias("redacted_error"),
    )


def runs(events: DataFrame, results: DataFrame) -> DataFrame:
    """Current run rows (12 columns, ISO text times).

    ``query_count`` is the planned query count carried by the run's events when
    present (a run that stops early still reports its plan), else the number
    of result rows.
    """
    state = run_state(events)
    totals = run_totals(results)
    j = state.join(totals, "run_id", "left")
    started, finished = iso_utc("_started"), iso_utc("_finished")
    return j.select(
        "run_id", started.alias("started_at"), finished.alias("finished_at"),
        duration_seconds(started, finished).alias("duration_seconds"),
        "status", "trigger",
        F.coalesce(F.col("_planned"), F.col("query_count"), F.lit(0)).cast("long").alias("query_count"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
          for c in ("total_seen", "total_inserted", "total_skipped")],
        "error_type", "redacted_error",
    )


def _recent(df: DataFrame) -> Column:
    return (F.col("started_at").desc(), F.col("run_id").desc())


def recent_runs(run_rows: DataFrame, limit: int = 5) -> DataFrame:
    """Newest runs first (started_at DESC, run_id DESC)."""
    return run_rows.orderBy(*_recent(run_rows)).limit(validate_limit(limit))


def latest_run(run_rows: DataFrame) -> DataFrame:
    """The single newest run."""
    return run_rows.orderBy(*_recent(run_rows)).limit(1)


def result_rows(results: DataFrame) -> DataFrame:
    """Result rows (12 columns): redacted message, ISO text times."""
    return results.select(
        F.col("query_ix").alias("id"), "run_id", "query", "status", "attempts", "seen_count", "inserted_count",
        "skipped_count", "error_type", redact(F.col("error_text")).alias("redacted_error"),
        iso_utc("started_at").alias("started_at"), iso_utc("finished_at").alias("finished_at"),
    )


def recent_results(results: DataFrame, run_rows: DataFrame | None = None, run_id: str | None = None,
                   limit: int = 5) -> DataFrame:
    """Newest result rows, optionally of one run (by id, or the latest run)."""
    rows = result_rows(results)
    if run_id is not None:
        rows = rows.where(F.col("run_id") == run_id)
    elif run_rows is not None:
        rows = rows.join(F.broadcast(latest_run(run_rows).select("run_id")), "run_id", "left_semi")
    return rows.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(validate_limit(limit))


def failed_run_probe(run_rows: DataFrame, trigger: str, error_type: str) -> DataFrame:
    """F8: the newest failed run of a trigger with a given error type (0 or 1 row)."""
    hit = run_rows.where((F.col("trigger") == trigger) & (F.col("status") == "failed")
                         & (F.col("error_type") == error_type))
    return hit.orderBy(*_recent(hit)).limit(1).select("run_id", "started_at", "error_type")
