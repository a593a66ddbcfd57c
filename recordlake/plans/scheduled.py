"""Scheduled collection run over landed response pages.

Landing layout: ``<landing>/query=<name>/`` holds the response pages of one
query as JSON lines (one response per line, page order = path order), or as one
folder ``page=<n>/`` per page of the collection plan (J6). A run
walks its configured query list in order — a short, bounded loop on the
driver; all data work inside each step is Spark — and for every query:

1. reads and normalises the pages (a rejected response fails the query with
   its error; zero records fails it with "live collection returned zero jobs"),
2. validates the typed records (V*),
3. appends them first-write-wins as one store batch (atomic, idempotent),
4. appends the query's result row.

The first failing query gets a failed result row (zero counters, error type,
redacted message), the run is closed as failed with the totals so far, and the
loop stops (earlier queries stay committed, K3); an unexpected error is recorded
in the same way and raised. Ledger rows are appended to one folder per table;
of rows that re-running a run id writes again, readers take the last.
"""

from __future__ import annotations

import datetime as dt
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlake.functions.redact import redact
from recordlake.operators import ingest as I
from recordlake.operators import normalize as N
from recordlake.operators.validate import RecordValidationError, validate_records
from recordlake.plans.collection import query_folder
from recordlake.schemas import DEFAULT_SOURCE, DEFAULT_URL_PREFIX, RUN_EVENTS, RUN_RESULTS
from recordlake.session import configure, delete_path, list_dirs, path_exists
from recordlake.sources.jsonl import read_lines
from recordlake.sources.snapshots import read_log
from recordlake.sources.store import settle_folding


#: Line numbers of one page folder lie below this.
PAGE_LINES = 1 << 22


class CollectorError(RuntimeError):
    """Expected collection failure (upstream shape, empty result)."""


class UpstreamSchemaOrTemporaryError(CollectorError):
    pass


def redacted(spark: SparkSession, text: str) -> str:
    return spark.range(1).select(redact(F.lit(text)).alias("m")).first()["m"]


#: As stored: of rows with equal (run_id, query_ix) the one written last counts.
STORED_RESULTS = T.StructType([*RUN_RESULTS.fields, T.StructField("written_ns", T.LongType())])


def _append(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("append").parquet(path)


def _run_event(spark: SparkSession, store: str, run_id: str, seq: int, ts: dt.datetime, status: str,
               trigger: str, query_count: int, error_type: str | None = None, error: str | None = None) -> None:
    row = (run_id, seq, ts, status, trigger, query_count, None, None, None, error_type, error)
    _append(spark.createDataFrame([row], RUN_EVENTS), f"{store}/run_events")


def _result(spark: SparkSession, store: str, row: tuple) -> None:
    _append(spark.createDataFrame([(*row, time.time_ns())], STORED_RESULTS), f"{store}/run_results")


def collect_query(spark: SparkSession, landing: str, query: str | None, staging: str, source: str = DEFAULT_SOURCE,
                  url_prefix: str = DEFAULT_URL_PREFIX, max_pages: int | None = None,
                  page_size: int | None = None, exact_casefold: bool = False) -> DataFrame:
    """S5/N12 for one query: normalise its first ``max_pages`` pages, at most ``page_size`` results of each, and
    return the records checked and typed, ready for ``ingest_checked``; raise the collector error instead when a
    response is rejected or there are no records. Every page is parsed once: the normalised responses are written
    under ``staging``, and the checks and the records read them from there. Where pages are landed as
    ``page=<n>/`` folders, only those of the plan are listed and read."""
    path = f"{landing}/{query_folder(query)}"
    if not path_exists(spark, path):
        raise CollectorError(N.ERR_ZERO)
    folders = sorted(int(d[5:]) for d in list_dirs(spark, path) if re.fullmatch(r"page=\d+", d))
    if folders:
        wanted = [f"{path}/page={n}" for n in folders if max_pages is None or n < max_pages]
        if not wanted:
            raise CollectorError(N.ERR_ZERO)
        number = F.regexp_extract("file_path", r"/page=(\d+)/", 1).cast("long") * PAGE_LINES + F.col("line_no")
        responses = read_lines(spark, wanted).select(number.alias("line_no"), F.col("line").alias("body")).where(F.col("body") != "")
    else:
        responses = read_lines(spark, path).select("line_no", F.col("line").alias("body")).where(F.col("body") != "")
        if max_pages is not None:  # a page's number is its rank among the non-blank lines
            responses = responses.orderBy("line_no").limit(max_pages)
    N.normalize(responses, source=source, url_prefix=url_prefix).write.mode("overwrite").parquet(staging)
    norm = spark.read.parquet(staging)
    size = F.size("_results") if page_size is None else F.least(F.size("_results"), F.lit(page_size))
    facts = norm.agg(
        F.min_by("error", F.when(F.col("status") == "rejected", F.col("line_no"))).alias("error"),
        F.count(F.when(F.col("status") == "rejected", 1)).alias("rejected"),
        F.coalesce(F.sum(F.when(F.col("status") == "ok", size)), F.lit(0)).alias("records")).first()
    if facts["rejected"]:
        raise UpstreamSchemaOrTemporaryError(facts["error"])
    if not facts["records"]:
        raise CollectorError(N.ERR_ZERO)
    recs = N.records(norm, ["line_no"], source, url_prefix)
    if page_size is not None:
        recs = recs.where(F.col("pos") < page_size)
    order = F.shiftleft(F.col("line_no"), 20) + F.col("pos")  # a response has a page of results, far below 2**20
    return validate_records(recs.withColumn("ord", order), source, exact_casefold)


def run_collection(spark: SparkSession, store: str, landing: str, queries: list[str] | None, *, run_id: str,
                   trigger: str = "scheduled", clock: dt.datetime | None = None, source: str = DEFAULT_SOURCE,
                   url_prefix: str = DEFAULT_URL_PREFIX, raise_on_failure: bool = True, max_pages: int | None = None,
                   page_size: int | None = None, attempts: DataFrame | None = None) -> DataFrame:
    """K3: one run over ``queries`` (None → one unfiltered query, X15); returns its result rows.

    ``attempts`` (query, attempts), e.g. the roll-up of a landed attempt log
    (A8), gives the number of fetch attempts recorded per query; without a row
    it is 1. An error that is not an expected one is recorded, too, and always raised.
    """
    configure(spark)
    resolved = list(queries) if queries else [None]
    tried = {}
    if attempts is not None:
        wanted = spark.createDataFrame([(q,) for q in resolved], "query string")
        tried = {r["query"]: int(r["n"]) for r in attempts.join(F.broadcast(wanted), attempts["query"].eqNullSafe(wanted["query"]))
                 .groupBy(wanted["query"]).agg(F.max("attempts").alias("n")).collect()}
    folded = settle_folding(spark, store)
    ts = I.second_clock(clock)
    _run_event(spark, store, run_id, 0, ts, "running", trigger, len(resolved))
    failure: Exception | None = None
    for ix, query in enumerate(resolved):
        count = tried.get(query, 1)
        staging = f"{store}/_staging/collect-{run_id}-{ix}"
        try:
            checked = collect_query(spark, landing, query, staging, source, url_prefix, max_pages, page_size, folded)
            led = I.ingest_checked(spark, store, checked, clock=ts, mode="strict", source_query=query).first()
            _result(spark, store, (run_id, ix, query, "success", count, led.seen, led.inserted, led.skipped,
                                   None, None, ts, ts))
        except Exception as exc:  # noqa: BLE001
            failure = exc
            msg = redacted(spark, str(exc))
            _result(spark, store, (run_id, ix, query, "failed", count, 0, 0, 0, type(exc).__name__, msg, ts, ts))
            _run_event(spark, store, run_id, 1, ts, "failed", trigger, len(resolved), type(exc).__name__, msg)
            break
        finally:
            delete_path(spark, staging)
    else:
        _run_event(spark, store, run_id, 1, ts, "success", trigger, len(resolved))
    expected = isinstance(failure, (CollectorError, RecordValidationError))
    if failure is not None and (raise_on_failure or not expected):
        raise failure
    return _last_results(spark, store).where(F.col("run_id") == run_id)


def _last_results(spark: SparkSession, store: str) -> DataFrame:
    rows = read_log(spark, store, "run_results", STORED_RESULTS)
    others = [c for c in RUN_RESULTS.fieldNames() if c not in ("run_id", "query_ix")]
    return (rows.groupBy("run_id", "query_ix").agg(F.max_by(F.struct(*others), F.coalesce("written_ns", F.lit(0))).alias("_r"))
            .select("run_id", "query_ix", "_r.*"))


def read_runs(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """The run ledger of a store: (run_events, run_results) with ``error_text`` columns."""
    ev = read_log(spark, store, "run_events", RUN_EVENTS).withColumnRenamed("redacted_error", "error_text")
    res = _last_results(spark, store).withColumnRenamed("redacted_error", "error_text")
    return ev, res
