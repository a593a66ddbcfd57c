import datetime as dt
import json

from pyspark.sql import functions as F

from recordlake.operators import control as C
from recordlake.operators import ledger as L
from recordlake.operators import quality as Q
from recordlake.plans.collection import collection_plan
from recordlake.schemas import COMMAND_EVENTS, CONFIG_EVENTS


def test_response_classification(spark):
    df = spark.createDataFrame([(200, "too many rate limits"), (429, ""), (403, ""), (503, ""), (404, ""),
                                (400, "Access Denied"), (418, "please throttle")], "status int, body string")
    got = [r.response_class for r in Q.response_classes(df).collect()]
    assert got == ["ok", "rate_limited", "blocked", "temporary", "passed", "blocked", "rate_limited"]


def test_retry_policy(spark):
    df = spark.createDataFrame([("temporary", 1), ("temporary", 2), ("temporary", 3), ("rate_limited", 1),
                                ("rate_limited", 2), ("blocked", 1), ("ok", 1)], "response_class string, attempt_no int")
    rows = Q.retry_verdict(df).collect()
    assert [(r.retry, r.exhausted) for r in rows] == [
        (True, False), (True, False), (False, True), (True, False), (False, True), (False, True), (False, False)]
    assert [r.backoff_min_s for r in rows[:2]] == [24.0, 48.0]
    assert (rows[3].backoff_min_s, rows[3].backoff_max_s) == (120.0, 300.0)


def test_attempt_rollup(spark):
    df = spark.createDataFrame([("r", "q", 1, "temporary", 1), ("r", "q", 2, "temporary", 2), ("r", "q", 3, "ok", 3),
                                ("r", "b", 1, "blocked", 4), ("r", "p", 1, "rate_limited", 5)],
                               "run_id string, query string, attempt_no int, response_class string, event_id long")
    got = {r.query: (r.ending_attempt, r.outcome) for r in Q.attempt_rollup(df, ["run_id", "query"]).collect()}
    assert got == {"q": (3, "success"), "b": (1, "blocked"), "p": (None, "pending")}


def test_config_validation_cases(spark):
    cases = [("max_pages", "3", None), ("max_pages", "0", "max_pages must be a positive integer"),
             ("page_size", "true", "page_size must be a positive integer"),
             ("interval_seconds", "1.5", "interval_seconds must be a positive integer"),
             ("paused", "false", None), ("paused", "1", "paused must be a boolean"),
             ("queries", "[]", None), ("queries", '["a", " b "]', None),
             ("queries", '["a", " "]', "queries must be a list of non-empty strings"),
             ("queries", '"a"', "queries must be a list of non-empty strings"),
             ("queries", '["a", 1]', "queries must be a list of non-empty strings"),
             ("colour", "1", "unsupported config keys: colour")]
    df = spark.createDataFrame([(k, v) for k, v, _ in cases], "key string, value_json string")
    got = [r[0] for r in df.select(C.config_value_error(F.col("key"), F.col("value_json"))).collect()]
    assert got == [e for _, _, e in cases]


def test_command_fold_and_config_after_commands(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = [
        ("c1", 1, t0, "queued", "pause", "{}", "mcp", None, None, None),
        ("c1", 2, t0, "applied", "pause", "{}", "mcp", None, None, None),
        ("c1", 3, t0, "running", "pause", "{}", "mcp", None, None, None),
        ("c2", 4, t0 + dt.timedelta(seconds=1), "queued", "update_config", json.dumps({"updates": {"max_pages": 2}}), "mcp", None, None, None),
        ("c2", 5, t0 + dt.timedelta(seconds=2), "applied", "update_config", None, "mcp", None, None, None),
        ("c3", 6, t0 + dt.timedelta(seconds=3), "queued", "update_config", json.dumps({"updates": {"max_pages": 0}}), "mcp", None, None, None),
        ("c3", 7, t0 + dt.timedelta(seconds=3), "applied", "update_config", None, "mcp", None, None, None),
        ("c4", 8, t0 + dt.timedelta(seconds=4), "queued", "run_once", "{}", "mcp", None, None, None),
    ]
    df = spark.createDataFrame(ev, COMMAND_EVENTS)
    st = {r.command_id: r for r in C.command_state(df).collect()}
    assert st["c1"].status == "applied" and st["c1"].started_at == "2024-01-01T00:00:00Z"
    assert C.fifo_head(C.command_state(df)).first().command_id == "c4"
    cfg = {r.key: r.value_json for r in C.config_after_commands(spark, None, df).collect()}
    assert cfg == {"interval_seconds": "3600", "queries": "[]", "max_pages": "2", "page_size": "50",
                   "paused": "true"}


def test_config_state_last_writer_wins(spark):
    t = dt.datetime(2024, 1, 1)
    ev = [("paused", "true", t, 1, "mcp"), ("paused", "false", t, 2, "worker"), ("paused", "7", t, 3, "mcp"),
          ("max_pages", "4", t, 4, "mcp")]
    df = spark.createDataFrame(ev, CONFIG_EVENTS).withColumn("scope", F.lit("w"))
    got = {r.key: (r.value_json, r.updated_by) for r in C.config_state(df).collect()}
    assert got == {"paused": ("false", "worker"), "max_pages": ("4", "mcp")}


def test_run_ledger(spark):
    t = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([
        ("r1", 1, t, "running", "scheduled", None, None),
        ("r1", 2, t + dt.timedelta(seconds=90), "failed", "scheduled", "RateLimitedError", "boom token=abc"),
        ("r2", 3, t + dt.timedelta(seconds=5), "running", "scheduled", None, None),
    ], "run_id string, seq long, ts timestamp, status string, trigger string, error_type string, error_text string")
    results = spark.createDataFrame([
        ("r1", 1, "a", "success", 1, 10, 4, 6, None, None, t, t),
        ("r1", 2, "b", "failed", 2, 0, 0, 0, "RateLimitedError", "token=abc", t, t),
    ], "run_id string, query_ix long, query string, status string, attempts long, seen_count long, "
       "inserted_count long, skipped_count long, error_type string, error_text string, started_at timestamp, "
       "finished_at timestamp")
    runs = {r.run_id: r for r in L.runs(events, results).collect()}
    r1 = runs["r1"]
    assert (r1.status, r1.duration_seconds, r1.total_seen, r1.total_inserted) == ("failed", 90, 10, 4)
    assert r1.redacted_error == "boom token=<redacted>"
    assert runs["r2"].finished_at is None and runs["r2"].query_count == 0
    assert L.latest_run(L.runs(events, results)).first().run_id == "r2"


def test_collection_plan(spark):
    df = spark.createDataFrame([(1, " python , scraping,automation , "), (2, " , , ")], "k int, q string")
    rows = collection_plan(df, "k", "q", max_pages=2, page_size=50).collect()
    assert len(rows) == 8
    assert {(r.query, r.page, r.offset) for r in rows if r.k == 1} >= {("python", 1, 50), ("automation", 0, 0)}
    assert [r.query for r in rows if r.k == 2] == [None, None]
