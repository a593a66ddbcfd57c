"""Planned pages, typed hand-over and the status document."""

import datetime as dt
import json

import pytest

from recordlake import api
from recordlake.operators import quality as Q
from recordlake.operators.normalize import jsonl_value
from recordlake.operators.validate import validate, validate_records
from recordlake.plans import collection as C
from recordlake.plans import scheduled as SCH
from recordlake.sources import store
from tests.conftest import write_text

CLOCK = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)


def body(ids):
    rows = [{"id": str(i), "title": "T", "description": "D"} for i in ids]
    return json.dumps({"data": {"search": {"universalSearchNuxt": {"visitorJobSearchV1": {"results": rows}}}}})


def test_typed_records_validate_as_their_json_lines(spark):
    good = ("feed", "1", " t ", "d\n\"q\"\\", "u", ["Straße", " a  b ", "A B", ""], None, " x ", "", 12.5, None, 1e7, "7")
    rows = [good, ("other", *good[1:]), (None, *good[1:]), ("feed", " ", *good[2:]), ("feed", "1", "", *good[3:]),
            (*good[:4], None, *good[5:]), (*good[:5], None, *good[6:]), (*good[:9], 0.1, 1e-07, 3.0, None)]
    schema = ("source string, id string, title string, description string, url string, skills array<string>, posted_at string, "
              "job_type string, contractor_tier string, hourly_min double, hourly_max double, fixed_amount double, raw_id string, line_no long")
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema)
    for exact in (False, True):
        typed = validate_records(df, exact_casefold=exact)
        lines = validate(df.select("line_no", jsonl_value().alias("line")), exact_casefold=exact)
        columns = [c for c in typed.columns if c in lines.columns]
        assert "content_hash" in columns and len(columns) == 18
        assert sorted(map(str, typed.select(columns).collect())) == sorted(map(str, lines.select(columns).collect()))


def test_run_reads_planned_pages_only(spark, scratch):
    root, landing = f"{scratch}/store", f"{scratch}/landing"
    for page, ids in ((0, [1, 2]), (1, [2, 3]), (2, [4]), (10, [5])):
        write_text(f"{landing}/query=q/page={page}/a.jsonl", [body(ids)])
    write_text(f"{landing}/query=__all__/page=0/a.jsonl", [body([9])])
    res = SCH.run_collection(spark, root, landing, ["q"], run_id="r1", clock=CLOCK, max_pages=2).first()
    assert (res.seen_count, res.inserted_count) == (4, 3)
    res = SCH.run_collection(spark, root, landing, None, run_id="r2", clock=CLOCK, max_pages=2).first()
    assert (res.seen_count, res.inserted_count) == (1, 1)
    with pytest.raises(SCH.CollectorError):
        SCH.run_collection(spark, root, f"{landing}/query=q/page=0", ["q"], run_id="r3", clock=CLOCK)
    plan = C.collection_plan(spark.createDataFrame([(1, "q"), (2, "")], "k int, t string"), "k", "t", max_pages=3)
    landed = C.landed_pages(spark, landing)
    assert {(r.query, r.page): r.landed for r in C.planned_pages(plan, landed).collect()} == {
        ("q", 0): True, ("q", 1): True, ("q", 2): True, (None, 0): True, (None, 1): False, (None, 2): False}
    assert {(r.query, r.page) for r in C.missing_pages(plan, landed).collect()} == {(None, 1), (None, 2)}


def test_status_document_of_an_empty_and_a_used_store(spark, scratch):
    root, landing = f"{scratch}/store", f"{scratch}/landing"
    store.init_store(spark, root)
    empty = api.status_document(spark, root).first()
    assert (empty.status, empty.last_run_id, empty.recent_runs, empty.recent_results, empty.recent_commands) == ("empty", None, [], [], [])
    assert empty.config == ["interval_seconds=3600", "max_pages=5", "page_size=50", "paused=false", "queries=[]"]
    write_text(f"{landing}/query=q/a.jsonl", [body([1])])
    api.update_config(spark, root, {"queries": ["q"], "max_pages": 2}, command_id="c1", clock=CLOCK)
    api.pause(spark, root, command_id="c2", clock=CLOCK)
    api.run_once(spark, root, command_id="c3", clock=CLOCK)
    api.worker_tick(spark, root, landing, run_id="r", clock=CLOCK)
    used = api.status_document(spark, root, limit=2).first()
    assert (used.status, used.last_run_id, used.recent_runs, used.recent_results) == ("success", "r", ["r"], [0])
    assert used.recent_commands == ["c3", "c2"] and "max_pages=2" in used.config and "paused=true" in used.config
    plan = api.status_document(spark, root)._jdf.queryExecution().executedPlan().toString()
    for log in ("run_events", "run_results", "command_events", "config_events"):
        assert plan.count(f"/{log}]") <= 1
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan


def test_exit_codes():
    assert [Q.exit_code_of(e) for e in (None, SCH.CollectorError("x"), SCH.UpstreamSchemaOrTemporaryError("x"), KeyError("x"))] == [0, 30, 30, 40]
    assert Q.exit_code_of(SCH.I.RecordValidationError("x")) == 30
