import datetime as dt
import json

import pytest

from recordlake import api
from recordlake.sources import store as S
from tests.conftest import write_text

CLOCK = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)


def rec(i):
    return json.dumps({"source": "feed", "id": f"id{i}", "title": f"Job {i}", "description": "d", "url": f"u{i}",
                       "skills": ["python"]})


def _ready_store(spark, root):
    S.init_store(spark, root)


def test_not_ready_and_limit_checked_first(spark, scratch):
    with pytest.raises(ValueError):
        api.recent(spark, f"{scratch}/none", limit=0)
    with pytest.raises(api.NotReadyError) as e:
        api.recent(spark, f"{scratch}/none")
    assert e.value.to_dict()["reason"] == "db_missing"
    S.init_store(spark, f"{scratch}/partial", tables=False)
    with pytest.raises(api.NotReadyError) as e:
        api.recent(spark, f"{scratch}/partial")
    assert e.value.verdict["reason"] == "schema_missing"


def test_store_reads_and_controls(spark, scratch):
    root = f"{scratch}/store"
    write_text(f"{scratch}/in/a.jsonl", [rec(1), rec(2), rec(1)])
    api.ingest_jsonl(spark, root, f"{scratch}/in", clock=CLOCK)
    _ready_store(spark, root)
    assert sorted(r.job_id for r in api.recent(spark, root).collect()) == ["id1", "id2"]
    assert api.search(spark, root, skill="Python", limit=1).count() == 1
    assert api.get(spark, root, "id2").first().title == "Job 2"
    assert api.analytics(spark, root, "summary").first()["jobs"] == 2

    with pytest.raises(ValueError, match="max_pages must be a positive integer"):
        api.enqueue(spark, root, "update_config", {"updates": {"max_pages": 0}})
    out = api.enqueue(spark, root, "pause", command_id="c1", clock=CLOCK)
    assert out == {"ok": True, "command_id": "c1", "status": "queued"}
    assert api.command_status(spark, root, "c1").first().status == "queued"
    cfg = {r.key: r.value_json for r in api.config(spark, root).collect()}
    assert cfg["paused"] == "false" and cfg["max_pages"] == "5"
    status = api.run_status(spark, root)
    assert status["last_run"].count() == 0 and status["recent_commands"].first().command_id == "c1"


def test_worker_tick_runs_and_records_expected_failure(spark, scratch):
    root, landing = f"{scratch}/store", f"{scratch}/landing"
    _ready_store(spark, root)
    out = api.worker_tick(spark, root, landing, run_id="r1", clock=CLOCK)
    assert out["ran"] is True
    ev, res = api.SCH.read_runs(spark, root)
    row = res.first()
    assert row.status == "failed" and row.error_type == "CollectorError"


def test_collect_fixture_and_jsonl(spark, scratch):
    body = {"data": {"search": {"universalSearchNuxt": {"visitorJobSearchV1": {"results": [
        {"id": "9", "title": "T", "description": "D", "skills": ["A"]}]}}}}}
    write_text(f"{scratch}/fx/resp.json", json.dumps(body, indent=2).split("\n"))
    recs = api.collect_fixture(spark, f"{scratch}/fx")
    assert [r.id for r in recs.collect()] == ["~029"]
    write_text(f"{scratch}/bad/resp.json", [json.dumps({"errors": ["x"], "data": None})])
    with pytest.raises(api.SCH.UpstreamSchemaOrTemporaryError):
        api.collect_fixture(spark, f"{scratch}/bad")
    out = api.write_jsonl(recs, f"{scratch}/out")
    line = json.loads(spark.read.text(out).first()[0])
    assert line["id"] == "~029" and line["hourly_min"] is None and list(line)[0] == "source"


def test_drain_applies_queue_in_one_pass(spark, scratch):
    root, landing = f"{scratch}/store", f"{scratch}/landing"
    _ready_store(spark, root)
    api.enqueue(spark, root, "pause", command_id="c1", clock=CLOCK)
    api.enqueue(spark, root, "update_config", {"updates": {"max_pages": 3}}, command_id="c2", clock=CLOCK)
    from recordlake.schemas import COMMAND_EVENTS
    bad = (("c3", 5, CLOCK.replace(tzinfo=None), "queued", "update_config",
            json.dumps({"updates": {"bogus": 1}}), "mcp", None, None, None),)
    spark.createDataFrame(bad, COMMAND_EVENTS).write.mode("append").parquet(f"{root}/command_events")
    out = api.worker_tick(spark, root, landing, run_id="r1", clock=CLOCK)
    assert out["drained"] == 3 and out["ran"] is False
    st = {c: api.command_status(spark, root, c).first() for c in ("c1", "c2", "c3")}
    assert st["c1"].status == "applied" and st["c2"].status == "applied"
    assert st["c3"].status == "failed"
    cfg = {r.key: r.value_json for r in api.config(spark, root).collect()}
    assert cfg["paused"] == "true" and cfg["max_pages"] == "3"


def test_failed_run_stores_only_redacted_text(spark, scratch, monkeypatch):
    root = f"{scratch}/store"
    _ready_store(spark, root)

    def blocked(*_a, **_k):
        raise api.SCH.CollectorError("blocked token=secret")

    monkeypatch.setattr(api.SCH, "collect_query", blocked)
    api.SCH.run_collection(spark, root, f"{scratch}/landing", ["python", "scraping"], run_id="r9",
                           clock=CLOCK, raise_on_failure=False)
    from recordlake.schemas import RUN_EVENTS, RUN_RESULTS
    res = spark.read.schema(RUN_RESULTS).parquet(f"{root}/run_results").collect()
    ev = spark.read.schema(RUN_EVENTS).parquet(f"{root}/run_events").collect()
    stored = [r.redacted_error for r in res + ev if r.redacted_error]
    assert stored and all(m == "blocked token=<redacted>" for m in stored)
    ev_df, res_df = api.SCH.read_runs(spark, root)
    run = api.L.runs(ev_df, res_df).first()
    assert run.status == "failed" and run.query_count == 2 and len(res) == 1


def test_end_to_end_worker_flow(spark, scratch):
    """init → land pages → queue run_once + config → worker tick → reads and status."""
    from recordlake.sources import adapters

    root, landing = f"{scratch}/store", f"{scratch}/landing"
    S.init_store(spark, root)
    conv = adapters.table(spark, "/root/testdata/sf0.001", "conversations")
    adapters.write_responses(spark, conv, f"{landing}/query=python", faults=False)
    api.update_config(spark, root, {"queries": ["python"]}, command_id="c1", clock=CLOCK)
    api.pause(spark, root, command_id="c2", clock=CLOCK)
    api.run_once(spark, root, command_id="c3", clock=CLOCK)
    out = api.worker_tick(spark, root, landing, run_id="run-1", clock=CLOCK)
    assert out["drained"] == 3 and out["ran"] is True
    status = api.run_status(spark, root)
    last = status["last_run"].first()
    assert last.status == "success" and last.trigger == "mcp_run_once" and last.total_inserted > 0
    assert status["recent_results"].first().query == "python"
    page = api.recent(spark, root, limit=5).collect()
    assert len(page) == 5 and all(r.url.endswith(r.job_id) for r in page)
    cfg = {r.key: r.value_json for r in status["config"].collect()}
    assert cfg["paused"] == "true" and cfg["queries"] == '["python"]'
    again = api.worker_tick(spark, root, landing, run_id="run-2", clock=CLOCK)
    assert again["ran"] is False  # paused, nothing queued


def test_parse_queries_cli_form(spark):
    assert api.parse_queries(spark, " python , scraping,automation , ") == ["python", "scraping", "automation"]
    for bad in ("", ",", " , , "):
        with pytest.raises(ValueError):
            api.parse_queries(spark, bad)


def test_input_and_command_contracts(spark, scratch):
    from recordlake.sources.jsonl import InputPathError

    with pytest.raises(InputPathError, match="fixture path is missing or unreadable"):
        api.collect_fixture(spark, f"{scratch}/no-such-fixture.json")
    root = f"{scratch}/store"
    _ready_store(spark, root)
    with pytest.raises(ValueError, match="unsupported command type: reboot"):
        api.enqueue(spark, root, "reboot")
    with pytest.raises(ValueError, match="unsupported config keys: colour"):
        api.update_config(spark, root, {"colour": "red"})
    with pytest.raises(ValueError, match="limit must be <= 100"):
        api.analytics(spark, root, "jobs", limit=101)
    with pytest.raises(ValueError, match="unknown analytics query: nope"):
        api.analytics(spark, root, "nope")


def test_analytics_on_an_initialised_empty_store(spark, scratch):
    root = f"{scratch}/store"
    S.init_store(spark, root)
    assert api.analytics(spark, root, "summary").first().asDict() == {"jobs": 0, "skills": 0}
    for name in ("skills", "jobs", "budgets"):
        assert api.analytics(spark, root, name).collect() == []


def test_run_once_outcome_follows_its_run(spark, scratch):
    """Two queued runs that fail: each is run, and each is marked failed with its error."""
    root = f"{scratch}/store"
    S.init_store(spark, root)
    api.run_once(spark, root, command_id="c1", clock=CLOCK)
    api.run_once(spark, root, command_id="c2", clock=CLOCK)
    api.pause(spark, root, command_id="c3", clock=CLOCK)
    out = api.worker_tick(spark, root, f"{scratch}/nothing", run_id="r", clock=CLOCK)
    assert out["run_once"] == 2 and out["ran"] is True
    for c in ("c1", "c2"):
        row = api.command_status(spark, root, c).first()
        assert (row.status, row.error_type, row.redacted_error) == ("failed", "CollectorError", "live collection returned zero jobs")
    ev, res = api.SCH.read_runs(spark, root)
    assert sorted(r.run_id for r in res.collect()) == ["r", "r-1"]


def test_bare_update_payload(spark, scratch):
    root = f"{scratch}/store"
    S.init_store(spark, root)
    api.enqueue(spark, root, "update_config", {"max_pages": 3, "paused": True}, command_id="c1", clock=CLOCK)
    with pytest.raises(ValueError, match="unsupported config keys: a, b"):
        api.enqueue(spark, root, "update_config", {"b": 1, "max_pages": 0, "a": 1})
    with pytest.raises(ValueError, match="max_pages must be a positive integer"):
        api.enqueue(spark, root, "update_config", {"max_pages": 0})
    api.worker_tick(spark, root, f"{scratch}/nothing", clock=CLOCK)
    cfg = {r.key: r.value_json for r in api.config(spark, root).collect()}
    assert cfg["max_pages"] == "3" and cfg["paused"] == "true"
    assert api.command_status(spark, root, "c1").first().status == "applied"


def test_unexpected_failure_is_recorded_and_raised(spark, scratch, monkeypatch):
    root = f"{scratch}/store"
    S.init_store(spark, root)

    def broken(*_a, **_k):
        raise TypeError("boom token=abc")

    monkeypatch.setattr(api.SCH, "collect_query", broken)
    with pytest.raises(TypeError):
        api.SCH.run_collection(spark, root, f"{scratch}/x", ["q"], run_id="r1", clock=CLOCK, raise_on_failure=False)
    ev, res = api.SCH.read_runs(spark, root)
    assert api.L.runs(ev, res).first().status == "failed"
    row = res.first()
    assert (row.status, row.error_type, row.error_text) == ("failed", "TypeError", "boom token=<redacted>")


def test_page_limits_and_attempts(spark, scratch):
    root, landing = f"{scratch}/store", f"{scratch}/landing"
    S.init_store(spark, root)

    def page(k):
        rows = [{"id": str(k * 10 + j), "title": "T", "description": "D"} for j in range(4)]
        return json.dumps({"data": {"search": {"universalSearchNuxt": {"visitorJobSearchV1": {"results": rows}}}}})

    write_text(f"{landing}/query=q/p.jsonl", [page(1), "", page(2), page(3)])
    attempts = spark.createDataFrame([("q", 3), ("other", 9)], "query string, attempts long")
    res = api.SCH.run_collection(spark, root, landing, ["q"], run_id="r1", clock=CLOCK, max_pages=2, page_size=3,
                                 attempts=attempts).first()
    assert (res.seen_count, res.attempts) == (6, 3)
    assert {r.raw_id for r in api.recent(spark, root, limit=50).collect()} == {"10", "11", "12", "20", "21", "22"}


def test_a_store_keeps_its_folding(spark, scratch):
    root = f"{scratch}/store"
    S.init_store(spark, root)
    line = json.dumps({"source": "feed", "id": "1", "title": "T", "description": "D", "url": "u", "skills": ["Straße"]})
    write_text(f"{scratch}/a/x.jsonl", [line])
    write_text(f"{scratch}/b/x.jsonl", [line.replace('"1"', '"2"').replace("Straße", "STRASSE")])
    api.ingest_jsonl(spark, root, f"{scratch}/a", exact_casefold=True)
    api.ingest_jsonl(spark, root, f"{scratch}/b")
    for skill in ("Straße", "strasse", "STRASSE"):
        assert sorted(r.job_id for r in api.search(spark, root, skill=skill).collect()) == ["1", "2"]
    with pytest.raises(ValueError, match="exact_casefold=True"):
        api.ingest_jsonl(spark, root, f"{scratch}/a", exact_casefold=False)


def _land(folder, query, ids):
    rows = [{"id": str(i), "title": "T", "description": "D"} for i in ids]
    body = json.dumps({"data": {"search": {"universalSearchNuxt": {"visitorJobSearchV1": {"results": rows}}}}})
    write_text(f"{folder}/query={query}/p.jsonl", [body])


def test_drain_is_first_in_first_out(spark, scratch):
    """A run sees the updates queued before it and none queued after it; every command was running."""
    root, landing = f"{scratch}/store", f"{scratch}/landing"
    S.init_store(spark, root)
    for k, q in enumerate(("early", "later")):
        _land(landing, q, [k * 10 + 1])
    api.update_config(spark, root, {"queries": ["early"]}, command_id="c1", clock=CLOCK)
    api.run_once(spark, root, command_id="c2", clock=CLOCK)
    api.enqueue(spark, root, "update_config", {"queries": ["later"]}, command_id="c3", clock=CLOCK)
    api.run_once(spark, root, command_id="c4", clock=CLOCK)
    api.pause(spark, root, command_id="c5", clock=CLOCK)
    out = api.worker_tick(spark, root, landing, run_id="r", clock=CLOCK)
    assert (out["drained"], out["run_once"], out["runs"]) == (5, 2, ["r", "r-1"])
    _, res = api.SCH.read_runs(spark, root)
    assert {(r.run_id, r.query) for r in res.collect()} == {("r", "early"), ("r-1", "later")}
    rows = {r.command_id: r for r in api._commands(spark, root).collect()}
    assert all(r.status == "applied" and r.started_at and r.finished_at for r in rows.values())
    config = {c: json.loads(rows[c].result_json)["config"] for c in ("c1", "c3", "c5")}
    assert [config[c]["queries"] for c in ("c1", "c3", "c5")] == [["early"], ["later"], ["later"]]
    assert [config[c]["paused"] for c in ("c1", "c3", "c5")] == [False, False, True] and config["c1"]["page_size"] == 50
    assert json.loads(rows["c2"].result_json) == {"run_id": "r"}


def test_interval_run_follows_the_commands(spark, scratch):
    root, landing = f"{scratch}/store", f"{scratch}/landing"
    S.init_store(spark, root)
    _land(landing, "q", [1])
    api.update_config(spark, root, {"queries": ["q"]}, command_id="c1", clock=CLOCK)
    api.run_once(spark, root, command_id="c2", clock=CLOCK)
    assert api.worker_tick(spark, root, landing, run_id="r", clock=CLOCK)["runs"] == ["r", "r-1"]
    ev, res = api.SCH.read_runs(spark, root)
    assert {r.run_id: r.trigger for r in api.L.runs(ev, res).collect()} == {"r": "mcp_run_once", "r-1": "worker_interval"}


def test_unexpected_error_of_a_command_does_not_stop_the_drain(spark, scratch, monkeypatch):
    root = f"{scratch}/store"
    S.init_store(spark, root)
    api.run_once(spark, root, command_id="c1", clock=CLOCK)
    api.pause(spark, root, command_id="c2", clock=CLOCK)

    def broken(*_a, **_k):
        raise TypeError("boom token=abc")

    monkeypatch.setattr(api.SCH, "collect_query", broken)
    out = api.worker_tick(spark, root, f"{scratch}/x", run_id="r", clock=CLOCK)
    assert out["drained"] == 2 and out["config"]["paused"] is True
    row = api.command_status(spark, root, "c1").first()
    assert (row.status, row.error_type, row.redacted_error) == ("failed", "TypeError", "boom token=<redacted>")
    assert api.command_status(spark, root, "c2").first().status == "applied"


def test_command_of_a_dead_worker_is_drained_again(spark, scratch, monkeypatch):
    root, landing = f"{scratch}/store", f"{scratch}/landing"
    S.init_store(spark, root)
    _land(landing, "__all__", [1, 2])
    api.run_once(spark, root, command_id="c1", clock=CLOCK)
    api.pause(spark, root, command_id="c2", clock=CLOCK)

    def die(*_a, **_k):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(api.SCH, "run_collection", die)
        with pytest.raises(KeyboardInterrupt):
            api.worker_tick(spark, root, landing, run_id="dead", clock=CLOCK)
    first = {r.command_id: r.status for r in api._commands(spark, root).collect()}
    assert first == {"c1": "running", "c2": "queued"}
    later = CLOCK + __import__("datetime").timedelta(hours=1)
    out = api.worker_tick(spark, root, landing, run_id="alive", clock=later)
    rows = {r.command_id: r for r in api._commands(spark, root).collect()}
    assert out["drained"] == 2 and {r.status for r in rows.values()} == {"applied"}
    assert rows["c1"].started_at < rows["c1"].finished_at and json.loads(rows["c1"].result_json) == {"run_id": "alive"}
    assert api.recent(spark, root).count() == 2


def test_readiness_stores_ingest_one_landing(spark, monkeypatch):
    """The raw lines are landed once for the four stores that ingest them."""
    from recordlake.plans.catalog import CATALOG
    from recordlake.sources import adapters
    from tests.conftest import SF

    landed, write = [], adapters.write_raw_records
    monkeypatch.setattr(adapters, "write_raw_records", lambda *a, **k: landed.append(a) or write(*a, **k))
    rows = {r.store: r.reason for r in CATALOG["readiness_verdict"](spark, SF).collect()}
    assert len(landed) == 1
    assert rows == {"unseeded": "config_empty", "missing": "db_missing", "partial": "schema_missing", "full": "ready", "newer": "unsupported_schema"}
