import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from recordlake.operators import ingest
from recordlake.operators.validate import RecordValidationError
from tests.conftest import write_text

CLOCK = dt.datetime(2024, 3, 1, 12, 0, 0, tzinfo=dt.UTC)


def rec(i, title="t", **kw):
    base = {"source": "feed", "id": f"id{i}", "title": title, "description": "d", "url": f"u/{i}",
            "skills": [f"S{i}", "common"]}
    base.update(kw)
    return json.dumps(base)


def test_first_write_wins_within_and_across_batches(spark, scratch):
    store = f"{scratch}/store"
    write_text(f"{scratch}/b1/x.jsonl", [rec(1, "first"), rec(2), rec(1, "second"), ""])
    write_text(f"{scratch}/b2/x.jsonl", [rec(2, "later"), rec(3)])
    l1 = ingest.ingest_jsonl(spark, store, f"{scratch}/b1", 1, clock=CLOCK).first()
    assert (l1.seen, l1.inserted, l1.skipped) == (3, 2, 1)
    l2 = ingest.ingest_jsonl(spark, store, f"{scratch}/b2", 2, clock=CLOCK).first()
    assert (l2.seen, l2.inserted, l2.skipped) == (2, 1, 1)
    jobs = {r.job_id: r for r in ingest.read_jobs(spark, store).collect()}
    assert jobs["id1"].title == "first" and jobs["id2"].title == "t" and jobs["id2"].batch_id == 1
    assert jobs["id1"].first_seen_at == dt.datetime(2024, 3, 1, 12, 0, 0)
    skills = ingest.read_job_skills(spark, store)
    assert skills.count() == 6
    assert skills.where(F.col("skill") == "common").count() == 3


def test_replay_is_idempotent(spark, scratch):
    store = f"{scratch}/store"
    write_text(f"{scratch}/b1/x.jsonl", [rec(1), rec(2)])
    write_text(f"{scratch}/b2/x.jsonl", [rec(2), rec(3)])
    ingest.ingest_jsonl(spark, store, f"{scratch}/b1", 1, clock=CLOCK)
    ingest.ingest_jsonl(spark, store, f"{scratch}/b2", 2, clock=CLOCK)
    before = sorted(tuple(r) for r in ingest.read_jobs(spark, store).select("job_id", "batch_id").collect())
    again = ingest.ingest_jsonl(spark, store, f"{scratch}/b1", 1, clock=CLOCK).first()
    after = sorted(tuple(r) for r in ingest.read_jobs(spark, store).select("job_id", "batch_id").collect())
    assert before == after and again.inserted == 2


def test_strict_mode_fails_closed(spark, scratch):
    store = f"{scratch}/store"
    write_text(f"{scratch}/b1/x.jsonl", [rec(1), "", json.dumps({"source": "feed"}), "{oops"])
    with pytest.raises(RecordValidationError, match="invalid collector record at line 3: record missing"):
        ingest.ingest_jsonl(spark, store, f"{scratch}/b1", 1, clock=CLOCK)
    assert ingest.read_jobs(spark, store) is None


def test_quarantine_mode_keeps_valid_lines(spark, scratch):
    store = f"{scratch}/store"
    write_text(f"{scratch}/b1/x.jsonl", [rec(1), "{oops", rec(2, private_token="x")])
    led = ingest.ingest_jsonl(spark, store, f"{scratch}/b1", 1, clock=CLOCK, mode="quarantine").first()
    assert (led.seen, led.inserted, led.rejected) == (1, 1, 2)


def test_missing_input_is_a_usage_error(spark, scratch):
    from recordlake.sources.jsonl import InputPathError

    with pytest.raises(InputPathError):
        ingest.ingest_jsonl(spark, f"{scratch}/store", f"{scratch}/nope.jsonl", 1)


def test_first_per_key_plan_is_partial_aggregate(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 0, "y"), ("b", 2, "z")], "job_id string, ord long, v string")
    out = ingest.first_per_key(df)
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0), ("b", 2)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "HashAggregate" in plan and "SortAggregate" not in plan


def test_hot_key_a_third_of_lines(spark, scratch):
    """One id on a third of all lines: first wins, counters exact, rejects readable."""
    lines = []
    for i in range(3000):
        lines.append(rec("hot", title=f"copy {i}") if i % 3 == 0 else rec(i))
    lines.append("{bad")
    write_text(f"{scratch}/in/x.jsonl", lines)
    led = ingest.ingest_jsonl(spark, f"{scratch}/store", f"{scratch}/in", 1, clock=CLOCK, mode="quarantine").first()
    assert (led.seen, led.inserted, led.skipped, led.rejected) == (3000, 2001, 999, 1)
    hot = ingest.read_jobs(spark, f"{scratch}/store").where(F.col("job_id") == "idhot").first()
    assert hot.title == "copy 0" and hot.ord == 1
    rej = ingest.read_rejects(spark, f"{scratch}/store").collect()
    assert [(r.line_no, r.status) for r in rej] == [(3001, "malformed")]


def test_store_reads_prune_batches_dynamically(spark, scratch):
    """Readers join the committed-batch ledger on the partition column: the jobs
    scan gets a dynamic partition-pruning filter instead of reading every batch."""
    store = f"{scratch}/store"
    for b in (1, 2):
        write_text(f"{scratch}/b{b}/x.jsonl", [rec(b * 10 + i) for i in range(3)])
        ingest.ingest_jsonl(spark, store, f"{scratch}/b{b}", b, clock=CLOCK)
    plan = ingest.read_jobs(spark, store)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert ingest.read_jobs(spark, store).count() == 6


def test_anti_join_broadcasts_only_within_its_bound(spark):
    cands = spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, ord long")
    store = spark.createDataFrame([("b",), ("c",)], "job_id string")
    small = ingest.new_only(cands, store, candidate_bytes=2)
    big = ingest.new_only(cands, store, candidate_bytes=ingest.MAX_BROADCAST_BYTES + 1)
    splan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in splan and "LeftSemi" in splan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        bplan = big._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in bplan and "BroadcastExchange" not in bplan
        assert [r.job_id for r in big.collect()] == ["a"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert [r.job_id for r in small.collect()] == ["a"]


def test_a_crashed_attempt_is_never_read(spark, scratch, monkeypatch):
    """The data of batch 2 is written, its ledger row is not: the next batch has that number
    and holds a duplicate only, and the dead attempt's record stays unread."""
    store = f"{scratch}/store"
    for b, lines in (("b1", [rec(1)]), ("b2", [rec(2)]), ("b3", [rec(1, "late")])):
        write_text(f"{scratch}/{b}/x.jsonl", lines)
    ingest.ingest_jsonl(spark, store, f"{scratch}/b1", clock=CLOCK)

    def crash(*_a):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ingest, "write_ledger_row", crash)
        with pytest.raises(RuntimeError):
            ingest.ingest_jsonl(spark, store, f"{scratch}/b2", clock=CLOCK)
    led = ingest.ingest_jsonl(spark, store, f"{scratch}/b3", clock=CLOCK).first()
    assert (led.batch_id, led.seen, led.inserted) == (2, 1, 0)
    assert [r.job_id for r in ingest.read_jobs(spark, store).collect()] == ["id1"]
    assert ingest.read_job_skills(spark, store).count() == 2


def test_a_committed_batch_is_never_overwritten(spark, scratch):
    store = f"{scratch}/store"
    write_text(f"{scratch}/b1/x.jsonl", [rec(1), rec(2, "first"), rec(2, "later")])
    write_text(f"{scratch}/other/x.jsonl", [rec(2, "later")])
    ingest.ingest_jsonl(spark, store, f"{scratch}/b1", 1, clock=CLOCK)
    with pytest.raises(ingest.BatchConflictError):
        ingest.ingest_jsonl(spark, store, f"{scratch}/other", 1, clock=CLOCK)
    with pytest.raises(ingest.BatchConflictError):
        ingest.record_failed_batch(spark, store, 1, ValueError("x"))
    assert {r.job_id: r.title for r in ingest.read_jobs(spark, store).collect()} == {"id1": "t", "id2": "first"}
    from recordlake.session import list_dirs

    assert list_dirs(spark, f"{store}/_staging") == []  # nothing of the input stays behind
