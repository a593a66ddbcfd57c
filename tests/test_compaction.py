"""Key index, compaction and vacuum of a store."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from recordlake import api
from recordlake.operators import compaction as K
from recordlake.operators import ingest as I
from recordlake.operators import keys as KEYS
from recordlake.session import list_files, path_exists
from recordlake.sources import snapshots, store
from tests.conftest import local, write_text

CLOCK = dt.datetime(2024, 5, 1, tzinfo=dt.UTC)


def rec(i, title="t"):
    return json.dumps({"source": "feed", "id": f"id{i}", "title": title, "description": "d", "url": f"u{i}", "skills": ["x", f"s{i % 3}"]})


def ingest(spark, root, name, lines, **kw):
    write_text(f"{root}-in/{name}/x.jsonl", lines)
    return I.ingest_jsonl(spark, root, f"{root}-in/{name}", clock=CLOCK, **kw).first()


def state(spark, root):
    """All that a reader sees."""
    def rows(df):
        return sorted(map(str, df.collect())) if df is not None else []

    return (rows(I.ledger(spark, root).select(*sorted(I.LEDGER.fieldNames()))), rows(I.read_jobs(spark, root).select(*sorted(I.STORE_JOBS.fieldNames()))),
            rows(I.read_job_skills(spark, root).select("job_id", "skill", "batch_id")), rows(I.read_rejects(spark, root)),
            rows(api._log(spark, root, "command_events", K.COMMAND_EVENTS)), rows(I.read_keys(spark, root).select("job_id", "bucket")))


def data_files(root):
    import os

    return [os.path.join(d, f) for d, _, names in os.walk(local(root)) for f in names
            if not f.startswith(("_", ".")) and "/_manifest" not in d]


@pytest.fixture()
def filled(spark, scratch):
    root = f"{scratch}/store"
    store.init_store(spark, root)
    ingest(spark, root, "a", [rec(i) for i in range(8)])
    ingest(spark, root, "b", [rec(i, "late") for i in range(5, 12)] + ["{broken"], mode="quarantine")
    I.record_failed_batch(spark, root, 3, ValueError("boom"), clock=CLOCK)
    api.run_once(spark, root, command_id="c1", clock=CLOCK)
    api.pause(spark, root, command_id="c2", clock=CLOCK)
    return root


def test_small_batch_reads_its_buckets_only(spark, scratch, monkeypatch):
    monkeypatch.setattr(KEYS, "FOLDER_BYTES", 1)  # as if the batch were large
    root = f"{scratch}/store"
    ingest(spark, root, "a", [rec(i) for i in range(1500)])
    ten = spark.createDataFrame([(f"id{i}",) for i in range(0, 1500, 150)], "job_id string")
    buckets = ten.agg(KEYS.touched_buckets("job_id").alias("b")).first()["b"]
    assert 1 <= len(buckets) <= 10
    keys = I.read_keys(spark, root, buckets)
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "lo#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0] and "In(bucket" in plan
    read = KEYS.in_buckets(I._table(spark, root, "job_keys", KEYS.STORE_KEYS), buckets).select(F.input_file_name().alias("f"))
    folders = {r.f.split("lo=")[1].split("/")[0] for r in read.collect()}
    assert folders == {str(b) for b in buckets}
    assert KEYS.folders_for(256) == KEYS.KEY_BUCKETS
    new = I.new_only(ten.unionByName(spark.createDataFrame([("new",)], "job_id string")),
                     I.read_keys(spark, root, KEYS.KEY_BUCKETS * [0]))
    assert [r.job_id for r in new.collect()] == ["new"]


def test_store_without_an_index_gets_one(spark, scratch):
    root = f"{scratch}/store"
    ingest(spark, root, "a", [rec(i) for i in range(6)])
    I.delete_path(spark, f"{root}/job_keys")
    row = ingest(spark, root, "b", [rec(i) for i in range(4, 9)])
    assert (row.seen, row.inserted, row.skipped) == (5, 3, 2)
    assert I.read_keys(spark, root).count() == 9


def test_compaction_changes_no_read(spark, filled):
    before = state(spark, filled)
    manifest = K.compact(spark, filled)
    assert manifest.generation == 1 and state(spark, filled) == before
    assert K.vacuum(spark, filled) > 0
    assert state(spark, filled) == before
    assert not path_exists(spark, f"{filled}/jobs/batch_id=1") and path_exists(spark, f"{filled}/batches/batch_id=3")
    assert store.readiness_verdict(spark, filled, check_config=False)["ok"]
    # The store goes on: duplicates are known, ids follow, the failed batch's number can be used again.
    row = ingest(spark, filled, "c", [rec(2, "again"), rec(50)])
    assert (row.batch_id, row.inserted, row.skipped) == (4, 1, 1)
    assert ingest(spark, filled, "a", [rec(i) for i in range(8)], batch_id=1).inserted == 8  # replay: no-op
    with pytest.raises(I.BatchConflictError):
        ingest(spark, filled, "d", [rec(77)], batch_id=1)
    after = state(spark, filled)
    K.compact(spark, filled)
    K.vacuum(spark, filled)
    assert state(spark, filled) == after and len(snapshots.current(spark, filled).segments) == 1


def test_crash_before_the_manifest(spark, filled, monkeypatch):
    before = state(spark, filled)

    def crash(*_a, **_k):
        raise KeyboardInterrupt

    monkeypatch.setattr(snapshots, "publish", crash)
    with pytest.raises(KeyboardInterrupt):
        K.compact(spark, filled)
    monkeypatch.undo()
    assert state(spark, filled) == before
    K.vacuum(spark, filled)
    assert state(spark, filled) == before
    K.compact(spark, filled)
    assert state(spark, filled) == before


def test_dead_attempts_go(spark, filled):
    from recordlake.operators.validate import validate
    from recordlake.sources.jsonl import read_lines

    checked = validate(read_lines(spark, f"{filled}-in/a")).withColumn("ord", F.col("line_no")).withColumn("job_id", F.concat("job_id", F.lit("x")))
    I.write_attempt(spark, filled, checked, 9, "dead", CLOCK)
    before = state(spark, filled)
    K.vacuum(spark, filled)
    assert state(spark, filled) == before and not path_exists(spark, f"{filled}/jobs/batch_id=9/attempt=dead")


def test_thousand_one_row_batches(spark, scratch):
    root = f"{scratch}/store"
    ids = spark.range(1, 1001).select(F.col("id").alias("batch_id"), F.lit("a").alias("attempt"), F.concat(F.lit("id"), "id").alias("job_id"))
    jobs = ids.select(*[(F.col(f.name) if f.name in ids.columns else F.lit("t" if f.nullable is False else None).cast(f.dataType)).alias(f.name)
                        if f.dataType.typeName() == "string" or f.name in ids.columns else F.lit(None).cast(f.dataType).alias(f.name)
                        for f in I.STORE_JOBS.fields])
    rows = ids.select(*[F.lit("success").alias("status") if f.name == "status" else F.col(f.name) if f.name in ids.columns
                        else F.lit(1 if f.name in ("seen", "inserted") else None).cast(f.dataType).alias(f.name) for f in I.LEDGER.fields])
    jobs.coalesce(4).write.partitionBy("batch_id", "attempt").parquet(f"{root}/jobs")
    rows.coalesce(4).write.partitionBy("batch_id").parquet(f"{root}/batches")
    assert len(data_files(root)) == 2000
    K.compact(spark, root)
    assert I.read_jobs(spark, root).count() == 1000 and I.read_keys(spark, root).count() == 1000
    K.vacuum(spark, root)
    assert len(data_files(root)) <= 10
    assert I.read_jobs(spark, root).count() == I.ledger(spark, root).count() == I.read_keys(spark, root).count() == 1000


def test_segments_are_tiered():
    segment = [snapshots.Segment(str(k), [], b) for k, b in enumerate((1000, 90, 10))]
    assert [s.name for s in K._taken(segment, 5)] == ["2"]
    assert [s.name for s in K._taken(segment, 30)] == ["2", "1"]
    assert [s.name for s in K._taken(segment, 500)] == ["2", "1", "0"]


def test_a_generation_is_published_once(spark, filled):
    K.compact(spark, filled)
    with pytest.raises(snapshots.ConcurrentCompactionError):
        snapshots.publish(spark, filled, snapshots.Manifest(1))
    assert list_files(spark, f"{filled}/_manifest") == ["000000000001.json"]
