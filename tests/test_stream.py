import datetime as dt
import json

from recordlake.operators import ingest
from recordlake.streaming import ingest_stream as R
from tests.conftest import write_text

CLOCK = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)


def rec(i, title="t"):
    return json.dumps({"source": "feed", "id": f"id{i}", "title": title, "description": "d", "url": f"u{i}",
                       "skills": ["x"]})


def test_one_shot_runs_are_incremental_and_first_wins(spark, scratch):
    landing, store, ckpt = f"{scratch}/landing", f"{scratch}/store", f"{scratch}/ckpt"
    write_text(f"{landing}/a.jsonl", [rec(1, "first"), rec(2)])
    R.run_ingest_once(spark, landing, store, ckpt, clock=CLOCK)
    write_text(f"{landing}/b.jsonl", [rec(1, "late"), rec(3)])
    R.run_ingest_once(spark, landing, store, ckpt, clock=CLOCK)
    R.run_ingest_once(spark, landing, store, ckpt, clock=CLOCK)  # nothing new
    jobs = {r.job_id: (r.title, r.batch_id) for r in ingest.read_jobs(spark, store).collect()}
    assert jobs == {"id1": ("first", 1), "id2": ("t", 1), "id3": ("t", 2)}
    led = sorted((r.batch_id, r.seen, r.inserted, r.skipped) for r in ingest.ledger(spark, store).collect())
    assert led == [(1, 2, 2, 0), (2, 2, 1, 1)]


def test_strict_stream_records_failed_batch_and_continues(spark, scratch):
    landing, store, ckpt = f"{scratch}/landing", f"{scratch}/store", f"{scratch}/ckpt"
    write_text(f"{landing}/a.jsonl", [rec(1), "{broken token=abc"])
    R.run_ingest_once(spark, landing, store, ckpt, clock=CLOCK, mode="strict")
    write_text(f"{landing}/b.jsonl", [rec(2)])
    R.run_ingest_once(spark, landing, store, ckpt, clock=CLOCK, mode="strict")
    led = {r.batch_id: (r.status, r.error_type, r.redacted_error) for r in ingest.ledger(spark, store).collect()}
    assert led[1] == ("failed", "RecordValidationError", "malformed JSONL at line 2")
    assert led[2][0] == "success"
    assert [r.job_id for r in ingest.read_jobs(spark, store).collect()] == ["id2"]


def test_interval_trigger_picks_up_new_files(spark, scratch):
    """A recurring stream keeps ingesting files as they land."""
    landing, store, ckpt = f"{scratch}/landing", f"{scratch}/store", f"{scratch}/ckpt"
    write_text(f"{landing}/a.jsonl", [rec(1)])
    q = R.start_ingest_stream(spark, landing, store, ckpt, interval="1 second", clock=CLOCK)
    try:
        q.processAllAvailable()
        write_text(f"{landing}/b.jsonl", [rec(1, "dup"), rec(2)])
        q.processAllAvailable()
    finally:
        q.stop()
    jobs = {r.job_id: r.batch_id for r in ingest.read_jobs(spark, store).collect()}
    assert jobs == {"id1": 1, "id2": 2}


def test_fresh_checkpoint_on_a_filled_store_loses_nothing(spark, scratch):
    landing, store = f"{scratch}/landing", f"{scratch}/store"
    write_text(f"{scratch}/first/x.jsonl", [rec(i, "stored") for i in range(5)])
    ingest.ingest_jsonl(spark, store, f"{scratch}/first", clock=CLOCK)
    write_text(f"{landing}/a.jsonl", [rec(4, "late"), rec(9)])
    for checkpoint in ("c1", "c2"):  # the second stream sees the same file again
        R.run_ingest_once(spark, landing, store, f"{scratch}/{checkpoint}", clock=CLOCK)
    jobs = {r.job_id: (r.title, r.batch_id) for r in ingest.read_jobs(spark, store).collect()}
    assert jobs == {f"id{i}": ("stored", 1) for i in range(5)} | {"id9": ("t", 2)}
    led = sorted((r.batch_id, r.seen, r.inserted) for r in ingest.ledger(spark, store).collect())
    assert led == [(1, 5, 5), (2, 2, 1), (3, 2, 0)]


def test_a_replayed_epoch_is_skipped(spark, scratch):
    landing, store, ckpt = f"{scratch}/landing", f"{scratch}/store", f"{scratch}/ckpt"
    write_text(f"{landing}/a.jsonl", [rec(1)])
    R.run_ingest_once(spark, landing, store, ckpt, clock=CLOCK)
    row = ingest.ledger(spark, store).first()
    known = ingest.stream_batch(spark, store, R.stream_id(spark, ckpt), 0)
    assert (row.epoch, row.stream_id) == (0, R.stream_id(spark, ckpt)) and known.batch_id == 1
    from tests.conftest import local

    commits = local(f"{ckpt}/commits")
    import os

    for name in os.listdir(commits):  # the engine lost its commit mark: it delivers the epoch again
        os.remove(os.path.join(commits, name))
    R.run_ingest_once(spark, landing, store, ckpt, clock=CLOCK)
    assert ingest.ledger(spark, store).count() == 1 and ingest.read_jobs(spark, store).count() == 1


def test_lines_delivered_again_stay_out_of_the_batch(spark, scratch):
    """Later micro-batches drop lines seen of late; within one all copies stay, and first-wins goes by line."""
    landing, store, ckpt = f"{scratch}/landing", f"{scratch}/store", f"{scratch}/ckpt"

    def run():
        q = R.start_ingest_stream(spark, landing, store, ckpt, clock=CLOCK, dedupe_within="1 day")
        q.awaitTermination()
        return [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators][-1]

    write_text(f"{landing}/a.jsonl", [rec(1), rec(2, "late"), rec(1), "{broken"])
    assert run() == 4  # three texts and a file
    write_text(f"{landing}/b [x] c.jsonl", ["{broken", rec(3, "first"), rec(1), rec(3, "second"), rec(3, "first"), rec(2)])
    write_text(f"{landing}/c.jsonl", [rec(1), "{broken"])  # nothing new
    assert run() == 9  # three texts more, two files
    R.run_ingest_once(spark, landing, store, ckpt, clock=CLOCK, dedupe_within="1 day")  # nothing landed
    led = sorted((r.batch_id, r.seen, r.inserted, r.skipped, r.rejected) for r in ingest.ledger(spark, store).collect())
    assert led == [(1, 3, 2, 1, 1), (2, 4, 1, 3, 0)]
    jobs = {r.job_id: (r.title, r.ord) for r in ingest.read_jobs(spark, store).collect()}
    assert jobs == {"id1": ("t", 1), "id2": ("late", 2), "id3": ("first", 2)}


def test_state_of_lines_expires_and_strict_mode_is_refused(spark, scratch):
    import time

    import pytest

    landing, store, ckpt = f"{scratch}/landing", f"{scratch}/store", f"{scratch}/ckpt"
    with pytest.raises(ValueError):
        R.start_ingest_stream(spark, landing, store, ckpt, mode="strict", dedupe_within="1 day")
    for k in range(2):
        write_text(f"{landing}/{k}.jsonl", [rec(1)])
        R.run_ingest_once(spark, landing, store, ckpt, clock=CLOCK, dedupe_within="1 second")
        time.sleep(1.5)
    write_text(f"{landing}/2.jsonl", [rec(1), rec(4)])
    R.run_ingest_once(spark, landing, store, ckpt, clock=CLOCK, dedupe_within="1 second")
    # Whatever the state has forgotten by then, the store lets no key in twice.
    assert sorted(r.job_id for r in ingest.read_jobs(spark, store).collect()) == ["id1", "id4"]


def test_commands_of_all_writers_are_read(spark, scratch):
    from recordlake import api
    from recordlake.sources import store as S

    root, landing = f"{scratch}/store", f"{scratch}/commands"
    S.init_store(spark, root)
    api.pause(spark, root, command_id="queued-1", clock=CLOCK)
    write_text(f"{landing}/a.json", [json.dumps({"command_id": "stream-1", "seq": 1, "ts": "2024-03-01T00:00:00Z", "status": "queued",
                                                 "command_type": "resume", "payload_json": "{}", "requested_by": "mcp"})])
    R.start_command_stream(spark, landing, root, f"{scratch}/ckpt").awaitTermination()
    api.run_once(spark, root, command_id="queued-2", clock=CLOCK)
    assert {c: api.command_status(spark, root, c).first().status for c in ("queued-1", "stream-1", "queued-2")} == dict.fromkeys(
        ("queued-1", "stream-1", "queued-2"), "queued")


def test_replayed_command_epoch_is_written_once(spark, scratch):
    """Also after the log was compacted and the compacted files are gone."""
    from recordlake.operators import compaction as K
    from recordlake.schemas import COMMAND_EVENTS
    from recordlake.session import delete_path
    from recordlake.sources import store
    from recordlake.sources.snapshots import read_log

    root, landing, ckpt = f"{scratch}/store", f"{scratch}/cmd", f"{scratch}/ckpt"
    store.init_store(spark, root)
    event = {"command_id": "c1", "seq": 1, "ts": "2024-01-01T00:00:00Z", "status": "queued", "command_type": "pause"}
    write_text(f"{landing}/a.json", [json.dumps(event), json.dumps({**event, "command_id": "c2"})])

    def run(replay=False):
        if replay:
            for name in ("0", ".0.crc"):
                delete_path(spark, f"{ckpt}/commits/{name}")
        R.start_command_stream(spark, landing, root, ckpt).awaitTermination()
        return read_log(spark, root, "command_events", COMMAND_EVENTS).count()

    assert run() == 2 and run(replay=True) == 2
    for _ in range(2):
        K.compact(spark, root)
        K.vacuum(spark, root)
        assert run(replay=True) == 2


def test_a_large_command_epoch_is_a_set_of_files_read_whole_or_not_at_all(spark, scratch, monkeypatch):
    """No task writes the whole epoch; a set that a crash cut short is unread, and the replay puts it right."""
    from recordlake.operators import compaction as K
    from recordlake.schemas import COMMAND_EVENTS
    from recordlake.session import delete_path, list_files
    from recordlake.sources.snapshots import read_log

    root, landing, ckpt = f"{scratch}/store", f"{scratch}/cmd", f"{scratch}/ckpt"
    event = {"seq": 1, "ts": "2024-01-01T00:00:00Z", "status": "queued", "command_type": "pause"}
    for k in range(3):
        write_text(f"{landing}/{k}.json", [json.dumps({**event, "command_id": f"c{k}-{i}", "payload_json": "x" * 2000}) for i in range(50)])
    monkeypatch.setattr(R, "SMALL_EPOCH_BYTES", 0)
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")

    def run():
        for name in ("0", ".0.crc"):
            delete_path(spark, f"{ckpt}/commits/{name}")
        R.start_command_stream(spark, landing, root, ckpt).awaitTermination()
        return read_log(spark, root, "command_events", COMMAND_EVENTS).select("command_id").distinct().count()

    try:
        assert run() == 150
        files = list_files(spark, f"{root}/command_events")
        assert len(files) > 2 and run() == 150 and list_files(spark, f"{root}/command_events") == files
        delete_path(spark, f"{root}/command_events/{files[-1]}")  # as if the writer had died before its last file
        assert read_log(spark, root, "command_events", COMMAND_EVENTS).count() == 0
        assert run() == 150 and read_log(spark, root, "command_events", COMMAND_EVENTS).count() == 150
        K.compact(spark, root)
        K.vacuum(spark, root)
        assert list_files(spark, f"{root}/command_events") == [] and run() == 150
        assert read_log(spark, root, "command_events", COMMAND_EVENTS).count() == 150
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
