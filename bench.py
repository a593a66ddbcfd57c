"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed once to warm up and then timed over
$BENCH_REPEATS runs (median) through the ``noop`` sink, which runs the whole
plan without collecting rows to the driver. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from recordlake.plans.catalog import CATALOG  # noqa: E402
from recordlake.session import build_session  # noqa: E402

HEADLINE = (
    "summary", "skill_frequency", "budget_distribution", "jobs_list_filtered", "search_both", "recent",
    "get_one", "validate_reasons", "ingest_skill_frequency", "two_batch_first_wins", "normalize_records",
    "envelope_audit", "response_class", "attempt_rollup", "redacted_text", "run_current_state",
    "command_state", "config_seeded", "config_after_commands", "status_document", "stream_insert_if_new",
)


def store_reads(spark, sf_dir: str, repeats: int, times: dict[str, float]) -> None:
    import datetime as dt

    from recordlake import api
    from recordlake.operators import ingest
    from recordlake.session import scratch_dir
    from recordlake.sources import adapters, store

    root = scratch_dir(spark, "bench-store")
    lines = adapters.write_raw_records(spark, adapters.table(spark, sf_dir, "documents"), f"{root}/landing")
    ingest.ingest_jsonl(spark, f"{root}/store", lines, 1, clock=dt.datetime(2024, 1, 1, tzinfo=dt.UTC),
                        mode="quarantine")
    store.init_store(spark, f"{root}/store")
    st = f"{root}/store"
    some_id = ingest.read_jobs(spark, st).select("job_id").first()["job_id"]
    reads = {
        "store_recent": lambda: api.recent(spark, st, limit=20),
        "store_search": lambda: api.search(spark, st, title="the", skill="en", limit=20),
        "store_get": lambda: api.get(spark, st, some_id),
        "store_summary": lambda: api.analytics(spark, st, "summary"),
        "store_skills": lambda: api.analytics(spark, st, "skills"),
        "store_budgets": lambda: api.analytics(spark, st, "budgets"),
    }
    for name, build in reads.items():
        build().write.format("noop").mode("overwrite").save()
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8), app="recordlake-bench")
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        fn = CATALOG[name]
        try:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
            runs = []
            for _ in range(repeats):
                t0 = time.perf_counter()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - t0)
            times[name] = round(statistics.median(runs), 3)
        except Exception as exc:  # noqa: BLE001 - report and keep measuring the rest
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    # Store reads: ingest the raw JSON lines once (untimed setup), then time the
    # user-facing reads on the resulting Parquet store.
    if os.environ.get("BENCH_STORE", "1") == "1":
        try:
            store_reads(spark, sf_dir, repeats, times)
        except Exception as exc:  # noqa: BLE001
            errors["store_setup"] = f"{type(exc).__name__}: {str(exc)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf, "cpus": cpus, "spark": spark.version,
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
