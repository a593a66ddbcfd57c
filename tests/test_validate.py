import json

import pytest
from pyspark.sql import functions as F

from recordlake.operators.ingest import stage_lines
from recordlake.operators.validate import first_failure, validate
from recordlake.schemas import PRIVATE_FIELD_NAMES
from recordlake.sources import jsonl
from recordlake.sources.jsonl import place_lines, read_lines, scan_lines
from tests.conftest import write_text

GOOD = {"source": "feed", "id": "~01abc", "title": "  Python scraper ", "description": "Build it",
        "url": "https://jobs.example/jobs/~01abc", "skills": ["Python", " web  Scraping ", "PYTHON", "  "],
        "hourly_min": 10, "fixed_amount": None, "raw_id": "123"}


def _check(spark, payloads):
    lines = [(i + 1, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(lines, "line_no long, line string")
    return validate(df).orderBy("line_no").collect()


def test_valid_record_is_typed_and_canonical(spark):
    r = _check(spark, [GOOD])[0]
    assert r.status == "valid" and r.reason is None
    assert r.job_id == "~01abc" and r.title == "Python scraper"
    assert r.skills == ["python", "web scraping"]
    assert r.hourly_min == 10.0 and r.fixed_amount is None and r.raw_id == "123"
    assert len(r.content_hash) == 64


@pytest.mark.parametrize("name", PRIVATE_FIELD_NAMES)
def test_private_fields_rejected(spark, name):
    variants = [name, name.upper(), f" {name} "]
    rows = _check(spark, [{**GOOD, v: "x"} for v in variants])
    for v, r in zip(variants, rows):
        assert r.reason == f"collector payload contains disallowed private field: {v}"


def test_check_order_and_messages(spark):
    cases = [
        ("[1]", "JSONL line must contain a JSON object"),
        ({**GOOD, "zz": 1, "aa": 2}, "collector payload contains unsupported fields: aa, zz"),
        ({k: v for k, v in GOOD.items() if k != "source"}, "record missing required collector field: source"),
        ({**GOOD, "source": "other"}, "collector field source must be 'feed'"),
        ({**GOOD, "id": 5}, "record missing required collector field: id"),
        ({**GOOD, "title": "  "}, "record missing required collector field: title"),
        ({**GOOD, "skills": "python"}, "record missing required collector field: skills"),
        ({**GOOD, "skills": ["a", 1]}, "collector field must be list[string]: skills"),
        ({**GOOD, "job_type": 3}, "collector field must be string or null: job_type"),
        ({**GOOD, "hourly_min": "10"}, "collector field must be numeric or null: hourly_min"),
        ({**GOOD, "hourly_max": True}, "collector field must be numeric or null: hourly_max"),
        ({**GOOD, "raw_id": 7}, "collector field must be string or null: raw_id"),
        ({**GOOD, "source": " feed "}, None),
    ]
    rows = _check(spark, [c for c, _ in cases])
    for (payload, want), r in zip(cases, rows):
        assert r.reason == want, payload


def test_line_numbers_count_blanks_across_files(spark, scratch):
    write_text(f"{scratch}/in/a.jsonl", [json.dumps(GOOD), "", "   ", "{bad"])
    write_text(f"{scratch}/in/b.jsonl", [json.dumps({**GOOD, "id": "2"}), json.dumps({**GOOD, "title": ""})])
    checked = validate(read_lines(spark, f"{scratch}/in"))
    rows = {r.line_no: (r.status, r.message) for r in checked.collect()}
    assert rows[2][0] == rows[3][0] == "blank"
    assert rows[4] == ("malformed", "malformed JSONL at line 4")
    assert rows[6] == ("invalid", "invalid collector record at line 6: record missing required collector field: title")
    stats = first_failure(checked).first()
    assert stats.first_error == "malformed JSONL at line 4" and stats.seen == 2


def test_line_numbers_exact_over_many_splits(spark, scratch):
    n = 20000
    lines = [("" if i % 97 == 0 else json.dumps({"i": i})) for i in range(n)]
    write_text(f"{scratch}/big/x.jsonl", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = read_lines(spark, f"{scratch}/big").where(F.col("line") != "")
        bad = got.where(F.get_json_object("line", "$.i").cast("long") + 1 != F.col("line_no")).count()
        assert bad == 0 and got.count() == n - len(range(0, n, 97))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_numbers_exact_over_many_files_and_splits(spark, scratch):
    n_files, per = 3, 4000
    for f in range(n_files):
        write_text(f"{scratch}/multi/part-{f}.jsonl", [json.dumps({"i": f * per + j}) for j in range(per)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = read_lines(spark, f"{scratch}/multi")
        bad = got.where(F.get_json_object("line", "$.i").cast("long") + 1 != F.col("line_no")).count()
        assert bad == 0 and got.count() == n_files * per
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_staged_lines_are_numbered_without_their_text(spark, scratch):
    n_files, per = 3, 4000
    for f in range(n_files):
        write_text(f"{scratch}/staged/part-{f}.jsonl",
                   [("" if (f * per + j) % 97 == 0 else "{bad" if j % 1000 == 7 else json.dumps({**GOOD, "id": str(f * per + j)}))
                    for j in range(per)])
    want = {r.line_no: (r.status, r.job_id, r.message) for r in validate(read_lines(spark, f"{scratch}/staged")).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        checked = validate(place_lines(scan_lines(spark, f"{scratch}/staged")))
        assert checked._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
        got = stage_lines(spark, checked, f"{scratch}/stage", ["status", "reason", "job_id"])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for f in range(n_files):  # the text is not read again
        write_text(f"{scratch}/staged/part-{f}.jsonl", ["{other"])
    rows = got.collect()
    assert len(rows) == n_files * per
    assert {r.line_no: (r.status, r.job_id, r.message) for r in rows} == want
    assert spark.read.parquet(f"{scratch}/stage/splits").count() > n_files


def test_staged_lines_beyond_the_broadcast_bound_and_of_no_lines(spark, scratch, monkeypatch):
    write_text(f"{scratch}/few/a.jsonl", [json.dumps(GOOD), "", "{bad"])
    monkeypatch.setattr(jsonl, "MAX_BROADCAST_SPLITS", 0)
    got = stage_lines(spark, validate(place_lines(scan_lines(spark, f"{scratch}/few"))), f"{scratch}/stage-few", ["status", "reason"])
    assert [(r.line_no, r.status) for r in got.orderBy("line_no").collect()] == [(1, "valid"), (2, "blank"), (3, "malformed")]
    for k, cond in enumerate((F.lit(False), F.col("line") == "no such line")):
        placed = place_lines(scan_lines(spark, f"{scratch}/few")).where(cond)
        assert stage_lines(spark, validate(placed), f"{scratch}/stage-none{k}", ["status", "reason"]).count() == 0


def test_exact_casefold_option(spark):
    payload = {**GOOD, "skills": ["Straße", " STRASSE ", "Σίσυφος"]}
    df = spark.createDataFrame([(1, json.dumps(payload))], "line_no long, line string")
    default = validate(df).first().skills
    exact = validate(df, exact_casefold=True).first().skills
    assert default == ["straße", "strasse", "σίσυφος"]
    assert exact == ["strasse", "σίσυφοσ"]


def test_exact_casefold_private_key(spark):
    df = spark.createDataFrame([(1, json.dumps({**GOOD, "ſession": "x"}))], "line_no long, line string")
    assert validate(df).first().reason == "collector payload contains unsupported fields: ſession"
    assert validate(df, exact_casefold=True).first().reason == (
        "collector payload contains disallowed private field: ſession")


def test_strip_is_pythons_and_looks_at_the_ends_only(spark):
    from recordlake.functions.text import py_strip, py_strip_column

    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    texts = ["", " ", "a", "a b", "​", "x\x00", "﻿é", "é ", "~", "~\x7f", "".join(spaces), None]
    texts += [f"{c}é{c}a {c}b!{c}" for c in spaces] + [f"{c}ü{c}\n" for c in spaces] + [f"b{c}" for c in spaces]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r.i: (r.a, r.b) for r in df.select("i", py_strip("s").alias("a"), py_strip_column("s").alias("b")).collect()}
    assert got == {i: (s.strip(), s.strip()) if s is not None else (None, None) for i, s in enumerate(texts)}
    assert "regexp_replace" not in df.select(py_strip("s"))._jdf.queryExecution().optimizedPlan().toString()


def test_required_texts_are_read_from_a_line_once(spark):
    """Check and record share one read of each required text (its type and its value)."""
    lines = spark.createDataFrame([(1, "{}")], "line_no long, line string")
    checked = validate(lines).select("status", "title", "description")
    plan = checked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.title") == 2 and plan.count("$.description") == 2
