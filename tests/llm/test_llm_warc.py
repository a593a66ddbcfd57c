"""WARC archives (9): round trip, revisits, framing, damage."""

import gzip
import hashlib
import zlib

import pytest

from recordlake.llm import warc
from recordlake.session import scratch_dir

SCHEMA = "page_id long, url string, html string, payload string, value int"


def rows():
    big = "ü" * 200
    return [(1, "http://a/ b?q=ä\r\nX: y", big, "x", 1), (2, None, big, "x", 1), (3, "http://c", None, "x", 1), (4, "http://d", "", "x", 1),
            (5, "http://e", "short", "x", 1), (6, "http://f", "short", "x", 1), (7, "u", "\r\n\r\nWARC/1.1\r\n\x00\xff" * 50, "x", 1),
            (None, "http://n", big, "x", 1), (2, "again", big, "x", 1), (9, "v", "L" * 300_000, "x", 1)]


@pytest.fixture()
def archive(spark):
    return f"{scratch_dir(spark, 'test')}/warc"


@pytest.mark.parametrize("segment", [8 << 20, 1000])
def test_round_trip(spark, archive, monkeypatch, segment):
    source = rows()
    if segment == 1000:  # segments are the writer's choice; run it here
        monkeypatch.setattr(warc, "SEGMENT", segment)
        made = b"".join(m for i, u, t, *_ in source[:1] + source[9:] for m in warc.page_members(
            str(i), u, t.encode(), hashlib.sha256(t.encode()).hexdigest(), None, "2024-01-01T00:00:00Z"))
        got = list(warc.pages(made[a:a + 77] for a in range(0, len(made), 77)))
        assert [(int(g[0]), g[6].decode()) for g in got] == [(1, source[0][2]), (9, source[9][2])]
        assert got[0][1] == source[0][1]
        return
    warc.write_archives(spark.createDataFrame(source, SCHEMA).repartition(3), archive)
    got = sorted(warc.read_archives(spark, archive).collect(), key=lambda r: (r.id or "", r.uri or ""))
    assert len(got) == len(source)
    for r in got:
        match = [s for s in source if (str(s[0]) if s[0] is not None else None) == r.id and s[1] == r.uri][0]
        payload = (match[2] or "").encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha256(payload).hexdigest()
        revisit = len(payload) == 400 and r.id != "1"
        assert (r.record_type, r.refers_to) == (("revisit", "1") if revisit else ("response", None))
        assert (r.payload is None) if revisit else bytes(r.payload) == payload


def test_files_are_gzip_members(spark, archive):
    warc.write_archives(spark.createDataFrame(rows(), SCHEMA).coalesce(1), archive)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(archive).collect()]
    text = b"".join(gzip.decompress(f) for f in files if f)
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows())


def test_damage_is_an_error():
    payload = b"x" * 500
    made = b"".join(warc.page_members("1", "u", payload, hashlib.sha256(payload).hexdigest(), None, "d"))
    assert len(list(warc.pages(iter([made])))) == 1
    with pytest.raises(ValueError):
        list(warc.pages(iter([made[:-20]])))
    with pytest.raises(zlib.error):
        list(warc.pages(iter([made[:30] + b"\x00\x00" + made[32:]])))
    wrong = b"".join(warc.page_members("1", "u", payload, "0" * 64, None, "d"))
    with pytest.raises(ValueError):
        list(warc.pages(iter([wrong])))


def test_empty_table(spark, archive):
    warc.write_archives(spark.createDataFrame([], SCHEMA), archive)
    assert warc.read_archives(spark, archive).count() == 0


def test_segments_stay_in_order_when_the_sort_spills(spark, archive):
    """Pages of three segments between short ones; the writer's sort spills after every other row."""
    made = [(i, "abcdefghij"[i] * 20_000_000 if i in (2, 5) else f"short {i}") for i in range(8)]
    df = spark.createDataFrame(made, "page_id long, html string").selectExpr("*", "cast(page_id as string) as url").coalesce(1)
    conf, name = spark._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(name, "2")
    try:
        warc.write_archives(df, archive)
    finally:
        conf.remove(name)
    got = warc.read_archives(spark, archive).selectExpr("cast(id as int) as id", "cast(payload as string) as html").collect()
    assert sorted((r.id, r.html) for r in got) == made
