"""Source divergence (12): against exact brute force over all kept terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import AWKWARD

from recordlake.llm import source_divergence as D

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least):
    """(lang, source, part, item) -> (value, rank) with Python's integers."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = {}
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= least]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}

        def p(count, below):
            return 1 + 10**9 * (count + 2) // (below + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pair = {o: sum(f(p(n[lang, s][t], total[s]), p(n[lang, o][t], total[o])) for t in kept) for o in sources - {s}}
            mine = {t: (p(n[lang, s][t], total[s]), p(whole[t], sum(total.values()))) for t in kept if n[lang, s][t]}
            term = {t: f(a, b) for t, (a, b) in mine.items() if a > b}
            for part, found, top in (("pair", pair, None), ("term", term, 10)):
                for rank, (item, value) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:top], 1):
                    out[lang, s, part, item] = (value, rank)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", 3) for i, (lang, s, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, term string, n long")


def rows_of(df):
    got = df.collect()
    out = {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in got}
    assert len(out) == len(got)
    return out


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("da", "Né", "ßo", "日本", "zz") for b in "abcdefghij"]
    rows = [(rng.choice(["en", "de", None, "", "xx"]), rng.choice(["a", "b", "é", "", None, "z9"]),
             " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for _ in range(400)]
    return rows + [("en", "odd", t) for t in AWKWARD] + [("alone", "one", "a b c"), ("few", "a", "rare"), ("few", "b", None),
                                                         ("few", "c", "other words")] + [("en", "a", "dup dup")] * 12


def test_audit_is_brute_force(spark, sample):
    assert rows_of(D.audit(frame(spark, sample))) == brute(sample, 10)


def test_buckets_and_full_dictionaries_change_nothing(spark, sample, monkeypatch):
    monkeypatch.setattr(D, "BUCKET_TERMS", 7)
    monkeypatch.setattr(D, "TASK_TERMS", 20)
    assert rows_of(D.audit(frame(spark, sample), least_documents=3)) == brute(sample, 3)


def test_empty_table_and_nothing_kept(spark, sample):
    assert D.audit(frame(spark, [("en", "a", "x")]).where("false")).collect() == []
    assert rows_of(D.audit(frame(spark, [("en", "a", "x"), ("en", "b", "y"), (None, None, None)]))) == {
        ("en", "a", "pair", "b"): (0, 1), ("en", "b", "pair", "a"): (0, 1)}


def test_galloping_finds_what_is_common():
    rng = np.random.default_rng(6)
    for na, nb, span in [(0, 5, 9), (1, 1, 1), (40, 4000, 5000), (600, 600, 700), (300, 9000, 100_000), (1000, 1000, 10**6)]:
        for _ in range(5):
            a, b = (np.sort(rng.choice(span, min(n, span), replace=False)) for n in (na, nb))
            i, j = D.galloping(a, b)
            assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_prices_are_exact_for_large_counts(spark):
    below = 3 * 10**13
    counts = np.array([0, 1, 10**9, 2 * 10**12, below // 2], np.int64)
    want = [1 + 10**9 * (int(c) + 2) // below for c in counts]
    assert D._probabilities(counts, below).tolist() == want
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(int(c),) for c in counts], "c long").select(
        D.probability(F.col("c"), F.lit(below - 10).cast("long"), F.lit(5)).alias("p")).collect()
    assert [r.p for r in got] == want


def test_terms_of_long_texts_are_whole(monkeypatch):
    text = "Ab" * 50 + " c1d é" * 30
    whole = [t for part in D.terms_of(text.encode()) for t in part]
    monkeypatch.setattr(D, "BLOCK_BYTES", 7)
    assert [t for part in D.terms_of(text.encode()) for t in part] == whole
    assert [t.decode() for t in whole] == TERM.findall(text.translate(LOWER))
