"""Embedding (1), passage (2) and document (3) near-duplicates against brute force."""

import numpy as np
import pytest
from llm_helpers import AWKWARD, documents, jaccard, prose, rng, roots, shingles, words
from pyspark.sql import functions as F

from recordlake.llm import embedding_dedup, groups, minhash_forest, substring_dedup
from recordlake.llm.components import connected_components


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(1, 2), (2, 3), (3, 1), (9, 9), (None, 4), (7, 120)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = [(a, b) for a, b in edges if a is not None and a != b]
    want = roots({x for p in pairs for x in p}, pairs)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_grouped_sees_whole_groups(spark):
    import pyarrow as pa

    def work(table, starts):
        k = table.column("k").to_numpy()
        return pa.table({"k": k[starts[:-1]], "n": np.diff(starts)})

    df = spark.range(20_000).select((F.col("id") % 7).alias("k"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.k: r.n for r in groups.grouped(df, ["k"], work, "k long, n long").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {k: len(range(k, 20_000, 7)) for k in range(7)}


def vectors():
    r = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        for _ in range(40):
            base = r.normal(size=24)
            rows += [(base + r.normal(size=24) * s, label) for s in (0, 0.1, 0.22, 0.3)]
    hot = r.normal(size=24)
    rows += [(hot, 1)] * 60 + [(hot + r.normal(size=24) * 0.05, 1) for _ in range(900)] + [(hot, 0), (hot, None), (hot * 7, 1)]
    out = [(i, [float(np.float32(x)) for x in v], y) for i, (v, y) in enumerate(rows)]
    n = len(out)
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    return out + [(n + k, v, 1) for k, v in enumerate(odd)]


def test_embeddings_against_all_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, n long, kept string").repartition(7)
    usable = {}
    for i, v, y in rows:
        if y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.setdefault((y, len(v)), []).append((i, np.array(v)))
    linked = []
    for own in usable.values():
        ids, x = [i for i, _ in own], np.stack([v for _, v in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        cos = x @ x.T
        assert not ((np.abs(cos - 0.93) < 1e-9).any())
        linked += [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(cos >= 0.93, 1)))]
    want = roots([i for i, _, _ in rows], linked)
    degree = dict.fromkeys(want, 0)
    for a, b in linked:
        degree[a] += 1
        degree[b] += 1
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    missed = sum(abs(got[i].n_links - degree[i]) for i in want)
    assert all(got[i].n_links <= degree[i] for i in want) and missed <= 0.002 * sum(degree.values())
    assert sum(got[i].component_id != want[i] for i in want) <= 2
    assert all(got[i].kept == (got[i].component_id == i) for i in want)


@pytest.mark.parametrize("words_per_block", [128, 512])
def test_recall_of_filters_at_the_threshold(words_per_block):
    r = np.random.default_rng(8)
    x = r.normal(size=(150, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93 ** 2) * y
    filters = embedding_dedup.choose(64, words_per_block)
    pairs = zip(embedding_dedup.listed(x, filters), embedding_dedup.listed(y, filters))
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in pairs]) >= 0.97


def test_embeddings_null_ids_repeats_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (6, [2.0, 0.0], 1)]
    got = sorted(((r.vec_id, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()),
                 key=str)
    assert got == [(5, 5, True), (5, 5, True), (6, 5, False), (None, None, True)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_repeated_unusable_embeddings_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [0.0, -0.0], [None, 1.0], [nan, 1.0], [inf, 1.0], [-inf, 1.0]]
    rows = [(i, v, 1) for i, v in enumerate(odd * 3)] + [(100, [1.0, 2.0], 1), (101, [1.0, 2.0], 1)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
        assert got == {i: (0, i, True) for i in range(len(odd) * 3)} | {100: (1, 100, True), 101: (1, 100, False)}


def near_copies(seed=5):
    r = rng(seed)
    base = prose(r, 120)

    def edited(b, k):
        b = list(b)
        for _ in range(k):
            b[r.randrange(len(b))] = f"x{r.randrange(10 ** 6)}"
        return b

    out = [" ".join(edited(base, r.choice([0, 1, 2, 3, 4]))) for _ in range(500)]
    other = edited(base, 5)
    out += [" ".join(edited(other, r.choice([0, 1, 2, 3]))) for _ in range(120)]
    out += [" ".join(prose(r, r.randrange(0, 60), 10 ** 6)) for _ in range(150)]
    out += ["one two three", "ONE  two\nthree", "one two", "a b c d e", "a b c d e f"]
    r.shuffle(out)
    return out + AWKWARD


@pytest.mark.parametrize("percent", [80, 85])
def test_documents_against_all_pairs(spark, percent):
    texts = near_copies()
    sets = [shingles(words(t)) for t in texts]
    linked = [(i, j) for i, s in enumerate(sets) for j in range(i) if s and sets[j]
              and 100 * len(s & sets[j]) >= percent * len(s | sets[j])]
    want = roots(range(len(texts)), linked)
    got = {r.doc_id: r for r in minhash_forest.near_duplicates(documents(spark, texts).repartition(6), percent=percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_one_of_each_group_stays(spark):
    texts = ["a b c d e f g", "a b c d e f g", "other words here", "other words here", None, ""]
    docs = documents(spark, texts, [4, 2, 9, 9, None, 7])
    found = minhash_forest.near_duplicates(docs)
    left = minhash_forest.first_of_each(docs, found)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None) == [
        (2, "a b c d e f g"), (7, ""), (9, "other words here")]
    assert left.where("doc_id is null").count() == 1
    assert minhash_forest.near_duplicates(docs.limit(0)).count() == 0


def passages_corpus():
    r = rng(9)
    shared = [prose(r, n) for n in (55, 70, 120, 49)]
    line = prose(r, 13)
    out = []
    for k in range(90):
        w = prose(r, r.randrange(60, 200), 10 ** 6)
        if k % 3 == 0:
            w = line + w
        if k % 2 == 0:
            p = list(shared[k % 4])
            if k % 10 == 0:
                p[len(p) // 2] = "edited"
            at = r.randrange(len(w))
            w[at:at] = p
        out.append(" ".join(w))
    return out + [out[4], out[4].upper(), " ".join(["to"] * 300), " ".join(prose(r, 40) * 4)] * 2 + AWKWARD


def test_passages_cover_all_exact_repeats(spark):
    texts = passages_corpus()
    docs = documents(spark, texts).repartition(5)
    rows = substring_dedup.repeated_passages(docs).collect()
    tokens = [words(t) for t in texts]
    covered = {}
    for r in rows:
        own, ref = tokens[r.id][r.start_word:r.end_word], tokens[r.ref][r.ref_start_word:r.ref_end_word]
        assert r.ref < r.id and len(own) == r.end_word - r.start_word >= 50
        assert jaccard(shingles(own), shingles(ref)) == pytest.approx(r.similarity) and r.similarity >= 0.8
        covered.setdefault(r.id, set()).update(range(r.start_word, r.end_word))
    seen = {}
    for i, w in enumerate(tokens):
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k:k + 50]), i) != i:
                assert covered.get(i, set()).issuperset(range(k, k + 50)), (i, k)
    # Nothing is reported of documents that share no shingle-rich passage.
    assert not any(r.id % 2 for r in rows if r.id < 90)


def test_removing_passages(spark):
    texts = passages_corpus()
    docs = documents(spark, texts).repartition(5)
    found = substring_dedup.repeated_passages(docs)
    rows = found.collect()
    left = {r.doc_id: r for r in substring_dedup.remove_passages(docs, found).collect()}
    assert len(left) == len(texts)
    for i, t in enumerate(texts):
        gone = {k for r in rows if r.id == i for k in range(r.start_word, r.end_word)}
        if not gone:
            assert left[i].text == t and left[i].kept == "score"
        else:
            assert words(left[i].text, False) == [w for k, w in enumerate(words(t, False)) if k not in gone]
    none = docs.limit(0)
    assert substring_dedup.repeated_passages(none).count() == 0
    assert substring_dedup.remove_passages(none, substring_dedup.repeated_passages(none)).columns == docs.columns


def test_passages_null_and_repeated_ids(spark):
    text = " ".join(prose(rng(2), 80))
    docs = documents(spark, [text, text, text, "short"], [3, 3, None, 1])
    assert substring_dedup.repeated_passages(docs).count() == 0
    docs = documents(spark, [text, text, text], [3, 3, 2])
    left = substring_dedup.remove_passages(docs, substring_dedup.repeated_passages(docs)).collect()
    assert sorted((r.doc_id, len(r.text)) for r in left) == [(2, len(text)), (3, 0), (3, 0)]


def test_compact_windows_are_the_cartesian_tree():
    r = np.random.default_rng(1)
    for n in (1, 5, 60, 300):
        for h in (r.permutation(n), r.integers(0, max(2, n // 6), n)):
            ties = len(np.unique(h)) < n
            found = set(zip(*substring_dedup.compact_windows(h, 3, ties)))
            for a in range(n):
                for z in range(a + 3, n + 1):  # each subsequence's min-hash is that of a window around it
                    assert any(b <= a and z <= e and h[c] == h[a:z].min() for b, e, c in found)
            assert len(found) <= n


def spans_by_brute_force(d, r, least, similarity):
    """Places of ``d`` in a span, from one equal token to another, whose set and that of the same span of ``r`` are alike."""
    covered = set()
    same = np.flatnonzero(d == r)
    for a in same:
        for z in same[same >= a + least - 1] + 1:
            if z - 1 not in covered or a not in covered:
                x, y = set(d[a:z].tolist()), set(r[a:z].tolist())
                if len(x & y) >= similarity * len(x | y):
                    covered.update(range(a, z))
    return covered


def test_alike_parts_of_edited_copies_against_all_spans():
    def shingled(w):
        return np.array([hash(tuple(w[i:i + 5])) & 0xFFFFFFFF for i in range(len(w) - 4)], np.uint32)

    r = rng(12)
    cases = [[20, 60, 100, 140, 180]] + [sorted(r.sample(range(200), r.randrange(3, 12))) for _ in range(40)]
    for edits in cases:
        base = prose(r, 200, 10 ** 6)
        copy = list(base)
        for k in edits:
            copy[k] = f"edit{k}"
        d, ref = shingled(copy), shingled(base)
        found = substring_dedup.passages(d, ref, 5, 46, 0.8)
        for a, z, ra, rz, alike in found:
            assert z - a >= 46 and alike >= 0.8
            assert jaccard(set(d[a:z].tolist()), set(ref[ra:rz].tolist())) == pytest.approx(alike)
        assert {k for a, z, *_ in found for k in range(a, z)} >= spans_by_brute_force(d, ref, 46, 0.8), edits


def test_passages_do_not_depend_on_partitions(spark):
    r = rng(31)
    shared = prose(r, 50, 10 ** 6)
    # The first document of the second partition holds all of the passage but a word.
    bodies = [shared, shared[:49], *[shared] * 30]
    texts = [" ".join([*prose(r, 60, 10 ** 6), *b, *prose(r, 60, 10 ** 6)]) for b in bodies]
    rows = list(enumerate(texts))
    short = [(100 + k, "short") for k in range(len(texts) - 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = spark.createDataFrame(spark.sparkContext.parallelize([rows[0], *short, *rows[1:]], 2), "doc_id long, text string")
    rows = [{tuple(x) for x in substring_dedup.repeated_passages(d).collect()} for d in (dealt, docs.repartition(9))]
    assert rows[0] == rows[1]
    assert {(x[0], x[4]) for x in rows[0]} >= {(i, 0) for i in range(2, 32)}


def test_regions_crowded_at_full_depth_compare_all_pairs(spark, scratch):
    # One region; its pivot (0) is like no other document, and 1-2, 3-4, ... are alike.
    r = np.random.default_rng(6)
    made = [r.bytes(64) for _ in range(201)]
    rows = [(i, made[(i + 1) // 2]) for i in range(401)]
    trees = spark.createDataFrame([(i, 1, 1, 1) for i, _ in rows], "id long, p4 long, p6 long, p8 long")
    sketches = spark.createDataFrame([(i, bytearray(s)) for i, s in rows], "id long, sketch binary")

    def kept(df, name):
        df.write.parquet(f"{scratch}/{name}")
        return spark.read.parquet(f"{scratch}/{name}")

    edges = minhash_forest._candidate_edges(trees, sketches, 80, kept).collect()
    assert {(min(e.a, e.b), max(e.a, e.b)) for e in edges} == {(i, i + 1) for i in range(1, 401, 2)}


def planted(spark, bodies_of, cases, seed, line=()):
    """Documents with bodies between random prose; ids rise within a case. Returns the ids reported, as (case, place)."""
    r, texts, places = rng(seed), [], []
    for case in range(cases):
        for place, body in enumerate(bodies_of(r)):
            places.append((case, place))
            texts.append(" ".join([*line, *prose(r, r.randrange(30, 90), 10 ** 7), *body, *prose(r, r.randrange(30, 90), 10 ** 7)]))
    found = substring_dedup.repeated_passages(documents(spark, texts).repartition(6)).collect()
    return {places[x.id] for x in found}, found, texts, places


@pytest.mark.parametrize("quotes", [[(0, 49)], [(0, 49), (3, 52)], [(0, 40), (12, 52), (5, 46), (1, 49), (2, 50)]])
def test_passages_behind_partial_quotes_are_found(spark, quotes):
    """Smaller documents quote parts of a passage that two later ones hold whole: the later one is always reported."""
    def bodies(r):
        whole = prose(r, 52, 10 ** 7)
        return [*(whole[a:z] for a, z in quotes), whole, whole]

    reported, *_ = planted(spark, bodies, 200, 41)
    assert sum((case, len(quotes) + 1) in reported for case in range(200)) == 200


def test_passages_behind_a_hot_line_are_found(spark):
    """All documents begin with one line of 30 words; pairs of them share a passage right after it."""
    def bodies(r):
        whole = prose(r, 55, 10 ** 7)
        return [whole, prose(r, 55, 10 ** 7), whole]

    reported, *_ = planted(spark, bodies, 150, 42, line=prose(rng(43), 30))
    assert {(case, 2) for case in range(150)} <= reported and not any(place < 2 for _, place in reported)


def test_edited_chains_behind_partial_quotes(spark):
    """Z is alike to Y, not to X, and all three have min-hashes in common; what is found is alike, and little is missed."""
    def edited(body, where):
        return [f"e{k}{body[k]}" if k in where else w for k, w in enumerate(body)]

    def bodies(r):
        whole = prose(r, 120, 10 ** 7)
        return [edited(whole, (20, 45, 70, 95)), whole, edited(whole, (r.randrange(10, 35), r.randrange(60, 110)))]

    reported, found, texts, places = planted(spark, bodies, 200, 44)
    for x in found:
        own, ref = (words(texts[i])[a:z] for i, a, z in ((x.id, x.start_word, x.end_word), (x.ref, x.ref_start_word, x.ref_end_word)))
        assert jaccard(shingles(own), shingles(ref)) >= 0.8 and places[x.id][0] == places[x.ref][0]
    assert sum((case, 2) in reported for case in range(200)) >= 194
