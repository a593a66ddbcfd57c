"""The pipeline's stages against brute force, and the registered queries."""

import corpus_pipeline as C
import pytest
from llm_helpers import jaccard, roots, shingles, words

import __spark_entry__ as E
from recordlake.llm import packing, quality_classifier, quality_rules, queries
from recordlake.session import scratch_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = queries.table(spark, SF, "documents")
    out, root = [docs], scratch_dir(spark, "test-pipeline")
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{root}/{k}")
        out.append(spark.read.parquet(f"{root}/{k}"))
    return out


def test_stages_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert [n for n, _ in C.STAGES] == ["quality classifier", "quality rules", "MinHash near-dedup", "substring dedup", "best-fit packing"]


def test_classifier_and_rules_decide_row_by_row(spark, stages):
    docs, first, second = stages[:3]
    model = quality_classifier.train(docs, queries.table(spark, SF, "labels").where(queries.crc_fold() != 0))
    scores = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert {r.doc_id for r in first.collect()} == {i for i, s in scores.items() if s >= C.THRESHOLD}
    kept = {r.doc_id for r in quality_rules.judge(first).collect() if r.kept}
    assert sorted(map(tuple, second.collect())) == sorted(tuple(r) for r in first.collect() if r.doc_id in kept)


def test_one_of_each_near_duplicate_group_stays(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[2:4])
    sets = {i: shingles(words(r.text)) for i, r in before.items()}
    linked = [(i, j) for i in sets for j in sets if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = {i for i, r in roots(list(sets), linked).items() if r == i}
    assert after == {i: before[i] for i in want}


def test_no_long_passage_is_left_twice(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[3:5])
    seen = {}
    for i in sorted(after):
        w = words(after[i].text)
        assert after[i].n_chars == len(after[i].text)
        for k in range(len(w) - 49):
            assert seen.setdefault(tuple(w[k:k + 50]), i) == i
    for i, r in before.items():
        if i not in after or after[i].text != r.text:  # what goes has a like passage in an earlier document
            mine = shingles(words(r.text))
            assert any(len(mine & shingles(words(before[j].text))) >= 30 for j in before if j < i)


def test_packing_takes_all_that_is_left(stages):
    left, packed = stages[4], stages[5].toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in left.collect()}
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert packed.sequence_id.nunique() >= packing.lower_bound(packed.length.value_counts().to_dict(), 1024)


def test_run_is_the_stages_one_after_another(spark, stages):
    key = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert key(C.run(spark, SF)) == key(stages[-1])


def test_every_operator_is_registered():
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert set(queries.ORACLE) <= set(names)


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, SF)
        cursor = con.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(map(str, got.select(*columns).collect())) == sorted(
            str(got.select(*columns)._jdf and __import__("pyspark").sql.Row(*columns)(*r)) for r in cursor.fetchall()), name


def test_jaccard_helper():
    assert jaccard({1, 2}, {2, 3}) == pytest.approx(1 / 3)
