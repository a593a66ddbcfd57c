"""Language ID (4), quality rules (6), quality classifier (8)."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_helpers import AWKWARD, documents, prose, rng
from pyspark.sql import functions as F

from recordlake.llm import language_id, quality_classifier, quality_rules, queries

SF = "/root/testdata/sf0.01"


def substrings_automaton(model, name):
    return model.automata[model.names.index(name)]


def test_automaton_accepts_exactly_the_substrings():
    r = rng(3)
    text = [r.randrange(3) for _ in range(60)]
    moves = language_id.suffix_automaton(text, 4)
    whole = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for _ in range(500):
        probe = [r.randrange(4) for _ in range(r.randrange(1, 7))]
        state = 0
        for c in probe:
            state = moves[state, c] if state >= 0 else -1
        assert (state >= 0) == (tuple(probe) in whole)


def test_lanes_parse_as_the_plain_definition():
    r = rng(4)
    automaton = language_id.Automaton(language_id.suffix_automaton([r.randrange(5) for _ in range(400)], 7), 1.0)
    lanes = sorted(([r.randrange(7) for _ in range(r.randrange(1, 200))] for _ in range(50)), key=len, reverse=True)
    table = np.zeros((len(lanes[0]), 50), np.int32)
    for k, lane in enumerate(lanes):
        table[:len(lane), k] = lane
    got = language_id.phrases(automaton, table, np.array([len(x) for x in lanes]))
    assert got.tolist() == [language_id.phrases_plain(automaton, x) for x in lanes]


def test_language_of_held_out_documents(spark):
    got = queries.op4_language_id(spark, SF).join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").toPandas()
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() >= 0.97
    assert held.score.between(0, 1).all()


def test_language_edge_cases(spark):
    train = documents(spark, ["the cat sat on the mat " * 5, "ein hund lief durch den wald " * 5, None, "123"], [1, 2, 3, 4])
    train = train.withColumn("lang", F.expr("case doc_id when 1 then 'en' when 2 then 'de' when 3 then 'xx' else null end"))
    model = language_id.train(train)
    assert model.names == ("de", "en")
    texts = [*AWKWARD, "the mat", "DER HUND", "12 34!"]
    got = {r.doc_id: r for r in language_id.identify(documents(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= got[i].score <= 1
    assert (got[len(AWKWARD)].lang_pred, got[len(AWKWARD) + 1].lang_pred) == ("en", "de")
    assert language_id.identify(documents(spark, []).limit(0), model).count() == 0
    empty = language_id.train(train.limit(0))
    assert {r.lang_pred for r in language_id.identify(documents(spark, texts), empty).collect()} == {"und"}


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_rule_counts_against_plain_python(spark):
    r = rng(6)
    texts = AWKWARD[:-2] + ["the " * 3000] + [" ".join(prose(r, 30) * r.randrange(1, 4)) for _ in range(30)] + ["a b\na b\n\n a b\na b", "# | <x>\n" * 9]
    docs = documents(spark, texts)
    got = {x.doc_id: x for x in quality_rules.judge(docs).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        want = plain_counts(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (x.kept and x.base_failed)
    assert quality_rules.judge(docs.limit(0)).count() == 0
    assert quality_rules.accepted(docs).columns == docs.columns


def test_rules_verdict_and_accuracies(spark):
    got = quality_rules.judge(queries.table(spark, SF, "documents")).alias("j").join(
        queries.table(spark, SF, "labels").withColumnRenamed("quality", "label"), "doc_id").where("not base_failed").toPandas()
    assert got[got.label == 1].kept.mean() >= 0.99
    assert got[got.label == 0].kept.mean() <= 0.1
    plan = quality_rules.judge(queries.table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_expectation_maximisation_against_plain_python(spark):
    rows = [(1, -1, 0, 30), (1, 0, 1, 60), (-1, -1, 0, 20), (0, 0, 0, 5), (-1, 1, 1, 2)]
    names = ["a", "b", "c"]
    got = quality_rules.estimate(spark.createDataFrame(rows, "vote_a int, vote_b int, vote_c int, n long"), names, rounds=7, tolerance=0)
    accuracy = [0.85] * 3
    for _ in range(7):
        right, total = [0.0] * 3, [0.0] * 3
        for *votes, n in rows:
            p = 1 / (1 + np.exp(-sum(v * np.log(a / (1 - a)) for v, a in zip(votes, accuracy))))
            for k, v in enumerate(votes):
                if v:
                    right[k] += n * (p if v > 0 else 1 - p)
                    total[k] += n
        accuracy = [min(0.99, max(0.55, (x + 0.1 * t * 0.85) / (t * 1.1))) for x, t in zip(right, total)]
    assert np.allclose([got[k] for k in names], accuracy)


def test_trees_traverse_as_a_plain_walk():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality_classifier.fit(x, y, trees=20, depth=3)
    bins = model.bins(x)
    total = np.full(400, model.base)
    for i in range(400):
        for t in range(20):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(bins[i, model.feature[t, node]] > model.split[t, node])
            total[i] += model.leaf[t, node - 7]
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-total)))
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_features_do_not_depend_on_the_slice():
    column = pa.array([t for t in AWKWARD] + ["Some words. And more!\nA line"], pa.string())
    whole = quality_classifier.features(column)
    assert whole.shape == (len(column), quality_classifier.FEATURES) and np.isfinite(whole).all()
    assert np.allclose(whole, np.concatenate([quality_classifier.features(column.slice(i, 1)) for i in range(len(column))]))


def test_classifier_on_held_out_documents(spark):
    sf = SF.replace("0.01", "0.1")
    got = queries.op8_quality_classifier(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert len(got) > 400 and (got.predicted == got.quality).mean() >= 0.98 and got.score.between(0, 1).all()


def test_classifier_without_labels(spark):
    docs = documents(spark, AWKWARD)
    labels = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    assert {round(r.score, 6) for r in quality_classifier.score(docs, model).collect()} == {0.5}
    kept = quality_classifier.accepted(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == len(AWKWARD)
    assert quality_classifier.accepted(docs, model, 0.6).count() == 0
    one = quality_classifier.train(docs, spark.createDataFrame([(3, 1), (3, 0), (4, 1)], "doc_id long, quality int"))
    assert all(r.score > 0.5 for r in quality_classifier.score(docs, one).collect())
    assert quality_classifier.score(docs.limit(0), model).count() == 0
