import math
import random

import numpy as np
import pytest

from pathloom.llm import toxicity as T
from tests.llm.rows import DOCS, documents

SF = "/root/testdata/sf0.1"


def corpus(n, seed):
    """Texts with the mark of those that hold words of an insulting stem, inflected at will."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        words = [f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}{rnd.randint(0, 60)}" for _ in range(rnd.choice([3, 30, 300]))]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(rnd.randint(1, 6)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["Zorgl", "zorgl", "wumpf"]) + rnd.choice(["", "en", "ich", f"{rnd.randint(0, 999)}"]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_thresholds_are_ordered_and_probabilities_whole():
    rows = [np.unique([f for w in set(T.words_of(t)) for f in T.features_of(w)]).astype(np.int32) for _, t, _ in corpus(800, 1)]
    toxic = np.array([y for _, _, y in corpus(800, 1)])
    grades = T.grade(rows, toxic)
    assert set(grades[toxic == 0]) == {0} and grades[toxic == 1].min() == 1 and grades.max() == 3
    m = T.fit(rows, grades)
    assert (np.diff(m.thresholds) > 0).all() and len(m.thresholds) == 3
    p = m.probabilities(np.linspace(-5, 30, 50))
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()
    assert (np.diff(p @ np.arange(4)) >= 0).all()  # severity rises with the score


def test_held_out_accuracy_on_inflected_stems(spark):
    train, test = corpus(1500, 2), corpus(600, 3)
    rows = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model = T.train(rows.drop("toxic"), rows.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in T.score(spark.createDataFrame([x[:2] for x in test], "doc_id long, text string"), model).collect()}
    right = [got[i].is_toxic == bool(y) for i, _, y in test]
    assert np.mean(right) > 0.99
    mild = np.mean([got[i].expected_severity for i, _, y in test if not y])
    assert mild < 0.3 < 1.0 < np.mean([got[i].expected_severity for i, _, y in test if y])


def test_held_out_accuracy_on_the_corpus(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = T.train(docs, labels.where("doc_id % 4 <> 0"))
    r = T.score(docs.where("lang = 'en'").join(labels.where("doc_id % 4 = 0"), "doc_id"), model).select("toxic", "is_toxic").collect()
    toxic, clean = [x.is_toxic for x in r if x.toxic], [x.is_toxic for x in r if not x.toxic]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01


@pytest.mark.parametrize("marks", [[], [0], [1], [0, 1]])
def test_too_few_labels(spark, marks):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(marks)] + [(None, 1, 0), (4, None, 0)], "doc_id long, toxic int, is_toxic int")
    out = T.score(docs, T.train(docs, labels)).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(DOCS, key=repr)
    assert all(not r.is_toxic and r.n_words == 0 for r in out if not (r.text or "").strip())


def test_whole_texts_and_empty_tables(spark):
    rows = corpus(600, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    late = spark.createDataFrame([(1, "bal1 " * 50_000 + "zorgl wumpf"), (2, "bal1 " * 50_000)], "doc_id long, text string")
    assert {r.doc_id: r.is_toxic for r in T.score(late, model).collect()} == {1: True, 2: False}
    assert T.score(late.limit(0), model).collect() == []
    again = T.train(df.drop("toxic").repartition(9), df.select("doc_id", "toxic").union(df.select("doc_id", "toxic")))
    assert np.array_equal(again.index, model.index) and np.allclose(again.weights, model.weights)


def test_a_bounded_sample_is_enough(spark):
    df = spark.createDataFrame(corpus(1200, 5), "doc_id long, text string, toxic int")
    rows, toxic = T.training_rows(df.drop("toxic"), df.select("doc_id", "toxic"), 100)
    assert len(rows) == len(toxic) == 100


def test_fit_is_the_top_of_the_plain_likelihood():
    rows = [np.unique([f for w in set(T.words_of(t)) for f in T.features_of(w)]).astype(np.int32) for _, t, _ in corpus(500, 5)]
    grades = T.grade(rows, np.array([y for _, _, y in corpus(500, 5)]))
    m = T.fit(rows, grades, steps=4000)
    place = {f: k for k, f in enumerate(m.index.tolist())}
    columns = [[place[f] for f in r.tolist() if f in place] for r in rows]
    weight = {True: 0.5 / (grades > 0).sum(), False: 0.5 / (grades == 0).sum()}

    def likelihood(w, cuts):
        """Mean log probability of the grades, clean and toxic rows counting alike, less the penalty of the weights."""
        total = -0.5e-3 * sum(x * x for x in w)
        for c, g in zip(columns, grades.tolist(), strict=True):
            x = sum(w[k] for k in c)
            upto = [0.0, *(1 / (1 + math.exp(x - t)) for t in cuts), 1.0]
            total += weight[g > 0] * math.log(max(upto[g + 1] - upto[g], 1e-12))
        return total

    w, cuts = m.weights.tolist(), m.thresholds.tolist()
    top = likelihood(w, cuts)
    rnd = random.Random(2)
    for size in (0.3, 0.1, 0.03):
        for _ in range(20):
            moved = sorted(t + rnd.gauss(0, size) for t in cuts)
            assert likelihood([x + rnd.gauss(0, size) for x in w], moved) <= top + 1e-4
            assert likelihood(w, moved) <= top + 1e-4
