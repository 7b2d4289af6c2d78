import random

import numpy as np
import pytest

from broodline.llm import toxicity

from .conftest import DOC_SCHEMA, prose


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        text, toxic = prose(i, 60), int(i % 6 == 0)
        if toxic:
            text += " " + " ".join(r.sample(["vilda", "gromp", "snark", "blurg"], r.randint(1, 4)))
        rows.append((i, text, None, None, None))
        if i % 3 != 1:
            labels.append((i, r.randint(0, 1), toxic if r.random() > 0.03 else 1 - toxic))
    labels += [(None, 1, 1), (2, None, None), (3, 1, 0), (3, 1, 0)]
    return (spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxic_documents_are_found_and_clean_ones_left(corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    assert {"vilda", "gromp", "snark", "blurg"} <= model.weights.keys()
    assert model.thresholds == tuple(sorted(model.thresholds)) 
    got = toxicity.severity(docs, model).collect()
    assert sum((r.p_toxic >= 0.5) == (r.doc_id % 6 == 0) for r in got) >= 0.99 * len(got)
    assert all(0 <= r.severity <= 3 for r in got)
    by_words = {n: [r.severity for r in got if len(toxicity.words_of(r.text) & model.weights.keys()) == n] for n in (0, 1, 4)}
    assert max(by_words[0]) < min(by_words[1]) and max(by_words[1]) < min(by_words[4])
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and abs(kept.count() - 500) <= 6


def test_texts_that_share_a_shingle_are_all_learned_from(spark):
    """Rows that have an extreme shingle in common but are no copies are not dropped."""
    r = random.Random(9)
    rows = [(i, f"common start {prose(i, 30)} {'vilda' if i % 4 == 0 else ''} same end") for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]  # copies of one text
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC_SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0 or i >= 1000)) for i, _ in rows], "doc_id long, quality int, toxic int")
    seen = []
    real, toxicity.fit = toxicity.fit, lambda rows, *a, **k: seen.append(len(rows)) or real(rows, *a, **k)
    try:
        toxicity.train(docs, labels)
    finally:
        toxicity.fit = real
    assert seen == [400]


def test_gradient_of_the_ordinal_loss():
    """The fitted weights of one word agree with a grid search of the loss."""
    r = random.Random(1)
    rows = [(r.choice([0, 0, 1, 2]) if w else r.choice([0, 0, 0, 1]), [0] if w else []) for w in [0, 1] * 300]
    w, theta = toxicity.fit(rows, 1, spread=1e9, steps=3000)

    def loss(weight, t0, t1):
        total = 0.0
        for g, words in rows:
            s = weight * len(words)
            cdf = [0.0, 1 / (1 + np.exp(s - t0)), 1 / (1 + np.exp(s - t1)), 1.0]
            total -= np.log(max(cdf[g + 1] - cdf[g], 1e-12))
        return total

    best = loss(w[0], *theta)
    for dw in (-0.05, 0.05):
        assert loss(w[0] + dw, *theta) > best
        assert loss(w[0], theta[0] + dw, theta[1]) > best
        assert loss(w[0], theta[0], theta[1] + dw) > best


def test_odd_inputs(docs, clashing, empty, corpus):
    _, labels = corpus
    nothing = toxicity.train(docs, labels.limit(0))
    assert {(r.severity, r.p_toxic) for r in toxicity.severity(docs, nothing).collect()} == {(0.0, 0.0)}
    assert toxicity.train(empty, labels).thresholds == ()
    few = toxicity.train(docs, docs.sparkSession.createDataFrame([(6, 1, 1), (9, 1, 0), (12, 0, 0)], "doc_id long, quality int, toxic int"))
    assert few.weights == {} and len({r.p_toxic for r in toxicity.severity(docs, few).collect()}) == 1
    model = toxicity.SeverityModel({"one": 3.0}, (1.0, 2.0))
    got = {r.doc_id: r.p_toxic for r in toxicity.severity(docs, model).collect()}
    assert got[4] == got[5] > 0.8 and got[1] == got[2] < 0.5
    assert toxicity.clean(clashing, model).columns == clashing.columns
    assert toxicity.severity(empty, model).count() == 0
