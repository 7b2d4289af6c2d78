import random

import numpy as np
import pytest

from broodline.llm import language_id as li

from .conftest import DOC_SCHEMA

SYLLABLES = {"aa": "ka to mi ru shi no ha".split(), "bb": "schl ung ber ein kei ach tz".split(),
             "cc": "ção lho nha que ism ado eir".split()}


def words(lang, seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    return [(i, words(lang, i, 40), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]


def test_letter_vectors_are_fixed_and_nearly_orthogonal():
    v = li.letter_vectors(np.array([97, 98, 99, 97])).astype(int)
    assert (v[0] == v[3]).all() and set(np.unique(v)) == {-1, 1}
    assert abs(v[0] @ v[1]) < 200


def test_bundles_match_the_definition():
    text = "abca b"
    codes, counts = li.trigrams(text)
    want = np.zeros(li.DIM)
    padded = f" {text} "
    letter = lambda c: li.letter_vectors(np.array([ord(c)]))[0].astype(int)
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        want += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    assert (li.bundles([(codes, counts)])[0] == want).all()


def test_held_out_accuracy(spark, rows):
    df = spark.createDataFrame([(*r, None, None) for r in rows], DOC_SCHEMA).repartition(5)
    profiles = li.train_on_documents(df)
    assert profiles.languages == sorted(SYLLABLES)
    got = li.identify(df, profiles).withColumn("held_out", li.held_out("doc_id")).where("held_out").collect()
    assert len(got) > 20
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_prototypes_do_not_depend_on_row_order(spark, rows):
    df = spark.createDataFrame([(*r, None, None) for r in rows], DOC_SCHEMA)
    a, b = li.train(df.repartition(2)), li.train(df.repartition(7))
    assert a.languages == b.languages and (a.prototypes == b.prototypes).all()


def test_odd_texts(docs, clashing, empty):
    profiles = li.train_on_documents(docs)
    got = {r.doc_id: r for r in li.identify(docs.select("doc_id", "text"), profiles).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3
    assert got[1].score == got[3].score == 0.0
    assert got[4].lang_pred in profiles.languages
    named = li.identify(clashing, profiles, "lang_pred", "score")
    assert named.columns == clashing.columns and named.count() == docs.count()
    nothing = li.train(empty)
    assert nothing.languages == [] and li.identify(empty, profiles).count() == 0
    assert {r.lang_pred for r in li.identify(docs, nothing).collect()} == {"und"}
