import hashlib
import math
from collections import Counter

import numpy as np

from broodline.llm import fingerprint as fp

from .conftest import prose


def brute_classes(data, w=fp.W):
    out = []
    for i in range(len(data) - w + 1):
        load = sum(int(fp._f[c]) for c in Counter(data[i : i + w]).values())
        out.append(fp.CLASSES - 1 - load * (fp.CLASSES - 1) // int(fp._f[w]))
    return out


def brute_features(data, rank, w=fp.W, need=fp.POINTS):
    """Every run of w windows gives its rarest one a point."""
    classes = brute_classes(data, w)
    run = min(w, len(classes))
    points = Counter(min(range(i, i + run), key=lambda j: (rank[classes[j]], j)) for i in range(len(classes) - run + 1))
    need = min(need, len(classes) - run + 1)
    return sorted(j for j, n in points.items() if n >= need and classes[j] >= fp.CLASSES // 10)


def test_windows_and_features_match_brute_force():
    for text in [prose(1, 60), "ab" * 100, prose(2, 12), "x" * 64, "é" * 40 + prose(3, 20)]:
        data = text.encode()
        classes = fp.entropy_classes(np.frombuffer(data, np.uint8))
        assert classes.tolist() == brute_classes(data)
        rank = fp.ranks_of(fp.class_counts([data]))
        places = brute_features(data, rank)
        want = fp._features_of(np.frombuffer(data, np.uint8), classes, rank)
        assert len(want) == len(places)
        small = fp.entropy_classes(np.frombuffer(data, np.uint8), fp.SHORT)
        assert small.tolist() == brute_classes(data, fp.SHORT)
        rank = fp.ranks_of(fp.class_counts([data], fp.SHORT))
        want = fp._features_of(np.frombuffer(data, np.uint8), small, rank, fp.SHORT, fp.SHORT_POINTS)
        assert len(want) == len(brute_features(data, rank, fp.SHORT, fp.SHORT_POINTS))


def test_short_texts_are_like_their_edited_texts(spark):
    """Also texts of a few words; texts that an edit takes across a bound; texts of one byte."""
    sizes = [6, 8, 10, 15, 30, 60, 90, 120, 160, 200]
    rows = [(i, prose(i, sizes[i % len(sizes)])) for i in range(200)]
    got = {r.doc_id: r for r in fp.compare_with_successor(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    long_enough = [i for i, t in rows if len(t) >= 64]
    assert min(got[i].near_edited for i in long_enough) > 0.1 and np.mean([got[i].near_edited for i in long_enough]) > 0.6
    assert np.mean([got[i].near_next for i in long_enough]) < 0.15
    odd = [(1, "x" * 300), (2, "y" * 300), (3, ""), (4, ""), (5, "ab")]
    got = {r.doc_id: r for r in fp.compare_with_successor(spark.createDataFrame(odd, "doc_id long, text string")).collect()}
    assert got[1].near_next < 0.1 and got[2].near_next == 0.0 and got[3].near_next == 1.0 and got[4].near_next == 0.0


def test_a_very_long_text(spark):
    text = prose(77, 150_000)
    rows = [(1, text), (2, prose(78, 50))]
    got = {r.doc_id: r for r in fp.compare_with_successor(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_chars == len(text) > 1_000_000 and got[1].near_edited > 0.9


def test_parts_and_joined_texts_agree(monkeypatch):
    texts = [prose(i, n).encode() for i, n in enumerate([5, 500, 0, 40, 3000, 1])]
    whole = [fp.entropy_classes(np.frombuffer(t, np.uint8)) for t in texts]
    monkeypatch.setattr(fp, "PART", 1000)
    assert all((a == b).all() for a, b in zip(whole, fp.classes_of(texts)))
    assert (fp.class_counts(texts) == np.bincount(np.concatenate(whole), minlength=fp.CLASSES)).all()


def test_chains_hold_their_limit_and_survive_writing():
    filters = fp.chain(np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert len(filters) == math.ceil(1000 / fp.LIMIT)
    assert (fp.read(fp.written(filters)) == filters).all()
    assert fp.likeness(filters, filters) == 1.0 and fp.likeness(filters, filters[:0]) == 0.0
    other = fp.chain(np.arange(5000, 6000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert fp.likeness(filters, other) < 0.15


def expected(rows, rank):
    ordered = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(text) // 4
        changed = text[: len(text) - cut] + after[:cut]
        own, edit, following = fp.chains([text.encode(), changed.encode(), after.encode()], rank)
        yield (i, len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.written(own), fp.written(edit),
               fp.likeness(own, edit), fp.likeness(own, following))


def test_successors_over_parts(docs, texts, clashing, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    rank = fp.class_ranks(docs)
    want = sorted(expected(rows, rank))
    assert sorted(map(tuple, fp.compare_with_successor(docs).collect())) == want
    assert sorted(map(tuple, fp.compare_with_successor(clashing).collect())) == want
    assert fp.compare_with_successor(empty).count() == 0


def test_single_document_follows_itself(spark):
    df = spark.createDataFrame([(5, prose(1, 100))], "doc_id long, text string")
    (row,) = map(tuple, fp.compare_with_successor(df).collect())
    assert row[0] == 5 and row[6] == 1.0


def test_edited_texts_are_nearer_than_other_texts(spark):
    df = spark.createDataFrame([(i, prose(i, 400)) for i in range(30)], "doc_id long, text string")
    got = fp.compare_with_successor(df).collect()
    assert min(r.near_edited for r in got) > max(r.near_next for r in got)
    assert fp.fingerprints(df, fp.class_ranks(df)).count() == 30
