"""MinHash near-dedup against brute force over all pairs of small tables."""

import itertools
import re

import numpy as np
import pytest

from broodline.llm import minhash
from broodline.llm.components import connected_components

from .conftest import prose


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def components(pairs, ids):
    comp = {i: i for i in ids}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        comp[b] = a
    return {i: top(i) for i in ids}


def brute(texts, width, percent=80):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(links, sets)
    return {(i, len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def rows(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_matches_brute_force(docs, texts, width):
    assert rows(minhash.near_duplicates(docs, width)) == brute(texts, width)


def test_clashing_columns_and_empty_tables(clashing, texts, empty):
    assert rows(minhash.near_duplicates(clashing, 2)) == brute(texts, 2)
    assert minhash.near_duplicates(empty, 2).count() == 0


def test_group_whose_links_do_not_all_pass_the_centre(spark):
    """A chain of edits: neighbours are links, the ends of the chain are not."""
    words = prose(5, 150).split()
    texts = {}
    for i in range(40):
        words = [*words]
        words[(7 * i) % 150] = f"edit{i}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert rows(minhash.near_duplicates(df, 2)) == brute(texts, 2)


@pytest.mark.parametrize("limits", [(4, 10**6), (4096, 150), (4096, 10**6)])
def test_blocks_give_every_link_once(spark, monkeypatch, limits):
    """Two components of near copies, dealt to several parts or one."""
    monkeypatch.setattr(minhash, "BLOCK", limits[0])
    monkeypatch.setattr(minhash, "ELEMENTS", limits[1])
    base = np.arange(1, 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows, sets = [], {}
    for i in range(14):
        h = np.unique(np.concatenate((base[: 96 - i % 5], minhash.shingle_hashes(f"only {i}", 2))))
        sets[i] = set(h.tolist())
        rows.append((i, i % 2, len(h), minhash.minhashes(h).tolist(), h.view(np.int64).tolist()))
    df = spark.createDataFrame(rows, "id long, comp long, size long, sig array<int>, shingles array<long>")
    got = sorted(tuple(sorted(r)) for r in minhash._links_in_blocks(df, 80).collect())
    want = sorted((a, b) for a, b in itertools.combinations(sets, 2) if a % 2 != b % 2
                  and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert got == want and want


def test_long_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (None, 3), (7, 7)], "u long, v long")
    got = {r.id: r.comp for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("bits", [1 << 25, 64])
def test_marks_miss_no_id(spark, monkeypatch, bits):
    monkeypatch.setattr(minhash, "MARKS", bits)
    df = spark.range(3000).withColumnRenamed("id", "_word")
    ids = spark.range(0, 3000, 7).union(spark.createDataFrame([(None,)], "id long"))
    got = {r[0] for r in minhash.likely(df, "_word", ids).collect()}
    assert set(range(0, 3000, 7)) <= got and (bits == 64 or len(got) < 450)
    assert minhash.likely(df, "_word", ids.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1 << 25, 64])
def test_deduplicated_keeps_one_of_each_group(docs, texts, monkeypatch, bits):
    monkeypatch.setattr(minhash, "MARKS", bits)
    got = minhash.deduplicated(docs, 5)
    assert got.columns == docs.columns
    ids = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    assert ids == sorted(i for i, _, _, kept in brute(texts, 5) if kept)
    assert got.where("doc_id is null").count() == 1


def test_each_text_of_a_repeated_id_stays(spark):
    """Two unrelated texts under one id, of which one has a near copy elsewhere."""
    one, two = prose(51, 80), prose(52, 80)
    rows = [(1, one), (7, two), (7, one + " end"), (7, two), (9, two.upper()), (12, prose(53, 80)), (12, prose(54, 80))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in minhash.deduplicated(df, 5).collect()]
    assert len(got) == len(set(got))
    ids = [i for i, _ in got]
    assert ids.count(12) == 2 and ids.count(1) == 1
    texts = {t.lower() for _, t in got}
    assert one.lower() in texts and two.lower() in texts  # no text is lost with its copies


def test_minhash_estimates_similarity():
    a = minhash.shingle_hashes(prose(1, 2000), 2)
    b = a[: len(a) * 8 // 10]
    agree = (minhash.minhashes(a) == minhash.minhashes(b)).mean()
    assert 0.5 < agree <= 1
    assert (minhash.minhashes(a) == minhash.minhashes(a, part=7)).all()
