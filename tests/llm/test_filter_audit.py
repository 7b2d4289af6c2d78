import itertools
import re
from collections import defaultdict

from broodline.llm import filter_audit

from .conftest import prose


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = defaultdict(list)
    for i, t, source in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
             "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts[source or ""].append(({x for x in f if f[x]}, i in good, i in toxic))
    out = set()
    for part, rows in parts.items():
        taken = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            for f, _, _ in rows:
                if hit := [x for x in order if x in f]:
                    taken[hit[0]] += 1
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                left = [r for r in rows if not r[0] & set(order[:k])]
                gone = [r for r in left if x in r[0]]
                out.add((part, "".join(order), k + 1, len(left) - len(gone), len(gone),
                         sum(x in r[0] for r in rows) - len(gone), sum(r[0] == {x} for r in rows),
                         sum(r[1] for r in gone), sum(r[2] for r in gone), taken[x]))
    return out


def table(texts):
    rows = [(i, t, [None, "", "s1", "s2"][i % 4]) for i, t in texts.items()]
    rows += [(200 + i, "A SHOUT # " * (i % 7) + prose(i, 60), f"s{i % 3}") for i in range(40)]
    rows += [(300 + i, "same text " * 30, f"s{i % 3}") for i in range(50)]
    rows += [(None, "same text " * 30, "s1"), (None, None, None), (300, "same text " * 30, "s1"), (301, "other", "s1"),
             (900, "x" * 500_000 + " y" * 300_000, "s2"), (901, "\x1c\x85  " * 60, "s2")]
    labels = [(i, i % 2, i % 3 == 0) for i, _, _ in rows if i] + [(200, 0, 1), (200, 1, 0), (None, 1, 1), (5555, 1, 1)]
    return rows, [(i, q, int(t)) for i, q, t in labels]


def frames(spark, rows, labels):
    return (spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_equals_brute_force(spark, texts):
    rows, labels = table(texts)
    got = filter_audit.filter_audit(*frames(spark, rows, labels)).collect()
    assert len(got) == len(set(got)) == 600 * len({s or "" for _, _, s in rows})
    assert {tuple(r) for r in got} == brute(rows, labels)


def test_matrix_is_exact(spark, texts):
    rows, labels = table(texts)
    docs, _ = frames(spark, [r for r in rows if r[0] and r[0] < 200], labels)
    shards, words = filter_audit.document_term_matrix(docs)
    names = {r.id: r.word for r in words.collect()}
    assert words.count() == len(names) == len(set(names.values()))
    seen = 0
    for s in shards.collect():
        starts, ids, times = map(filter_audit.unpacked, (s.starts, s.columns, s.counts))
        for k, i in enumerate(s.doc_ids):
            columns, counts = (x[starts[k] : starts[k + 1]].tolist() for x in (ids, times))
            want = defaultdict(int)
            for w in re.findall(r"[^\x20\x09-\x0D]+", dict((a, b) for a, b, _ in rows)[i] or ""):
                want[w] += 1
            assert {names[c]: n for c, n in zip(columns, counts)} == want and len(columns) == len(want)
            seen += 1
    assert seen == docs.count()


def test_small_chunks_give_the_same(spark, texts):
    rows, labels = table(texts)
    docs, marks = frames(spark, rows, labels)
    want = sorted(filter_audit.failure_counts(docs, marks).collect())
    whole = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    assert sorted(filter_audit.failure_counts(whole, marks).collect()) == want


def test_empty_and_clashing(spark, empty, docs, clashing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(empty, labels).count() == 0
    one, two = (filter_audit.filter_audit(d, labels).collect() for d in (docs, clashing))
    assert sorted(one) == sorted(two) and len(one) == 1800
