import hashlib
import random
import re

import pytest

from broodline.llm import pii


def naive(text):
    """The contract's patterns, applied as they are written."""
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and pii._luhn(digits):
            out.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


SAMPLES = {
    1: "write a.b+c@mail.example.com, or 10.0.0.255 é 4111 1111 1111 1111!",
    2: "+1 (555) 123-4567 and +12 34 and 1.2.3.4.5.6.7.8 and 256.1.1.1 00012.3.4.5",
    3: "email: jo.doe (at) example (dot) org", 4: "call 555-123-4567 now", 5: None, 6: "", 7: "x" * 200_000,
    8: "1" * 100_000, 9: "@" * 50_000 + "a@b.c", 10: "9@@a@b-.c", 11: "a@b.c@d.e", 12: "4111-1111-1111-1111" * 3,
}


def test_base_spans_match_the_patterns():
    r = random.Random(5)
    texts = [t for i, t in SAMPLES.items() if t and i not in (7, 8)]
    texts += ["".join(r.choice("a@.1-+ (9%é\n") for _ in range(r.randint(0, 30))) for _ in range(4000)]
    for t in texts:
        got = sorted(pii.base_spans(t), key=lambda s: (s[0], pii.KINDS.index(s[1])))
        assert got == naive(t), t


def test_table(spark, clashing, docs, empty):
    rows = [*SAMPLES.items(), (1, SAMPLES[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pii.spans_table(df, pii.train(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        base = [s for s in naive(SAMPLES[r.doc_id] or "")] if r.doc_id not in (7, 8) else []
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(pii.written(base).split(",")) - {""} <= set(spans)
        assert len(spans) == len(base) + r.n_added
    nothing = pii.train(empty)
    assert nothing.weights == () and pii.spans_table(empty, nothing).count() == 0
    assert pii.mask(clashing, nothing).columns == clashing.columns
    assert pii.mask(docs, nothing).exceptAll(docs).isEmpty()


def test_wider_spans_need_support(spark):
    """Labelers that agree carry a written-out address; lone number groups do not pass."""
    rows = [(i, f"please email: user{i}@host{i}.com or call phone +1 555 123 {1000 + i}") for i in range(60)]
    rows += [(100 + i, f"contact by email name{i} (at) place{i} (dot) org today") for i in range(20)]
    rows += [(200 + i, f"serial 123-456-{1000 + i}7 order x555 123 4567y no. 1234/5678/1234/567{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(df)
    assert model.reliability["email"][0][1][2] > model.reliability["email"][0][0][2] - 0.5
    got = {r.doc_id: r for r in pii.spans_table(df, model).collect()}
    assert sum(got[100 + i].n_added for i in range(20)) >= 15
    assert sum(got[200 + i].n_added for i in range(20)) == 0


def test_number_groups_are_decided_by_the_classifier(spark):
    """Groups of card length are candidates of which the labelers think differently: those that
    fail the checksum do not pass, written-out addresses in the same table do."""
    r = random.Random(8)
    rows = [(i, f"credit card 4111 1111 1111 1111 mail a{i}@host.com") for i in range(100)]
    fails = [n for n in (r.randint(10 ** 15, 10 ** 16 - 1) for _ in range(300)) if not pii._luhn(str(n))][:150]
    rows += [(1000 + i, f"some words {n} and more") for i, n in enumerate(fails)]
    rows += [(2000 + i, f"contact by email name{i} (at) place{i} (dot) org today") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.n_added for x in pii.spans_table(df, pii.train(df)).collect()}
    texts = dict(rows)
    votes = [pii.votes(texts[1000 + i], a, k, b, False) for i in range(150) for a, k, b in pii.wider_spans(texts[1000 + i], [])]
    assert len(votes) == 150 and {min(v) for v in votes} == {-1} and {max(v) for v in votes} == {1}
    assert sum(got[1000 + i] for i in range(150)) == 0
    assert sum(got[2000 + i] for i in range(30)) >= 25


def test_long_digit_runs_are_scanned_once():
    text = "1" * 300_000 + " " + "12 " * 100_000 + "x" + "1.1" * 100_000
    assert pii.wider_spans(text, pii.base_spans(text)) == []


def test_reliabilities_recover_a_planted_model():
    r = random.Random(2)
    counts = {}
    for _ in range(4000):
        y = r.random() < 0.4
        vote = tuple((1 if y else -1) * (1 if r.random() < p else -1) for p in (0.95, 0.85, 0.7))
        counts[vote] = counts.get(vote, 0) + 1
    tables, chance = pii.reliabilities(list(counts.items()))
    right = [(tables[j, 1, 2] + tables[j, 0, 0]) / 2 for j in range(3)]
    assert right[0] > right[1] > right[2] and abs(right[0] - 0.95) < 0.05
    assert dict(zip(counts, chance))[(1, 1, 1)] > 0.95


def test_masking():
    model = pii.SpanModel()
    assert pii.masked(None, model) is None
    assert pii.masked("to a@b.cd, +1 555 123 4567", model) == "to [EMAIL], [PHONE]"
    assert pii.masked("+4111 1111 1111 1111", model) == "[PHONE]" or "[CARD]" in pii.masked("+4111 1111 1111 1111", model)


def test_masked_table_sets_lengths(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd", 11), (2, None, None), (3, "plain", 99)],
                               "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.mask(df, pii.SpanModel()).collect()}
    assert got[1].text == "mail [EMAIL]" and got[1].n_chars == 12
    assert got[2].text is None and got[2].n_chars is None and got[3].n_chars == 99


def test_the_classifier_does_not_depend_on_the_size_of_the_input():
    """The same shares of spans give the same weights, also where a count passes 1,000."""
    rows = [("email", (1, 1, 1, 0, 1), (1, 0, 1), 900, 0.9), ("phone", (0, -1, 1, 0, -1), (0, 1, 1), 300, 0.2), ("card", (1, 0, 0, 1, 0), (1, 1, 0), 7, 0.7)]
    width = len(pii.surface("a", 0, 1))
    rows = [(k, v[: len(pii.votes("a@b.cd", 0, "email", 6, True))], (s * 3)[:width], n, p) for k, v, s, n, p in rows]
    more = [(k, v, s, 1000 * n, p) for k, v, s, n, p in rows]
    assert pii._classifier(rows) == pytest.approx(pii._classifier(more), abs=1e-9)
