import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from broodline.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(pieces, rows, tokenizer):
    """Every id is in one piece, sequences are gapless and fit, checksums are right."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    want = defaultdict(list)
    for i, text in rows:
        want[i].append(ids_of(tokenizer, text))
    assert by_doc.keys() == want.keys()
    for i, copies in want.items():
        found = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[i])
        assert found == sorted((a, min(1024, len(x) - a), zlib.crc32(x[a : a + 1024].tobytes()), len(x))
                               for x in copies for a in range(0, len(x), 1024))
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at and p.length >= 1
            at += p.length
        assert at <= 1024
    return sum(1024 - sum(p.length for p in parts) for parts in by_sequence.values()), len(by_sequence)


def test_pieces(docs, texts, tokenizer):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(packing.pack(docs).collect(), rows, tokenizer)


def test_little_padding_on_a_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    padding, sequences = check(packing.pack(docs).collect(), rows, tokenizer)
    assert padding < 0.02 * 1024 * sequences


def test_shards_share_one_ranking(docs, texts, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 3)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(packing.pack(docs).collect(), rows, tokenizer)


def test_clashing_columns_and_empty_tables(clashing, docs, empty):
    assert packing.pack(clashing).count() == packing.pack(docs).count()
    assert packing.pack(empty).count() == 0


def test_encoder_equals_the_tokenizer(tokenizer):
    e = packing.Encoder()
    for text in ["", "plain text, it's 12", "é ñ ß", "日本 <|endoftext|> x", "a <|endoftext|>", "\x00\x1c 　"]:
        assert e.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_linear_program_reaches_the_known_optimum():
    lengths, demand = np.array([50, 64, 78]), np.array([100.0, 50.0, 100.0])
    plan = packing.linear_program(lengths, demand, gap=0)
    assert abs(sum(use for _, use in plan) - 125) < 1e-6  # 50 + 78, and 64 twice
    assert np.allclose(sum(use * pattern for pattern, use in plan), demand)


def test_plan_places_every_remainder_once():
    r = np.random.default_rng(1)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(r.integers(1, packing.ROOM + 1, 5000), return_counts=True))}
    slots, sequences = packing.plan(histogram)
    ranks = defaultdict(list)
    for length, lo, hi, *_ in slots:
        ranks[length].append((lo, hi))
    for length, n in histogram.items():
        at = 0
        for lo, hi in sorted(ranks[length]):
            assert lo == at
            at = hi
        assert at == n
    assert sequences <= 1.01 * sum(k * v for k, v in histogram.items()) / packing.ROOM + 1
    assert packing.plan({}) == ([], 0)


def test_added_tokens_keep_their_ids(spark, tokenizer):
    encoder = packing.Encoder()
    assert [*encoder.ids("a <|endoftext|> b").tolist(), 0] == [64, 220, 50256, 275, 0]
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 1500), (3, "é日 <|endoftext|>"), (4, "<|endoftext"), (5, "word " * 300_000)]
    check(packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, tokenizer)


def test_sums_before_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 3)
    rows = [(c, s, s * 7 + c) for c in range(3) for s in range(20) if (s + c) % 4]
    df = spark.createDataFrame(rows, "class int, shard int, n long")
    got = {(r["class"], r.shard): r.before for r in packing.sums_before(df, ["class"], "n", "before").collect()}
    assert got == {(c, s): sum(n for d, t, n in rows if d == c and t < s) for c, s, _ in rows}
