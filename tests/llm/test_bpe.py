import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from broodline.llm import bpe
from broodline.llm.packing import read_ranks


@pytest.fixture(scope="module")
def encoder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(bpe.RANKS), special_tokens={})


def want(encoder, text):
    data = np.array(encoder.encode_ordinary(text or ""), "<u4").tobytes()
    return len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_words_cover_the_text_and_encode_alone(encoder):
    r = random.Random(1)
    for _ in range(5000):
        text = "".join(r.choice("ab'sSt  \n\t\x1c\x85\xa0 　.,1٣éñ日😀​\x00") for _ in range(r.randint(0, 16)))
        words = bpe.split_words(text)
        assert "".join(words) == text
        assert [i for w in words for i in encoder.encode_ordinary(w)] == encoder.encode_ordinary(text)


def test_round_trip(docs, clashing, empty, encoder):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for df in (docs, clashing):
        got = bpe.digests(df).collect()
        assert len(got) == docs.count()
        for r in got:
            assert tuple(r)[1:] == want(encoder, texts[r.doc_id])
    assert bpe.digests(empty).count() == 0


def test_many_small_chunks(docs, encoder, monkeypatch):
    """Chunks of a few texts, and equal chunks, meet their own words again."""
    rows = [_ for _ in bpe._chunk_rows("0-0", [1, 2], ["a b a", "b c"], 4)]
    assert rows[0]["ids"] == [1, 2] and {r["chunk"] for r in rows[1:]} == {rows[0]["key"]}
    twice = docs.unionByName(docs).repartition(6)
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digests(twice).collect() if r.doc_id)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got == sorted((False, r.doc_id, *want(encoder, texts[r.doc_id])[:2]) for r in twice.collect() if r.doc_id)


def test_packed_integers():
    x = np.array([0, 1, 255, 256, 70_000, 2**32 - 1], np.uint32)
    assert (bpe._unsqueeze(bpe._squeeze(x)) == x).all() and len(bpe._unsqueeze(bpe._squeeze(x[:0]))) == 0
    lengths, body = bpe._unpack(bpe._pack([b"ab", b"", b"c"]))
    assert lengths.tolist() == [2, 0, 1] and body == b"abc"


def test_decoding_stored_ids(docs):
    encoded = bpe.encode(docs)
    assert encoded.columns == ["doc_id", "ids"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.decode(encoded).collect()
    assert all(bytes(r.decoded).decode() == (texts[r.doc_id] or "") for r in got if r.doc_id) and len(got) == docs.count()


def test_readers_share_one_exchange_and_get_their_own_rows(docs):
    plan = bpe.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("FlatMapCoGroupsInArrow") >= 3
    dealt = bpe._dealt(docs, 4)
    words, chunks = bpe._of_kind(dealt, True), bpe._of_kind(dealt, False)
    assert words.where("bucket is null").isEmpty() and not words.isEmpty()
    assert chunks.where("bucket is not null").isEmpty() and chunks.count() >= 1
