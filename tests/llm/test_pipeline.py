"""The pipeline, stage by stage, against plain Python over the same small corpus."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from broodline.llm import language_id, pii, toxicity
from broodline.llm.queries import QUERIES

from .conftest import DOC_SCHEMA, prose
from .test_minhash import brute
from .test_packing import check, tokenizer  # noqa: F401


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        text, bad = prose(i, 80), i % 7 == 0
        if bad:
            text += " " + " ".join(r.sample(["vilda", "gromp", "snark", "blurg"], 3))
        if i % 11 == 0:
            text += f" mail user{i}@host.example.com or +1 555 123 {1000 + i}"
        if i % 13 == 0 and i:
            text = rows[i - 1][1] + " extra"
        rows.append((i, text, "en" if i % 2 else None, f"s{i % 3}", len(text)))
        if i % 2:
            labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, "s", None), (1001, "", None, "s", 0), (1002, "12 34 !!", None, "s", 8), (None, prose(9, 50), None, None, 1)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOC_SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_match_plain_python(spark, corpus, tokenizer):  # noqa: F811
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "near_dedup", "pii", "packing"]
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = texts(now)
        out = stage(spark, now, corpus)
        if name == "language_id":
            found = language_id.train_on_documents(now).predict([t for _, t in before])
            want = [x for x, lang, score in zip(before, *found) if lang != "und" and score > 0]
            assert len(want) == len(before) - 3
        elif name == "toxicity":
            model = toxicity.train(now, spark.read.parquet(f"{corpus}/labels.parquet"))
            want = [x for x, p in zip(before, model.predict([t for _, t in before])[1]) if p < toxicity.LIMIT]
            assert 0 < len(before) - len(want) < 60
        elif name == "near_dedup":
            kept = {i for i, _, _, stays in brute({i: t for i, t in before if i is not None}, 5) if stays}
            want = [x for x in before if x[0] is None or x[0] in kept]
            assert len(want) < len(before)
        elif name == "pii":
            model = pii.train(now)
            want = [(i, pii.masked(t, model)) for i, t in before]
            assert sum("[EMAIL]" in t for _, t in want) > 10 and not any("@host" in t for _, t in want)
        else:
            check(out.collect(), before, tokenizer)
            continue
        assert out.columns == columns and texts(out) == want
        now = spark.createDataFrame(out.collect(), out.schema)


def test_run_and_registration(spark, corpus, tokenizer):  # noqa: F811
    got = corpus_pipeline.run(spark, corpus)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.select("doc_id").distinct().count() > 200
    registered = entry.queries()
    assert {"pipeline", *QUERIES} <= registered.keys()
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 11)]


def test_empty_documents(spark, corpus, tmp_path):
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_unlearned_scripts_go_and_short_clean_texts_stay(spark):
    r = random.Random(5)
    rows = [(i, prose(i, 80), "en") for i in range(60)]

    def noise(low, high):
        return "".join(chr(r.randrange(low, high)) if r.random() > 0.15 else " " for _ in range(150))

    rows += [(1000 + i, noise(*span), None) for i, span in enumerate([(0x4E00, 0x9FA5), (0x430, 0x450), (97, 123)] * 20)]
    words = sorted({w for _, t, _ in rows[:60] for w in t.split()})
    rows += [(2000 + i, w, None) for i, w in enumerate([*words, "Kiwi"])]
    docs = spark.createDataFrame([(*x, None, None) for x in rows], DOC_SCHEMA)
    kept = {x.doc_id for x in corpus_pipeline.keep_known_language(spark, docs, "").collect()}
    assert {i for i, *_ in rows if i < 1000 or i >= 2000} <= kept
    assert sum(1000 <= i < 2000 for i in kept) <= 1
